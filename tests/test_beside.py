"""Candidates beside their segments in one sorted pass, against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clipspark.operators import context, signals, subclips
from clipspark.operators.beside import beside
from clipspark.operators.blocks import DAY_MS
from clipspark.sources import derived
from tests.conftest import rows

SEG = "source_id long, segment_id long, start_ms long, end_ms long, text string"
CAND = "source_id long, candidate_seq long, start_ms long, end_ms long, text string"


def _odd(spark):
    """Segments that overlap, end before they start, or lack something; candidates of no
    source, without a start, in silence, and as long as the source."""
    r = random.Random(4)
    segs, cands = [], []
    for source in range(6):
        t = -7_000 if source == 5 else 0
        for i in range(40):
            t += r.randint(0, 9_000)
            segs.append((source, i, t, t + r.choice([0, 200, 900, 4_000, 30_000, -500]), r.choice(["so.", " and", "it is", "", None])))
        cands += [(source, k, x, x + r.choice([60_000, 20_000, 1]), r.choice(["own", " ", None])) for k, x in enumerate(r.choices(range(-20_000, t), k=12))]
        cands.append((source, 99, 0, t, ""))
    segs += [(None, 0, 0, 5_000, "none"), (0, 70, None, 5_000, "none"), (0, 71, 5_000, None, "none")]
    cands += [(None, 0, 0, 60_000, ""), (0, 100, None, None, ""), (9, 0, 0, 60_000, ""), (0, 101, 10**9, 10**9 + 9, None)]
    return spark.createDataFrame(segs, SEG), spark.createDataFrame(cands, CAND), segs, cands


def _meets(g, c0, c1):
    return None not in (*g[:4], c0, c1) and g[2] < c1 and g[3] > c0


@pytest.mark.parametrize("block", [5_000, 60_000, DAY_MS])
def test_windows_of_odd_candidates(spark, block):
    s, c, segs, cands = _odd(spark)
    lengths = spark.createDataFrame([(k, 150_000) for k in range(5)], "source_id long, duration_ms long")
    want = []
    for source, seq, start, end, own in cands:
        spans, texts = None, ["", (own or "").strip(), ""]
        if start is not None:
            upper = max(150_000 if source is not None and source < 5 else 0, end)
            c0 = max(0, min(start, upper))
            c1 = max(c0, min(end, upper))
            spans = [max(0, c0 - 75_000), c0, c1, min(upper, c1 + 25_000)]
            met = sorted(((g[2], g[1], g[4]) + (g[3],) for g in segs if g[0] == source and _meets(g, spans[0], spans[3])), key=lambda x: x[:2])
            sides = [" ".join(t for b, _, t, e in met if t is not None and b < hi and e > lo) for lo, hi in zip(spans, spans[1:])]
            texts = [sides[0], texts[1] or sides[1], sides[2]]
        want.append((source, seq, spans, *texts))
    got = context.context_windows(c, s, lengths, block_ms=block).collect()
    key = lambda x: (str(x[0]), x[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2]
        # a candidate without a start lies at the end of its source
        assert b[2] is None or (list(a[2:6]), *a[6:]) == b[2:]


@pytest.mark.parametrize("block", [5_000, DAY_MS])
def test_units_and_curves_of_odd_candidates(spark, block):
    s, c, segs, cands = _odd(spark)
    units, shape = [], {}
    for source, seq, c0, c1, _ in cands:
        met = [g for g in segs if g[0] == source and source is not None and _meets(g, c0, c1)]
        cut = sorted((max(g[2], c0) - c0, g[1], min(g[3], c1) - c0, (g[4] or "").strip() if g[4] is not None else None) for g in met if min(g[3], c1) - max(g[2], c0) >= 150)
        run = 0
        for k, (a, _, b, text) in enumerate(cut):
            gap = cut[k + 1][0] - b if k + 1 < len(cut) else 0
            run += k > 0 and a - cut[k - 1][2] > 1_200
            ends = True if gap >= 1_200 else None if text is None else text.endswith(".")
            units.append((source, seq, k, a, b, text, ends, max(0, gap), run))
        if c0 is not None:
            speech, chars = [0.0] * max(0, -((c0 - c1) // 1000)), [0.0] * max(0, -((c0 - c1) // 1000))
            for g in (g for g in met if g[3] > g[2]):
                a, b = max(g[2], c0) - c0, min(g[3], c1) - c0
                for k in range(a // 1000, (b - 1) // 1000 + 1):
                    ms = min(b, k * 1000 + 1000) - max(a, k * 1000)
                    speech[k] += ms / 1000
                    chars[k] += len(g[4] or "") / ((g[3] - g[2]) / 1000) * ms / 1000
            for k, (x, y) in enumerate(zip(speech, chars)):
                energy = y / max(chars) if max(chars) > 1e-9 else 0.0
                shape[source, seq, k] = (min(1.0, x), energy, min(1.0, 0.65 * min(1.0, x) + 0.35 * energy))
    assert rows(context.speech_units(c, s, block_ms=block)) == sorted(tuple(map(str, u)) for u in units)
    got = signals.transcript_curve(c.withColumnRenamed("candidate_seq", "seq"), s, block_ms=block).collect()
    assert {(r[0], r[1], r[2]) for r in got} == set(shape) and len(got) == len(shape)
    assert all(abs(v - w) <= 5.1e-5 for r in got for v, w in zip(r[3:], shape[r[0], r[1], r[2]]))


def test_the_search_in_one_pass_is_that_of_its_parts(spark, sf_dir):
    clips, seg = derived.clips(spark, sf_dir).withColumnRenamed("candidate_seq", "seq"), derived.segments(spark, sf_dir)
    at = F.when(F.col("seq") % 2 == 1, (F.col("source_id") % 30).cast("double"))
    c = clips.select("source_id", "seq", "start_ms", "end_ms", F.lit(60_000).cast("long").alias("duration_ms"), at.alias("a0"), (at + 12).alias("a1"))
    units = context.speech_units(c.withColumnRenamed("seq", "candidate_seq"), seg).withColumnRenamed("candidate_seq", "seq")
    curve = signals.signal_curve(c.select("source_id", "seq", F.lit(60).cast("long").alias("duration")), [("transcript", signals.transcript_curve(c, seg))])
    whole = subclips.refine_subclip(c, units, curve, c.select("source_id", "seq", "a0", "a1", F.lit(60.0).alias("duration")))
    assert rows(subclips.refine_spoken(c, seg)) == rows(whole)


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_that_lie_by_source_are_shuffled_once(spark, sf_dir):
    """Of documents cut into segments: the segments, and those that candidates are made of."""
    q = entry.queries()
    assert _shuffles(q["a18_refine_subclip"](spark, sf_dir)) == 2
    # and the lengths of sources, which come with the documents' rows
    assert _shuffles(q["j2_context_windows"](spark, sf_dir)) <= 4
    assert _shuffles(q["j7_speech_units"](spark, sf_dir)) == 2


def test_spans_are_read_off_the_curve_in_its_row(spark, sf_dir):
    plan = entry.queries()["a15_span_stats"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    head = plan[: plan.index("Join")]
    assert "Aggregate" not in head and "Window" not in head


def test_listed_seconds_are_not_broadcast(spark):
    cands = spark.range(3).selectExpr("0L as source_id", "id as seq", "id * 20 as start_bin", "id * 20 + 40 as end_bin")
    df = signals._on_bins(cands, spark.range(100).selectExpr("0L as source_id", "id as bin"))
    assert df.count() == 120 and "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_no_candidates(spark):
    s, c, _, _ = _odd(spark)
    assert context.speech_units(c.limit(0), s).count() == 0
    got = beside(c, s.limit(0), ("start_ms", "end_ms"), "n array<long>", lambda met: {"n": context.lists(context.counted(met.cand, len(met.cands)), context.pa.array(met.seg))})
    assert got.count() == c.count() and got.where(F.size("n") > 0).count() == 0
