"""One long source must give the same result however finely its work is split."""

from pyspark.sql import functions as F

from clipspark.operators import blocks, chains, context, intervals, ranking, scoring, segmentation, signals
from clipspark.sources import derived
from tests.conftest import rows


def _one_long_source(spark, sf_dir):
    """All documents' segments laid end to end as a single source, with silences."""
    seg = derived.segments(spark, sf_dir)
    return seg.select(
        F.lit(1).cast("long").alias("source_id"),
        (F.col("source_id") * 10_000 + F.col("segment_id")).alias("segment_id"),
        (F.col("start_ms") + F.col("source_id") * 1_500_000).alias("start_ms"),
        (F.col("end_ms") + F.col("source_id") * 1_500_000).alias("end_ms"),
        "text",
    ).where(F.col("segment_id") < 600_000)


def _greedy_windows(segs):
    """Brute force: the cutting rule written down as a loop."""
    segs = [s for s in segs if s["text"].strip()]
    out, i, n = [], 0, len(segs)
    while i < n:
        j = i
        while j + 1 < n and segs[j + 1]["end_ms"] - segs[i]["start_ms"] <= 90_000:
            j += 1
            if segs[j]["end_ms"] - segs[i]["start_ms"] >= 60_000:
                break
        length = segs[j]["end_ms"] - segs[i]["start_ms"]
        if length >= 30_000 or (j == n - 1 and length >= 18_000):
            out.append((segs[i]["start_ms"], segs[j]["end_ms"]))
        if j == n - 1:
            break
        goal = segs[i]["start_ms"] + 45_000
        i += 1
        while i < n and segs[i]["start_ms"] < goal:
            i += 1
    return out


def test_windows_match_the_rule_across_blocks(spark, sf_dir):
    seg = _one_long_source(spark, sf_dir).cache()
    want = _greedy_windows([r.asDict() for r in seg.orderBy("segment_id").collect()])
    assert len(want) > 50
    for block in (100_000, 1_000_000, blocks.DAY_MS):
        got = segmentation.candidate_windows(seg, block_ms=block).orderBy("candidate_seq").collect()
        assert [(r["start_ms"], r["end_ms"]) for r in got] == want, block
        assert [r["candidate_seq"] for r in got] == list(range(1, len(want) + 1))


def test_chapters_and_captions_do_not_depend_on_blocks(spark, sf_dir):
    seg = _one_long_source(spark, sf_dir).where(F.col("segment_id") < 200_000)
    scenes = seg.where(F.col("segment_id") % 40 == 0).select("source_id", (F.col("start_ms") + 300).alias("t_ms"))
    whole = rows(segmentation.chapter_plan(seg, scenes))
    assert len(whole) > 5
    assert rows(segmentation.chapter_plan(seg, scenes, block_ms=450_000)) == whole
    words = seg.select(
        "source_id", (F.col("segment_id") * 1000).alias("pos"), "start_ms", "end_ms", F.split("text", " ")[0].alias("word")
    )
    cards = rows(segmentation.caption_cards(words).drop("words"))
    assert rows(segmentation.caption_cards(words, block_ms=20_000).drop("words")) == cards


def test_numbering_and_asof_do_not_depend_on_blocks(spark, sf_dir):
    seg = _one_long_source(spark, sf_dir).select("source_id", "segment_id", "start_ms", "end_ms")
    fine = seg.withColumn("block", F.floor(F.col("start_ms") / 10_000))
    got = [r["n"] for r in blocks.number_rows(fine, ["source_id"], "block", [F.col("segment_id")], "n").orderBy("segment_id").collect()]
    assert got == list(range(1, len(got) + 1))
    points = seg.where(F.col("segment_id") % 3 == 0).select("source_id", "segment_id", (F.col("start_ms") + 777).alias("t"))
    events = seg.where(F.col("segment_id") % 5 == 0).select("source_id", F.col("segment_id").alias("e"), F.col("end_ms").alias("at"))
    for forward in (False, True):
        a, b = (
            rows(intervals.asof(points, events, "source_id", "t", "at", F.col("e"), "hit", forward=forward, block_ms=w))
            for w in (5_000, blocks.DAY_MS)
        )
        assert a == b and len({r[-1] for r in a}) > 5


def test_rank_of_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.col("id"), (F.col("id") * 7 % 13).cast("double").alias("score"))
    got = ranking.number_by_score(df, ["key"], "score", "id", tie_block=64).collect()
    want = {r["id"]: i for i, r in enumerate(sorted(got, key=lambda r: (-r["score"], r["id"])), start=1)}
    assert {r["id"]: r["rank"] for r in got} == want


def test_suppression_of_a_large_source(spark):
    scored = spark.range(400).select(
        (F.col("id") % 2).alias("source_id"), F.col("id").alias("candidate_seq"), (F.col("id") * 700).alias("start_ms"),
        (F.col("id") * 700 + 60_000).alias("end_ms"), ((F.col("id") * 37) % 101).cast("double").alias("score"),
    )
    want = []
    for source in (0, 1):
        kept = []
        for c in sorted((r for r in scored.collect() if r["source_id"] == source), key=lambda r: (-r["score"], r["candidate_seq"])):
            shared = [min(c["end_ms"], k["end_ms"]) - max(c["start_ms"], k["start_ms"]) for k in kept]
            if len(kept) < 5 and all(s / 60_000 < 0.6 for s in shared):
                kept.append(c)
        want += [(str(source), str(i + 1), str(c["candidate_seq"])) for i, c in enumerate(kept)]
    assert rows(ranking.nms_top_k(scored, 5, 0.6), "source_id", "rank", "candidate_seq") == sorted(want)


def test_percentiles_match_the_exact_ones(spark):
    df = spark.range(3000).select(F.lit(1).alias("source_id"), (F.col("id") * 7919 % 1000 / 997.0).alias("rms"))
    got = signals.exact_percentiles(df, "source_id", "rms", (0.1, 0.5, 0.99), 1e-2).collect()[0]
    want = df.agg(F.percentile("rms", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("p")).collect()[0]["p"]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got[1:], want))


def test_blend_needs_both_sides(spark):
    import pytest

    df = spark.createDataFrame([("s", 1, 1.0, 2.0), ("s", 2, 2.0, None)], "source string, id int, a double, b double")
    with pytest.raises(Exception, match="has no b"):
        scoring.blend_ranks(df, "a", "b", ["source"]).collect()
    assert scoring.blend_ranks(df, "a", "b", ["source"], 1.0).count() == 2


def test_touching_segments_are_context_not_content(spark):
    seg = spark.createDataFrame(
        [(1, 0, 0, 5_000, "before"), (1, 1, 5_000, 65_000, "inside"), (1, 2, 65_000, 70_000, "after")],
        "source_id long, segment_id long, start_ms long, end_ms long, text string",
    )
    cand = spark.createDataFrame([(1, 1, 5_000, 65_000, "inside")], "source_id long, candidate_seq long, start_ms long, end_ms long, text string")
    r = context.surrounding_context(cand, seg).collect()[0]
    assert (r["previous_context"], r["next_context"], r["silence_before_ms"], r["silence_after_ms"]) == ("before", "after", 0, 0)


def test_walks_enter_blocks_where_pointers_lead(spark):
    """Blocks of five rows, pointers three rows on, two keys of unequal length, one null key."""
    length = {"a": 23, "b": 7, None: 4}
    nodes = [
        (k, i // 5, i, i + 3 if i + 3 < n else None, (i + 3) // 5 if i + 3 < n else None, f"{k}{i}")
        for k, n in length.items() for i in range(n)
    ]
    df = spark.createDataFrame(nodes, "key string, block long, pos long, nxt long, nxt_block long, name string")
    got = chains.reach(df.repartition(3), ["key"], ["name"]).select("key", "pos", "name").collect()
    assert sorted(map(tuple, got)) == [(k, i, f"{k}{i}") for k in "ab" for i in range(0, length[k], 3)]
    assert chains.reach(df.limit(0), ["key"], ["name"]).count() == 0


def test_suppression_of_chains_and_missing_scores(spark):
    """Each candidate is beaten by the next of its chain; one without a score comes last."""
    rows_ = [(1, i, i * 10_000, i * 10_000 + 60_000, float(i)) for i in range(30)] + [(1, 99, 900_000, 960_000, None), (2, 1, 0, 0, 1.0), (2, 2, 0, 0, 1.0)]
    scored = spark.createDataFrame(rows_, "source_id long, candidate_seq long, start_ms long, end_ms long, score double")
    assert [r["candidate_seq"] for r in ranking.nms_top_k(scored, 4).where("source_id = 1").orderBy("rank").collect()] == [29, 26, 23, 20]
    everything = ranking.nms_top_k(scored, 50)
    assert everything.where("source_id = 1").orderBy(F.desc("rank")).first()["candidate_seq"] == 99
    assert everything.where("source_id = 2").count() == 2
    assert ranking.nms_top_k(scored.limit(0)).count() == 0
