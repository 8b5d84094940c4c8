"""Joining candidates to what is said, planned and predicted around them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import first_match
from clipspark.operators.beside import Met, Work, beside, counted, joined, lists, longs
from clipspark.operators.blocks import DAY_MS
from clipspark.operators.intervals import asof, interval_join, ordered_text

CAND = ["source_id", "candidate_seq"]
RUN_GAP_MS = 1_200
TERMINAL_PATTERN = r"[.!?…]+[\"'»)\]]*\s*$"


def _near(cands: DataFrame, segments: DataFrame, before_ms: int, after_ms: int, closed: bool = False) -> DataFrame:
    """Segments meeting each candidate's span widened on both sides."""
    wide = cands.select(
        *CAND,
        F.col("start_ms").alias("c0"),
        F.col("end_ms").alias("c1"),
        (F.col("start_ms") - before_ms).alias("w0"),
        (F.col("end_ms") + after_ms).alias("w1"),
    )
    return interval_join(wide, segments, "source_id", ("w0", "w1"), ("start_ms", "end_ms"), closed)


def surrounding_context(cands: DataFrame, segments: DataFrame, window_ms: int = 45_000) -> DataFrame:
    """Speech wholly before and wholly after each candidate within the window, the
    candidate's speech rate, and the silence on either side of it."""
    s, e, c0, c1 = (F.col(c) for c in ("start_ms", "end_ms", "c0", "c1"))
    before = (e <= c0) & (c0 - s <= window_ms)
    after = (e > c0) & (s >= c1) & (e - c1 <= window_ms)
    texts = (
        _near(cands, segments, window_ms, window_ms, closed=True)
        .where(before | after)
        .groupBy(*CAND)
        .agg(
            ordered_text(["segment_id"], when=before).alias("previous_context"),
            ordered_text(["segment_id"], when=after).alias("next_context"),
        )
    )
    ev = segments.select("source_id", "segment_id", "start_ms", "end_ms").withColumnRenamed("start_ms", "_s").withColumnRenamed("end_ms", "_e")
    edges = asof(
        cands, ev, "source_id", "start_ms", "_e", F.struct("segment_id", F.col("_e").alias("at")), "prev"
    )
    edges = asof(
        edges, ev, "source_id", "end_ms", "_s", F.struct("segment_id", F.col("_s").alias("at")), "next", forward=True
    )
    said = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    minutes = F.greatest(F.lit(0.1), (F.col("end_ms") - F.col("start_ms")) / 60_000.0)
    return edges.join(texts, CAND, "left").select(
        *CAND,
        F.coalesce("previous_context", F.lit("")).alias("previous_context"),
        F.coalesce("next_context", F.lit("")).alias("next_context"),
        F.round(said / minutes, 1).alias("speech_rate_wpm"),
        (F.col("start_ms") - F.col("prev.at")).alias("silence_before_ms"),
        (F.col("next.at") - F.col("end_ms")).alias("silence_after_ms"),
    )


def _sides(met: Met) -> dict[str, pa.Array]:
    """The texts before, inside (where the candidate has none of its own) and after."""
    s, e = (longs(met.segs, c)[met.seg] for c in ("start_ms", "end_ms"))
    b0, c0, c1, a1 = (longs(met.cands, c)[met.cand] for c in ("b0", "c0", "c1", "a1"))
    own = met.cands["own"].fill_null("").combine_chunks()
    blank = pc.equal(own, "")
    inside = joined(met, (s < c1) & (e > c0) & blank.to_numpy(zero_copy_only=False)[met.cand])
    return {"before_text": joined(met, (s < c0) & (e > b0)), "candidate_text": pc.if_else(blank, inside, own), "after_text": joined(met, (s < a1) & (e > c1))}


def context_windows(
    cands: DataFrame, segments: DataFrame, lengths: DataFrame, before_ms: int = 75_000, after_ms: int = 25_000, block_ms: int = DAY_MS
) -> DataFrame:
    """BEFORE, CANDIDATE and AFTER spans inside the source, each with the text of every
    segment it overlaps (a segment across an edge belongs to both sides)."""
    upper = F.greatest(F.coalesce("duration_ms", F.lit(0)), F.col("end_ms"))
    spans = (
        cands.join(lengths.select("source_id", "duration_ms"), "source_id", "left")
        .withColumn("upper", upper)
        .withColumn("c0", F.greatest(F.lit(0), F.least("start_ms", "upper")))
        .withColumn("c1", F.greatest("c0", F.least("end_ms", "upper")))
        .withColumn("b0", F.greatest(F.lit(0), F.col("c0") - before_ms))
        .withColumn("a1", F.least(F.col("upper"), F.col("c1") + after_ms))
        .select(*CAND, "b0", "c0", "c1", "a1", F.trim("text").alias("own"))
    )
    said = segments.select("source_id", "segment_id", "start_ms", "end_ms", "text")
    return beside(spans, said, ("b0", "a1"), "before_text string, candidate_text string, after_text string", _sides, block_ms).select(
        *CAND,
        F.col("b0").alias("before_start_ms"),
        F.col("c0").alias("start_ms"),
        F.col("c1").alias("end_ms"),
        F.col("a1").alias("after_end_ms"),
        "before_text",
        "candidate_text",
        "after_text",
    )


def assign_chapter(cands: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter sharing most time with each candidate; where none does, the one
    whose middle is nearest. Equal cases go to the earlier chapter."""
    met = interval_join(
        cands.select(*CAND, F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1")),
        chapters.select("source_id", "chapter", F.col("start_ms").alias("h0"), F.col("end_ms").alias("h1")),
        "source_id", ("c0", "c1"), ("h0", "h1"),
    )
    shared = F.least("c1", "h1") - F.greatest("c0", "h0")
    best = met.groupBy(*CAND).agg(F.max(F.struct(shared.alias("ms"), (-F.col("chapter")).alias("neg"))).alias("best"))
    # twice the middle, to stay in integers
    mid = cands.select(*CAND, (F.col("start_ms") + F.col("end_ms")).alias("mid2"))
    ch = chapters.select("source_id", "chapter", (F.col("start_ms") + F.col("end_ms")).alias("_m"))
    left = asof(mid, ch, "source_id", "mid2", "_m", F.struct(F.col("_m").alias("at"), (-F.col("chapter")).alias("neg")), "lo")
    both = asof(left, ch, "source_id", "mid2", "_m", F.struct(F.col("_m").alias("at"), "chapter"), "hi", forward=True)
    near = first_match(
        [
            (F.col("lo").isNull(), F.col("hi.chapter")),
            (F.col("hi").isNull(), -F.col("lo.neg")),
            (F.col("mid2") - F.col("lo.at") < F.col("hi.at") - F.col("mid2"), -F.col("lo.neg")),
            (F.col("mid2") - F.col("lo.at") > F.col("hi.at") - F.col("mid2"), F.col("hi.chapter")),
        ],
        F.least(-F.col("lo.neg"), F.col("hi.chapter")),
    )
    return both.join(best, CAND, "left").select(
        *CAND,
        F.coalesce(-F.col("best.neg"), near).alias("chapter"),
        F.coalesce(F.col("best.ms"), F.lit(0)).cast("long").alias("shared_ms"),
    )


def covering_candidates(cands: DataFrame, moments: DataFrame) -> DataFrame:
    """All candidates whose closed span holds the moment, best centred first; a moment
    no candidate covers stays, flagged."""
    met = interval_join(
        moments.select("source_id", "moment_id", "t_ms", F.col("t_ms").alias("t1")),
        cands.select("source_id", "candidate_seq", "start_ms", "end_ms"),
        "source_id", ("t_ms", "t1"), ("start_ms", "end_ms"), closed=True,
    )
    off = F.abs(F.col("start_ms") + F.col("end_ms") - 2 * F.col("t_ms"))
    order = Window.partitionBy("source_id", "moment_id").orderBy("_off", "candidate_seq")
    placed = met.withColumn("_off", off).select(
        "source_id", "moment_id", "candidate_seq", F.row_number().over(order).cast("long").alias("place")
    )
    return moments.select("source_id", "moment_id", "t_ms").join(placed, ["source_id", "moment_id"], "left").withColumn(
        "covered", F.col("candidate_seq").isNotNull()
    )


def timestamp_label(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def inspect_moments(
    moments: DataFrame, cands: DataFrame, preds: DataFrame, shortlist: DataFrame, scorers: Sequence[str], final: str
) -> DataFrame:
    """Follow a timestamp through every stage: which window holds it, whether that was
    shortlisted, where each scorer ranked it, and what became of it."""
    covered = covering_candidates(cands, moments)
    summary = covered.groupBy("source_id", "moment_id", "t_ms").agg(
        F.max(F.when(F.col("place") == 1, F.col("candidate_seq"))).alias("candidate_seq"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "candidate_seq"))), lambda x: x["candidate_seq"].cast("string")), ","
        ).alias("covering"),
    )
    wide = preds.groupBy("source_id", "candidate_seq").agg(
        *[F.max(F.when(F.col("scorer") == s, F.col("rank"))).alias(f"{s}_rank") for s in scorers],
        *[F.max(F.when(F.col("scorer") == s, F.col("score"))).alias(f"{s}_score") for s in scorers],
        F.max(F.when(F.col("scorer") == final, F.col("status"))).alias("final_status"),
    )
    listed = shortlist.select("source_id", "candidate_seq").distinct().withColumn("in_shortlist", F.lit(True))
    seq = F.col("candidate_seq").cast("string")
    rank = F.col(f"{final}_rank")
    message = first_match(
        [
            (
                F.col("candidate_seq").isNull(),
                F.concat(F.lit("NOT COVERED: no candidate window contains "), timestamp_label(F.col("t_ms"))),
            ),
            (
                F.col("final_status").isNotNull() & (F.col("final_status") != "ranked"),
                F.concat(F.lit("Candidate "), seq, F.lit(" was rejected ("), F.col("final_status"), F.lit(")")),
            ),
            (rank.isNotNull(), F.concat(F.lit("Candidate "), seq, F.lit(" is ranked #"), rank.cast("string"))),
        ],
        F.concat(F.lit("Candidate "), seq, F.lit(" covers "), timestamp_label(F.col("t_ms")), F.lit(" but has no final prediction")),
    )
    return (
        summary.join(wide, CAND, "left")
        .join(listed, CAND, "left")
        .select(
            "source_id", "moment_id", "candidate_seq", "covering",
            F.when(F.col("candidate_seq").isNotNull(), F.coalesce("in_shortlist", F.lit(False))).alias("in_shortlist"),
            *[f"{s}_rank" for s in scorers], *[f"{s}_score" for s in scorers],
            message.alias("message"),
        )
    )


def _sec2(ms: Column) -> Column:
    return F.format_string("%.2f", ms / 1000.0)


def refine_boundaries(
    spans: DataFrame, segments: DataFrame, lengths: DataFrame,
    max_shift_ms: int = 5_000, pre_ms: int = 500, post_ms: int = 500,
) -> DataFrame:
    """Move span edges to phrase edges: a cut phrase is kept whole where that is near,
    long silence is trimmed, and the result stays inside the source where its length is
    known. Spans of a source without segments are only clipped."""
    seg = segments.select("source_id", "segment_id", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"))
    info = F.struct("segment_id", "s0", "s1")

    def holding(edge: str) -> DataFrame:
        at = spans.select(*CAND, F.col(edge).alias("t0"), F.col(edge).alias("t1"))
        return (
            interval_join(at, seg, "source_id", ("t0", "t1"), ("s0", "s1"), closed=True)
            .groupBy(*CAND)
            .agg(F.min(info).alias(f"at_{edge[:-3]}"))
        )

    near = asof(spans.select(*CAND, "start_ms", "end_ms"), seg, "source_id", "start_ms", "s0", info, "next", forward=True)
    near = asof(near, seg, "source_id", "end_ms", "s1", info, "prev")
    near = asof(near, seg, "source_id", "end_ms", "s1", info, "prior", strict=True)
    rows = (
        near.join(holding("start_ms"), CAND, "left")
        .join(holding("end_ms"), CAND, "left")
        .join(lengths.select("source_id", "duration_ms"), "source_id", "left")
    )
    # any segment of the source is after the start, before the end, or around both
    silent = F.col("next").isNull() & F.col("prev").isNull() & F.col("at_start").isNull()
    start, end, length = F.col("start_ms"), F.col("end_ms"), F.col("duration_ms")
    cut_in = start - F.col("at_start.s0")
    lead = F.col("next.s0") - start
    held = F.col("at_start").isNotNull()
    zero = F.lit(0)
    new_start = first_match(
        [
            (held & (cut_in <= max_shift_ms), F.greatest(zero, F.col("at_start.s0") - pre_ms)),
            (held, F.greatest(zero, start - max_shift_ms)),
            (lead > 1000, F.greatest(start, F.col("next.s0") - pre_ms)),
            (lead > 0, F.greatest(zero, F.col("next.s0") - pre_ms)),
        ],
        start,
    )
    start_note = first_match(
        [
            (
                held & (cut_in <= max_shift_ms),
                F.concat(F.lit("snapped start earlier by "), _sec2(cut_in), F.lit("s to phrase start ("), _sec2(F.col("at_start.s0")), F.lit("s)")),
            ),
            (held, F.lit(f"shifted start earlier by max {max_shift_ms / 1000:.1f}s towards phrase start")),
            (
                lead > 1000,
                F.concat(F.lit("trimmed "), _sec2(lead), F.lit("s leading silence to "), _sec2(F.col("new_start")), F.lit("s")),
            ),
            (lead > 0, F.concat(F.lit("aligned start to phrase onset ("), _sec2(F.col("next.s0")), F.lit("s)"))),
        ],
        F.lit(None).cast("string"),
    )
    kept = F.col("at_end").isNotNull()
    cut_off = F.col("at_end.s1") - end
    trail = end - F.col("prev.s1")
    room = F.coalesce(F.col("prior.s1") - F.col("new_start") >= 15_000, F.lit(False))
    new_end = first_match(
        [
            (kept & (cut_off <= max_shift_ms), F.least(length, F.col("at_end.s1") + post_ms)),
            (kept & room, F.least(length, F.col("prior.s1") + post_ms)),
            (kept, F.least(length, end + max_shift_ms)),
            (trail > 1000, F.least(end, F.col("prev.s1") + post_ms)),
        ],
        end,
    )
    end_note = first_match(
        [
            (
                kept & (cut_off <= max_shift_ms),
                F.concat(F.lit("extended end by "), _sec2(cut_off), F.lit("s to complete phrase ("), _sec2(F.col("at_end.s1")), F.lit("s)")),
            ),
            (
                kept & room,
                F.concat(F.lit("trimmed cutoff phrase at end to previous phrase completion ("), _sec2(F.col("prior.s1")), F.lit("s)")),
            ),
            (kept, F.lit(f"extended end by max {max_shift_ms / 1000:.1f}s towards phrase end")),
            (
                trail > 1000,
                F.concat(F.lit("trimmed "), _sec2(trail), F.lit("s trailing silence to "), _sec2(F.col("new_end")), F.lit("s")),
            ),
        ],
        F.lit(None).cast("string"),
    )
    final_start = F.greatest(zero, F.least(F.col("new_start"), F.when(silent, length).otherwise(length - 1000)))
    notes = F.array_join(F.array_compact(F.array("start_note", "end_note")), "; ")
    return (
        rows.withColumn("new_start", new_start)
        .withColumn("start_note", start_note)
        .withColumn("new_end", new_end)
        .withColumn("end_note", end_note)
        .withColumn("refined_start_ms", final_start)
        .select(
            *CAND,
            "refined_start_ms",
            F.greatest(F.col("refined_start_ms") + 1000, F.least("new_end", length)).alias("refined_end_ms"),
            F.when(silent, "No transcript segments available").when(notes == "", "boundaries preserved").otherwise(notes).alias("reason"),
        )
    )


def _units(min_ms: int, texts: bool) -> Work:
    """A list per field of a unit, by candidate."""

    def work(met: Met) -> dict[str, pa.Array]:
        c0, c1 = (longs(met.cands, c)[met.cand] for c in ("start_ms", "end_ms"))
        start, end = np.maximum(longs(met.segs, "start_ms")[met.seg], c0) - c0, np.minimum(longs(met.segs, "end_ms")[met.seg], c1) - c0
        order = np.lexsort((longs(met.segs, "segment_id")[met.seg], start, met.cand))
        order = order[(end - start >= min_ms)[order]]
        of, seg, start, end = met.cand[order], met.seg[order], start[order], end[order]
        next_too = np.append(of[1:] == of[:-1], False)[: len(of)]
        gap = np.where(next_too, np.append(start[1:], 0)[: len(of)] - end, 0)
        fresh = np.append(False, next_too[:-1] & (gap[:-1] > RUN_GAP_MS))[: len(of)]
        edges, runs = counted(of, len(met.cands)), np.cumsum(fresh)
        begin = runs[edges[:-1][of]] if len(of) else runs
        ended = pc.or_kleene(met.segs["ends"].take(pa.array(seg)).combine_chunks(), pa.array(gap >= RUN_GAP_MS))
        values = {"unit_start": pa.array(start), "unit_end": pa.array(end), "terminal": ended, "gap_after": pa.array(np.maximum(0, gap)), "run": pa.array(runs - begin)}
        if texts:
            values["unit_text"] = met.segs["text"].take(pa.array(seg)).combine_chunks()
        return {name: lists(edges, v) for name, v in values.items()}

    return work


UNIT_FIELDS = "unit_start array<long>, unit_end array<long>, terminal array<boolean>, gap_after array<long>, run array<long>"


def unit_segments(segments: DataFrame, texts: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Segments as ``_units`` takes them: whether each ends a thought, the text where wanted."""
    text = F.trim("text")
    return segments.select("source_id", "segment_id", "start_ms", "end_ms", *keep, text.rlike(TERMINAL_PATTERN).alias("ends"), *([text.alias("text")] if texts else []))


def speech_units(cands: DataFrame, segments: DataFrame, min_ms: int = 150, block_ms: int = DAY_MS) -> DataFrame:
    """Segments clipped to the candidate and re-based to it, with the pause after each,
    whether it ends a thought, and which uninterrupted run it belongs to."""
    rows = beside(cands.select(*CAND, "start_ms", "end_ms"), unit_segments(segments), ("start_ms", "end_ms"), UNIT_FIELDS + ", unit_text array<string>", _units(min_ms, True), block_ms)
    units = F.arrays_zip("unit_start", "unit_end", "unit_text", "terminal", "gap_after", "run")
    return rows.select(*CAND, F.posexplode(units).alias("unit", "u")).select(
        *CAND,
        F.col("unit").cast("long").alias("unit"),
        F.col("u.unit_start").alias("start_ms"),
        F.col("u.unit_end").alias("end_ms"),
        F.col("u.unit_text").alias("text"),
        F.col("u.terminal").alias("terminal"),
        F.col("u.gap_after").alias("gap_after_ms"),
        F.col("u.run").alias("run_index"),
    )


def burst_transcript(bursts: DataFrame, segments: DataFrame, pad_ms: int = 750) -> DataFrame:
    """Distinct texts heard during each padded burst, in the order first heard.

    ``bursts``: source_id, candidate_seq, burst, start_ms, end_ms (source time).
    """
    padded = bursts.select(
        *CAND, "burst",
        F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("b0"), (F.col("end_ms") + pad_ms).alias("b1"),
    )
    met = interval_join(padded, segments.where(F.trim("text") != ""), "source_id", ("b0", "b1"), ("start_ms", "end_ms"), closed=True)
    texts = met.groupBy(*CAND, "burst").agg(
        F.array_join(
            F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("segment_id", F.trim("text").alias("t")))), lambda r: r["t"])), " "
        ).alias("text")
    )
    return padded.select(*CAND, "burst").join(texts, [*CAND, "burst"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def retrieval_provenance(
    preds: DataFrame, cands: DataFrame, shortlist: DataFrame, input_scorer: str, upstream: Sequence[str]
) -> DataFrame:
    """Where each reranked candidate came from: its place with every upstream scorer."""
    wide = preds.groupBy(*CAND).agg(
        *[F.max(F.when(F.col("scorer") == s, F.col("rank"))).alias(f"{s}_rank") for s in upstream],
        *[F.max(F.when(F.col("scorer") == s, F.col("score"))).alias(f"{s}_score") for s in upstream],
        F.max(F.when(F.col("scorer") == input_scorer, F.col("rank"))).alias("input_rank"),
        F.max(F.when(F.col("scorer") == input_scorer, F.col("score"))).alias("input_score"),
    )
    listed = shortlist.select(*CAND).distinct().withColumn("in_retrieval_shortlist", F.lit(True))
    return (
        wide.where(F.col("input_rank").isNotNull())
        .join(cands.select(*CAND), CAND, "left_semi")
        .join(listed, CAND, "left")
        .withColumn("in_retrieval_shortlist", F.coalesce("in_retrieval_shortlist", F.lit(False)))
    )


def pending_requests(requests: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Requests whose answer is not stored yet (all of them under ``force``)."""
    return requests if force else requests.join(cache.select("request_hash").distinct(), "request_hash", "left_anti")


def cache_usage(requests: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    known = cache.select("request_hash").distinct().withColumn("_hit", F.lit(not force))
    hit = F.coalesce("_hit", F.lit(False)).cast("long")
    return (
        requests.join(known, "request_hash", "left")
        .groupBy("stage")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(hit).alias("cache_hits"), F.sum(1 - hit).alias("cache_misses"))
    )


def pending_transcripts(requests: DataFrame, transcripts: DataFrame, limit: int | None = None) -> DataFrame:
    """Handoff requests for which no transcript has arrived; with ``limit``, the oldest."""
    waiting = requests.join(transcripts.select("source_id").distinct(), "source_id", "left_anti")
    return waiting if limit is None else waiting.orderBy("requested_at", "source_id").limit(limit)


def verify_replicas(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Whether each local object has a true copy, and why not."""
    r = remote.select("key", F.col("bytes").alias("remote_bytes"), F.col("sha").alias("remote_sha"), F.lit(True).alias("_there"))
    rows = local.join(r, "key", "left")
    sizes = (F.col("bytes") != 0) & (F.col("remote_bytes") != F.col("bytes"))
    shas = F.col("sha").isNotNull() & F.col("remote_sha").isNotNull() & (F.col("sha") != F.col("remote_sha"))
    reason = first_match(
        [
            (F.col("key") == "", "no remote key recorded"),
            (F.col("_there").isNull(), "remote object missing"),
            (sizes, F.concat(F.lit("remote size "), F.col("remote_bytes").cast("string"), F.lit(" != local "), F.col("bytes").cast("string"))),
            (shas, "remote sha256 differs"),
        ],
        F.col("key"),
    )
    return rows.select(
        "key",
        ((F.col("key") != "") & F.col("_there").isNotNull() & ~sizes & ~F.coalesce(shas, F.lit(False))).alias("verified"),
        reason.alias("reason"),
        F.coalesce((F.col("remote_bytes") == F.col("bytes")) & F.col("sha").eqNullSafe(F.col("remote_sha")), F.lit(False)).alias("skip_publish"),
    )


def evidence_packages(
    cands: DataFrame, segments: DataFrame, chapters: DataFrame, signals: DataFrame, frames: DataFrame, version: str = "package_v1_1"
) -> DataFrame:
    """One wide row per candidate with everything known about it, and its content hash.

    ``signals``: source_id, candidate_seq and any columns, kept as one struct;
    ``frames``: source_id, candidate_seq, decoded (usable sample frames)."""
    from clipspark.functions.exprs import digest

    around = surrounding_context(cands, segments)
    home = assign_chapter(cands, chapters).select(*CAND, "chapter")
    facts = signals.select(*CAND, F.struct(*[c for c in signals.columns if c not in CAND]).alias("signals"))
    rows = (
        cands.join(around, CAND)
        .join(home, CAND, "left")
        .join(facts, CAND, "left")
        .join(frames.select(*CAND, "decoded"), CAND, "left")
    )
    thin = F.coalesce(F.col("decoded"), F.lit(0)) < 4
    return rows.withColumn("insufficient_visual_evidence", thin).withColumn(
        "package_hash",
        digest(
            F.lit(version), F.col("source_id"), F.col("candidate_seq"), F.col("start_ms"), F.col("end_ms"), F.col("text"),
            F.col("previous_context"), F.col("next_context"), F.col("chapter"), F.coalesce("decoded", F.lit(0)), sep=":",
        ),
    )
