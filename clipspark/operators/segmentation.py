"""Cutting transcripts into candidate windows, chapters and caption cards."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import digest, pin
from clipspark.operators.intervals import interval_join
from clipspark.operators.blocks import DAY_MS, block_links, block_of, number_rows, with_lookahead
from clipspark.operators.chains import reach
from clipspark.operators.cutting import Piece, Units, cut, entries
from clipspark.operators.stages import materialise

SEGMENTATION_VERSION = "1.0.0"
MIN_ADVANCE_S = 10.0
TAIL_SHARE = 0.6


def _ms(value: float) -> int:
    return int(round(value * 1000))


def _read_windows(target: int, reach: int, advance: int, least: int, width: int):
    """Segments of blocks, and the window that would start at each of them. It looks ahead
    ``reach`` by start time only; the next window may start beyond that, after a silence."""

    def read(rows: pa.Table, edges: list[int]) -> Units:
        pos, s, e = (rows[c].to_pylist() for c in ("segment_id", "start_ms", "end_ms"))
        low, high = edges[:-1], edges[1:]
        seen = np.concatenate([[0], np.cumsum(rows["halo"].to_numpy())])
        own = [h - int(seen[h] - seen[k]) for k, h in zip(low, high)]
        block = rows["block"].to_pylist()

        def piece(i: int, n: int) -> tuple[int, int]:
            limit, goal, later = s[i] + reach, s[i] + target, s[i] + advance
            end = i + 1
            while end < n and s[end] <= limit and e[end] < goal:
                end += 1
            if end < n and s[end] <= limit and e[end] <= limit:
                end += 1
            if end >= n:
                return n, -1
            onward = i + 1
            while onward < n and s[onward] < later and s[onward] <= limit:
                onward += 1
            return end, onward if onward < n else -1

        def counted(i: int, end: int, n: int) -> bool:
            span = e[end - 1] - s[i]
            return span >= least or (end >= n and span >= least * TAIL_SHARE)

        doors = [bisect_left(s, block[k] * width + advance, k, o) + 1 for k, o in zip(low, own)]
        return Units(pos, [x // width for x in s], low, own, high, doors, piece, counted)

    return read


def _emit_windows(rows: pa.Table, units: Units, pieces: list[Piece]) -> pa.Table:
    texts = rows["text"].to_pylist()
    first = pa.array([p.first for p in pieces], pa.int64())
    last = pa.array([p.end - 1 for p in pieces], pa.int64())
    return pa.table(
        {
            "source_id": rows["source_id"].take(first),
            "candidate_seq": pa.array([p.number for p in pieces], pa.int64()),
            "start_ms": rows["start_ms"].take(first),
            "end_ms": rows["end_ms"].take(last),
            "segment_ids": pa.array([units.pos[p.first : p.end] for p in pieces], pa.list_(rows["segment_id"].type)),
            "text": pa.array([" ".join(texts[p.first : p.end]) for p in pieces], pa.string()),
        }
    )


def candidate_windows(
    segments: DataFrame,
    min_seconds: float = 30.0,
    target_seconds: float = 60.0,
    max_seconds: float = 90.0,
    overlap_seconds: float = 15.0,
    block_ms: int = DAY_MS,
) -> DataFrame:
    """Overlapping candidate windows on segment boundaries, numbered per source.

    ``segments``: source_id, segment_id, start_ms, end_ms, text, in speech order.
    """
    if not 0 < min_seconds <= target_seconds <= max_seconds:
        raise ValueError("need 0 < min <= target <= max")
    reach_ms, advance = _ms(max_seconds), _ms(max(MIN_ADVANCE_S, target_seconds - overlap_seconds))
    spoken = segments.select("source_id", "segment_id", "start_ms", "end_ms", F.trim("text").alias("text")).where(F.col("text") != "")
    # asked of all segments first, for which no text has to travel
    links = block_links(segments, ["source_id"], "start_ms", block_ms)
    links = None if links is None else block_links(spoken, ["source_id"], "start_ms", block_ms)
    order = ["start_ms", "segment_id"]
    rows = with_lookahead(spoken, ["source_id"], "start_ms", order, block_ms, reach_ms + 1, rows=1, links=links)
    read = _read_windows(_ms(target_seconds), reach_ms, advance, _ms(min_seconds), block_ms)
    known = None if links is None else entries(rows.drop("text"), links, order, {}, read)
    types = {f.name: f.dataType.simpleString() for f in spoken.schema}
    schema = (
        f"source_id {types['source_id']}, candidate_seq bigint, start_ms {types['start_ms']}, end_ms {types['end_ms']}, "
        f"segment_ids array<{types['segment_id']}>, text string"
    )
    windows = cut(rows, known, order, {}, read, _emit_windows, schema)
    if known is not None:
        # sources of several blocks in which nothing qualified: one window over everything said
        parts = F.sort_array(F.collect_list(F.struct("segment_id", "text")))
        whole = (
            spoken.join(known.where("total = 0").select("source_id").distinct(), "source_id", "left_semi")
            .groupBy("source_id")
            .agg(
                F.min_by("start_ms", "segment_id").alias("start_ms"),
                F.max_by("end_ms", "segment_id").alias("end_ms"),
                parts.alias("parts"),
            )
            .select(
                "source_id", F.lit(1).cast("long").alias("candidate_seq"), "start_ms", "end_ms",
                F.col("parts.segment_id").alias("segment_ids"), F.array_join("parts.text", " ").alias("text"),
            )
        )
        windows = windows.unionByName(whole)
    return windows.select(
        "source_id",
        "candidate_seq",
        F.format_string("cand_%03d", F.col("candidate_seq")).alias("candidate_id"),
        "start_ms",
        "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        "segment_ids",
        "text",
    )


# Chapter, caption and digest rules.
SCENE_SNAP_MS = 2_000
TRUNCATION_MARK = "\n[... chapter transcript truncated ...]"
TERMINAL_MARKS = (".", "!", "?")
PAUSE_MARKS = (",", ":", ";", "—", "-")
BRIDGE_MS = 200


def transcript_hash(sources: DataFrame, segments: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """Digest of language, duration and all segments. Segments are digested per block
    and the block digests per source, so no task holds a whole long source."""
    line = F.concat_ws(":", F.col("segment_id"), F.concat_ws("-", F.col("start_ms"), F.col("end_ms")), F.col("text"))
    per_block = (
        segments.withColumn("block", block_of(F.col("start_ms"), block_ms))
        .groupBy("source_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("segment_id", line.alias("line")))).alias("lines"), F.count(F.lit(1)).alias("n"))
        .select("source_id", "block", "n", digest(F.array_join(F.transform("lines", lambda x: x["line"]), "|"), chars=64).alias("h"))
    )
    whole = per_block.groupBy("source_id").agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("block", "h"))).alias("hs")
    )
    return sources.join(whole, "source_id").select(
        "source_id",
        digest(F.col("language"), F.col("duration_ms"), F.col("n"), F.array_join(F.transform("hs", lambda x: x["h"]), "|")).alias(
            "transcript_hash"
        ),
    )


def candidate_set_id(
    hashes: DataFrame, min_s: float = 30.0, target_s: float = 60.0, max_s: float = 90.0, overlap_s: float = 15.0
) -> DataFrame:
    """Identity of a candidate set: its transcript's hash and the cutting parameters."""
    params = [F.lit(f"{v:.3f}") for v in (min_s, target_s, max_s, overlap_s)]
    return hashes.withColumn(
        "candidate_set_id",
        F.concat(F.lit("cset_"), digest(F.col("transcript_hash"), *params, F.lit(SEGMENTATION_VERSION))),
    )


def chapter_plan(
    segments: DataFrame,
    scenes: DataFrame | None = None,
    target_s: float = 240.0,
    min_s: float = 150.0,
    max_s: float = 420.0,
    pause_s: float = 0.6,
    block_ms: int = DAY_MS,
) -> DataFrame:
    """Contiguous chapters that close on a pause or scene cut after the target length,
    at the latest at the maximum; a short last chapter joins the one before."""
    reach_ms = _ms(max_s)
    flagged = segments.select("source_id", "segment_id", "start_ms", "end_ms")
    if scenes is not None:
        snapped = interval_join(
            flagged.select("source_id", "segment_id", (F.col("end_ms") - SCENE_SNAP_MS).alias("a"), (F.col("end_ms") + SCENE_SNAP_MS).alias("b")),
            scenes.select("source_id", F.col("t_ms").alias("ta"), F.col("t_ms").alias("tb")),
            "source_id", ("a", "b"), ("ta", "tb"), closed=True,
        ).select("source_id", "segment_id").distinct().withColumn("cut", F.lit(True))
        flagged = flagged.join(snapped, ["source_id", "segment_id"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    else:
        flagged = flagged.withColumn("cut", F.lit(False))
    links = block_links(segments, ["source_id"], "start_ms", block_ms, rows=2)
    rows = with_lookahead(flagged, ["source_id"], "start_ms", ["start_ms", "segment_id"], block_ms, reach_ms + 1, rows=2, links=links)
    by_time = Window.partitionBy("source_id", "block").orderBy("start_ms", "segment_id")
    view = Window.partitionBy("source_id", "block").orderBy("start_ms").rangeBetween(0, reach_ms)
    me = F.struct(
        F.col("start_ms").alias("s"), F.col("segment_id").alias("id"), F.col("end_ms").alias("e"), "cut",
        F.greatest(F.lit(0), F.lead("start_ms").over(by_time) - F.col("end_ms")).alias("gap"),
        F.lead("segment_id").over(by_time).alias("next_id"),
        F.lead("start_ms").over(by_time).alias("next_s"),
    )
    elapsed_from = F.col("start_ms")

    def closes(x):
        long_enough = x["e"] - elapsed_from >= _ms(target_s)
        return (x["e"] - elapsed_from >= reach_ms) | (long_enough & ((x["gap"] >= _ms(pause_s)) | x["cut"]))

    seen = (
        rows.withColumn("me", me)
        .withColumn("then", F.lead("me").over(by_time))
        .withColumn("all", F.sort_array(F.collect_list(F.struct("me", "then")).over(view)))
        .where(~F.col("halo"))
    )
    # pinned steps: 31 task seconds at sf0.1 against 104 without
    seen = pin(seen, run=F.filter("all", lambda x: x["me"]["id"] >= F.col("segment_id"))).drop("all")
    seen = pin(seen, hit=F.get(F.filter("run", lambda x: closes(x["me"])), F.lit(0))["me"])
    seen = pin(seen, last=F.coalesce("hit", F.element_at("run", -1)["then"], F.element_at("run", -1)["me"])).drop("run")
    final = F.col("last.next_id").isNull()
    pointers = seen.select(
        "source_id",
        "block",
        F.col("segment_id").cast("long").alias("pos"),
        F.col("last.next_id").cast("long").alias("nxt"),
        block_of(F.col("last.next_s"), block_ms).alias("nxt_block"),
        "start_ms",
        F.col("last.e").alias("end_ms"),
        F.col("last.id").alias("last_id"),
        F.when(final, "transcript_gap")
        .when(F.col("last.e") - F.col("start_ms") >= reach_ms, "max_duration")
        .when(F.col("last.cut"), "scene_change")
        .otherwise("transcript_gap")
        .alias("boundary_source"),
    )
    cut = reach(materialise(pointers), ["source_id"], ["start_ms", "end_ms", "last_id", "boundary_source"])
    # one row per source: its last chapter, and whether it is short enough to merge
    ends = cut.groupBy("source_id").agg(
        F.max(F.struct("pos", "start_ms", "end_ms", "last_id")).alias("z"), F.count(F.lit(1)).alias("n")
    )
    short = (F.col("n") >= 2) & (F.col("z.end_ms") - F.col("z.start_ms") < _ms(min_s))
    merged = cut.join(ends.select("source_id", F.when(short, F.col("z")).alias("z")), "source_id")
    takes = F.coalesce(F.col("nxt") == F.col("z.pos"), F.lit(False))
    kept = merged.where(F.col("z").isNull() | (F.col("pos") != F.col("z.pos"))).select(
        "source_id", "block", "pos", "start_ms",
        F.when(takes, F.col("z.end_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(takes, F.col("z.last_id")).otherwise(F.col("last_id")).alias("last_segment"),
        F.when(takes, "tail_merge").otherwise(F.col("boundary_source")).alias("boundary_source"),
    )
    return number_rows(kept, ["source_id"], "block", [F.col("pos")], "chapter").select(
        "source_id", "chapter", F.format_string("chapter_%03d", F.col("chapter")).alias("chapter_id"),
        "start_ms", "end_ms", F.col("pos").alias("first_segment"), "last_segment", "boundary_source",
    )


def _tenths(ms):
    """Seconds at one decimal, by integer arithmetic."""
    t = F.floor((ms + 50) / 100)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def chapter_digest(chapters: DataFrame, segments: DataFrame, limit: int = 12_000) -> DataFrame:
    """What a chapter's reader is shown: timestamped lines, cut off with a marker
    beyond ``limit`` characters, and the hash of the whole chapter."""
    inside = interval_join(
        chapters.select("source_id", "chapter", "first_segment", "last_segment", F.col("start_ms").alias("c0"), F.col("end_ms").alias("c1")),
        segments, "source_id", ("c0", "c1"), ("start_ms", "end_ms"), closed=True,
    ).where(F.col("segment_id").between(F.col("first_segment"), F.col("last_segment")))
    line = F.concat(F.lit("["), _tenths(F.col("start_ms")), F.lit("s] "), F.col("text"))
    key = F.concat_ws(":", F.col("segment_id"), F.concat_ws("-", F.col("start_ms"), F.col("end_ms")), F.col("text"))
    grouped = inside.groupBy("source_id", "chapter", "c0", "c1").agg(
        F.sort_array(F.collect_list(F.struct("segment_id", line.alias("line"), key.alias("key")))).alias("rows")
    )
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return grouped.withColumn("full", text).select(
        "source_id",
        "chapter",
        F.size("rows").cast("long").alias("segments"),
        F.when(F.length("full") > limit, F.concat(F.substring("full", 1, limit), F.lit(TRUNCATION_MARK)))
        .otherwise(F.col("full"))
        .alias("shown"),
        digest(F.col("c0"), F.col("c1"), F.size("rows"), F.array_join(F.transform("rows", lambda r: r["key"]), "|")).alias("chapter_hash"),
    )


def plan_hash(digests: DataFrame) -> DataFrame:
    """Identity of a source's chapter plan, from its chapters' hashes in order."""
    part = F.floor(F.col("chapter") / 1000)
    per_part = digests.groupBy("source_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("chapter", "chapter_hash"))).alias("hs")
    )
    joined = F.array_join(F.transform("hs", lambda x: x["chapter_hash"]), "|")
    return (
        per_part.select("source_id", "part", digest(joined).alias("h"))
        .groupBy("source_id")
        .agg(digest(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "|")).alias("plan_hash"))
    )


def _read_cards(max_words: int, max_chars: int, pause: int, width: int):
    """Words of blocks, and the card that would start at each of them."""

    def read(rows: pa.Table, edges: list[int]) -> Units:
        size = pc.list_value_length(rows["said"]).fill_null(0).to_numpy()
        upto = np.concatenate([[0], np.cumsum(size)])
        word = pc.list_flatten(rows["said"])
        chars = pc.utf8_length(word).fill_null(0).to_numpy().tolist()

        def ends_with(marks):
            found = np.zeros(len(word), bool)
            for m in marks:
                found |= pc.ends_with(word, m).fill_null(False).to_numpy()
            return found.tolist()

        stop, comma = ends_with(TERMINAL_MARKS), ends_with(PAUSE_MARKS)
        s, e = pc.list_flatten(rows["begins"]), pc.list_flatten(rows["ends"])
        silent = np.zeros(len(word), bool)
        silent[:-1] = pc.greater_equal(pc.subtract(s.slice(1), e.slice(0, max(len(e) - 1, 0))), pause).fill_null(False).to_numpy()
        silent = silent.tolist()
        pos = pc.list_flatten(rows["places"]).to_pylist()
        block = np.repeat(rows["start_ms"].to_numpy() // width, size).tolist()
        low, high = upto[edges[:-1]].tolist(), upto[edges[1:]].tolist()
        ahead = np.concatenate([[0], np.cumsum(np.where(rows["halo"].to_numpy(), size, 0))])
        own = [h - int(ahead[b] - ahead[a]) for a, b, h in zip(edges, edges[1:], high)]

        def piece(i: int, n: int) -> tuple[int, int]:
            total, last = 0, min(i + max_words, n)
            for j in range(i, last):
                total += chars[j]
                if stop[j] or silent[j] or (comma[j] and j > i) or total + j - i >= max_chars:
                    last = j + 1
                    break
            return last, last if last < n else -1

        return Units(pos, block, low, own, high, [k + max_words for k in low], piece, lambda i, end, n: True)

    return read


def _emit_cards(rows: pa.Table, units: Units, pieces: list[Piece]) -> pa.Table:
    first = np.array([p.first for p in pieces], np.int64)
    end = np.array([p.end for p in pieces], np.int64)
    high = np.array(units.high, np.int64)[[p.k for p in pieces]]
    offsets = np.concatenate([[0], np.cumsum(end - first)])
    held = pa.array(np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], end - first))
    columns = [pc.list_flatten(rows[c]).combine_chunks() for c in ("places", "begins", "ends", "said")]
    words = pa.StructArray.from_arrays([c.take(held) for c in columns], ["pos", "s", "e", "word"])
    line = np.searchsorted(np.cumsum(pc.list_value_length(rows["said"]).fill_null(0).to_numpy()), first, "right")
    return pa.table(
        {
            "source_id": rows["source_id"].take(pa.array(line)),
            "card": pa.array([p.number for p in pieces], pa.int64()),
            "start_ms": columns[1].take(pa.array(first)),
            "last_ms": columns[2].take(pa.array(end - 1)),
            "next_start_ms": columns[1].take(pa.array(end, mask=end >= high)),
            "words": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words),
        }
    )


def caption_cards(
    words: DataFrame, max_words: int = 4, max_chars: int = 32, pause_s: float = 0.35, min_s: float = 0.4,
    block_ms: int = DAY_MS, spread: dict[str, Column] | None = None,
) -> DataFrame:
    """Short subtitle cards: closed by sentence ends, pauses, or the size limits.

    ``words``: source_id, pos (order in the source), start_ms, end_ms, word. Or lines of one
    word or more (source_id, pos, start_ms and what else ``spread`` names), with ``spread``
    telling each line's words as arrays ``places``, ``begins``, ``ends``, ``said``. Only lines
    travel and are sorted; they are spread out where cards are cut, and cards leave the pass
    with their words.
    """
    if spread is None:
        spread = {k: F.array(c) for k, c in {"places": "pos", "begins": "start_ms", "ends": "end_ms", "said": "word"}.items()}
    links = block_links(words, ["source_id"], "start_ms", block_ms, rows=max_words + 1)
    rows = with_lookahead(words, ["source_id"], "start_ms", ["pos"], block_ms, 0, rows=max_words + 1, links=links)
    read = _read_cards(max_words, max_chars, _ms(pause_s), block_ms)
    known = None if links is None else entries(rows, links, ["pos"], spread, read)
    types = {f.name: f.dataType.simpleString() for f in words.withColumns(spread).schema}
    place, at, until, said = (types[c][len("array<") : -1] for c in ("places", "begins", "ends", "said"))
    schema = (
        f"source_id {types['source_id']}, card bigint, start_ms {at}, last_ms {until}, next_start_ms {at}, "
        f"words array<struct<pos: {place}, s: {at}, e: {until}, word: {said}>>"
    )
    cards = cut(rows, known, ["pos"], spread, read, _emit_cards, schema).withColumn(
        "end_ms", F.greatest("last_ms", F.col("start_ms") + _ms(min_s))
    )
    gap = F.col("next_start_ms") - F.col("end_ms")
    bridged = F.when((gap > 0) & (gap < BRIDGE_MS), F.col("next_start_ms")).otherwise(F.col("end_ms"))
    return cards.select(
        "source_id", "card", "start_ms", bridged.alias("end_ms"), F.array_join("words.word", " ").alias("text"), "words"
    )


def caption_word_spans(cards: DataFrame) -> DataFrame:
    """The span during which each word of a card is the active one."""
    n = F.size("words")
    flat = cards.select("source_id", "card", "start_ms", "end_ms", "words", n.alias("n"), F.posexplode("words").alias("i", "w"))
    begin = F.when(F.col("i") == 0, F.col("start_ms")).otherwise(F.col("w.s"))
    until = F.when(F.col("i") < F.col("n") - 1, F.get("words", F.col("i") + 1)["s"]).otherwise(F.col("end_ms"))
    return flat.select(
        "source_id", "card", F.col("i").cast("long").alias("word_idx"), F.col("w.word").alias("word"),
        begin.alias("begin_ms"), F.when(until <= begin, begin + 100).otherwise(until).alias("until_ms"),
    )


def candidate_stats(cands: DataFrame) -> DataFrame:
    d = F.col("duration_ms") / 1000.0
    return cands.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.min(d).alias("min_s"),
        F.round(F.sum("duration_ms") / (1000.0 * F.count(F.lit(1))), 2).alias("mean_s"),
        F.max(d).alias("max_s"),
    )
