"""Long repeats by recompression.

A text starts as the names of its words. Each round first names runs of equal symbols,
then splits the alphabet in two halves by a bit of the name and names every pair of a
left symbol followed by a right symbol. A name is computed from the names inside it, so
naming is global without a dictionary: equal symbols have equal names in every task.

What a symbol becomes depends on itself and its neighbours only. The code tracks this: for
every symbol it keeps the interval of words that its parse depends on. A symbol whose
interval lies inside a window of ``window`` words is therefore the same in each
occurrence of the window, wherever it stands. Each window is filed under the interior
symbol with the smallest name, by the number of the words on which that symbol depends (a
window without interior symbols by its own number). So two equal windows always meet under
one name, a name stands for many words, and neighbouring windows share it:

1. count the names; only names seen twice can hold a repeat;
2. among those, equal stretches (all words of the neighbouring windows filed under one
   occurrence) are repeats as a whole;
3. where a name has different stretches, the numbers of their single windows are compared,
   one stretch of each kind.

Numbers have 64 bits. Counts are combined before the shuffle, so a passage that a third of
all documents share is one row per task; the joins are plain ones that Spark may split.

Defined results: null and empty texts have no words and lose none; texts under ``window``
words lose none; a repeated row repeats all its windows, so it loses them all in each
place; rows are told apart by id and text together, null ids included."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import pick, written
from .words import Words, mix, runs, words

WINDOW = 35
ROUNDS = 3
LONGEST_SYMBOL = 12
_NONE = np.uint64(2**64 - 1)


def _neighbours(row: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol, where its left neighbour's interval begins and its right
    neighbour's ends; at a text's edge one word beyond it, which no window has."""
    left, right = start - 1, end + 1
    if len(row) > 1:
        same = row[1:] == row[:-1]
        left[1:] = np.where(same, low[:-1], left[1:])
        right[:-1] = np.where(same, high[1:], right[:-1])
    return left, right


def symbols(part: Words, rounds: int = ROUNDS, longest: int = LONGEST_SYMBOL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of the symbols after the last round; low:high are the words on
    which a symbol's parse depends."""
    name, n = part.number, len(part.number)
    start, row = np.arange(n), part.row_of()
    end = start + 1
    low, high = start.copy(), end.copy()
    for r in range(rounds):
        if not len(name):
            break
        # runs of equal symbols
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(name)) - 1
        count = last - first + 1
        left, right = _neighbours(row, low, high, start, end)
        low, high = np.repeat(np.minimum(left[first], low[first]), count), np.repeat(np.maximum(right[last], high[last]), count)
        joined = (count > 1) & (end[last] - start[first] <= longest)
        if joined.any():
            name = name.copy()
            name[first[joined]] = mix(name[first[joined]] * np.uint64(2 * r + 3) + count[joined].astype(np.uint64))
            end[first[joined]] = end[last[joined]]
            keep = new | ~np.repeat(joined, count)
            name, start, end, low, high, row = (x[keep] for x in (name, start, end, low, high, row))
        # pairs of a left and a right symbol
        is_left = mix(name + np.uint64(r + 1)) >> np.uint64(63) == 1
        pair = np.zeros(len(name), bool)
        pair[:-1] = is_left[:-1] & ~is_left[1:] & (row[:-1] == row[1:]) & (end[1:] - start[:-1] <= longest)
        at = np.flatnonzero(pair)
        left, right = _neighbours(row, low, high, start, end)
        low, high = np.where(is_left, low, np.minimum(low, left)), np.where(is_left, np.maximum(high, right), high)
        name = name.copy()
        name[at] = mix(name[at] * np.uint64(0xD6E8FEB86659FD93) + name[at + 1] * np.uint64(0xA0761D6478BD642F) + np.uint64(r))
        end[at], low[at], high[at] = end[at + 1], np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        keep = np.ones(len(name), bool)
        keep[at + 1] = False
        name, start, end, low, high, row = (x[keep] for x in (name, start, end, low, high, row))
    return name, low, high


def filed(part: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, name, stretch number) of all stretches of windows."""
    n = len(part.number)
    first_word = np.arange(n - window + 1) if n >= window else np.zeros(0, np.int64)
    if not len(first_word):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    inside = first_word + window <= np.repeat(part.first[1:], part.counts)[: len(first_word)]
    name, low, high = symbols(part)
    fits = (high - low <= window) & (low >= 0)
    name, low, high = name[fits], low[fits], high[fits]
    # where several intervals begin at one word the shortest is in every window that has another
    order = np.lexsort((name, high - low, low))
    order = order[np.append(True, low[order][1:] != low[order][:-1])] if len(order) else order
    value, need = np.full(n, _NONE), np.full(n, window + 1)
    value[low[order]], need[low[order]] = name[order], high[order] - low[order]
    best, where = np.full(len(first_word), _NONE), np.full(len(first_word), -1)
    for k in range(window):
        v = np.where(need[k : k + len(best)] <= window - k, value[k : k + len(best)], _NONE)
        better = v < best
        best[better] = v[better]
        where[better] = first_word[better] + k
    alone = where < 0
    where[alone] = -2 - first_word[alone]  # a stretch of its own
    first_word, best, where, alone = first_word[inside], best[inside], where[inside], alone[inside]
    if not len(first_word):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    new = np.append(True, (where[1:] != where[:-1]) | (first_word[1:] != first_word[:-1] + 1))
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(first_word)))
    starts = first_word[at]
    stretch = runs(part.number, starts, starts + count + window - 1)
    seat = np.where(alone[at], starts, where[at])
    return starts, count, runs(part.number, seat, seat + np.where(alone[at], window, need[seat])), stretch


def occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(name, stretch, rid, at, n): all stretches of all texts; ``docs`` has rid, text."""
    schema = T.StructType().add("name", "long").add("stretch", "long").add("rid", "long").add("at", "integer").add("n", "integer")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for part in words(batch.column(1), "spaced"):
                starts, n, name, stretch = filed(part, window)
                row = np.searchsorted(part.first, starts, "right") - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(name.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(rid[part.rows][row]),
                    pa.array((starts - part.first[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                ], names=schema.fieldNames())

    return pick(docs, "rid", "text").mapInArrow(task, schema)


def stretch_windows(docs: DataFrame, window: int) -> DataFrame:
    """(rid, at, number, known): the single windows of the stretches listed with each text."""
    schema = T.StructType().add("rid", "long").add("at", "integer").add("number", "long").add("known", "boolean")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, spans = batch.column(0).to_numpy(), batch.column(2)
            for part in words(batch.column(1), "spaced"):
                mine = spans.slice(part.rows.start, part.rows.stop - part.rows.start)
                flat = mine.flatten()
                per_row = np.diff(np.asarray(mine.offsets))
                at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
                known = flat.field("known").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(per_row)), per_row)
                first = np.repeat(at + part.first[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, known = np.repeat(row, n), np.repeat(known, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid[part.rows][row]), pa.array((first - part.first[row]).astype(np.int32)),
                    pa.array(runs(part.number, first, first + window).view(np.int64)), pa.array(known),
                ], names=schema.fieldNames())

    return docs.select("rid", "text", "spans").mapInArrow(task, schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, at, n): first words at:at + n of windows that also start elsewhere, for docs
    with columns rid (of type long, equal only for equal rows) and text."""
    found = occurrences(docs, window)
    # written, so that the join's sides are plain exchanges, which Spark may split
    twice = written(found.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name"))
    found = written(found.join(twice, "name", "left_semi"))
    kinds = written(found.groupBy("name", "stretch").agg(F.count("*").alias("c"), F.min(F.struct("rid", "at", "n")).alias("one")))
    whole = found.join(kinds.filter("c > 1").select("name", "stretch"), ["name", "stretch"], "left_semi").select("rid", "at", "n")
    mixed = kinds.groupBy("name").agg(F.count("*").alias("k")).filter("k > 1").select("name")
    ones = kinds.join(mixed, "name", "left_semi").select(F.col("one.rid").alias("rid"), F.struct(F.col("one.at").alias("at"), F.col("one.n").alias("n"), (F.col("c") > 1).alias("known")).alias("span"))
    per_text = ones.groupBy("rid").agg(F.collect_list("span").alias("spans"))
    texts = docs.select("rid", "text").join(per_text, "rid")
    single = written(stretch_windows(texts, window))
    again = written(single.groupBy("number").agg(F.count("*").alias("c"), F.min("known").alias("all_known")).filter("c > 1 and not all_known").select("number"))
    part = single.filter("not known").join(again, "number", "left_semi").select("rid", "at", F.lit(1).alias("n"))
    return whole.union(part)


REMOVAL = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept", "string")


def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept) of every row; kept words are joined by a space."""
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("rid"), F.col(f"`{text}`").alias("text"))
    spans = repeated_spans(docs, window).groupBy("rid").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    joined = docs.join(spans, "rid", "left").select("doc_id", "text", "spans")
    schema = T.StructType([docs.schema["doc_id"], *REMOVAL.fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words(batch.column(1), "spaced"):
                mine = batch.column(2).slice(part.rows.start, part.rows.stop - part.rows.start)
                flat = mine.flatten()
                rows = np.repeat(np.arange(len(mine)), mine.value_lengths().fill_null(0).to_numpy())
                edge = np.zeros(len(part.number) + 1, np.int64)
                first = flat.field("at").to_numpy() + part.first[rows]
                np.add.at(edge, first, 1)
                np.add.at(edge, first + flat.field("n").to_numpy() + window - 1, -1)
                stay = np.cumsum(edge)[:-1] == 0
                raw, kept = part.buffer.tobytes(), []
                begin, end = part.begin.tolist(), part.end.tolist()
                gone = np.add.reduceat(np.append(~stay, False), np.minimum(part.first[:-1], len(stay))) * (part.counts > 0) if len(part.first) > 1 else []
                for a, b in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
                    kept.append(b" ".join([raw[begin[i] : end[i]] for i in (np.flatnonzero(stay[a:b]) + a).tolist()]).decode())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.rows.start, part.rows.stop - part.rows.start), pa.array(part.counts.astype(np.int64)),
                    pa.array(np.asarray(gone, np.int64)), pa.array(kept, pa.string()),
                ], names=schema.fieldNames())

    return joined.mapInArrow(task, schema).withColumnRenamed("doc_id", key)


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return without_repeats(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
