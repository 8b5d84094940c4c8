"""Benchmark decontamination by Wu-Manber multi-pattern search over word numbers.

The test strings are all windows of ten consecutive benchmark words (an item of fewer
words is one window). For each window length a table gives, for every block of two words,
how far the search may jump because no window has that block any nearer to its end; a
jump of zero leads to the bucket of windows that end with the block, and a direct
comparison of all words confirms an occurrence.

The windows are cut into blocks of at most ``block_windows``; each block is one search
over the documents, and a table is written after every few, so what the driver and a task
hold is bounded however large the benchmark is.

Defined results: null or empty texts have no words and no hits; items without words match
nothing; equal windows of several items count for each of them; repeated rows get equal
results; null item ids are left out of the item lists; empty tables give no hits."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import free_name, map_text, pick, written
from .words import mix, words

WINDOW = 10
BLOCK_WINDOWS = 200_000
BLOCKS_AT_ONCE = 4
FIELDS = "n_words bigint, starts array<int>, ends array<int>, items array<string>"
_TABLE_BITS = 16
_LANE = 512


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id as text, numbers array<long>): the distinct windows of each item."""

    def work():
        def make(texts: pa.Array) -> dict[str, pa.Array]:
            out: list[list[np.ndarray]] = []
            for part in words(texts, "alnum_lower"):
                for a, b in zip(part.first[:-1], part.first[1:]):
                    n = min(window, b - a)
                    row = part.number[a:b].view(np.int64)
                    out.append([row[i : i + n] for i in range(b - a - n + 1)] if n else [])
            return {"windows": pa.array(out, pa.list_(pa.list_(pa.int64())))}

        return make

    found = map_text(benchmark, "windows array<array<bigint>>", work, keep=["item_id"])
    return found.select(F.col("item_id").cast("string").alias("item_id"), F.explode("windows").alias("numbers")).distinct()


class Search:
    """Windows of one length, ready to be searched for."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, self.m = patterns, patterns.shape[1]
        self.b = min(2, self.m)
        top = self.m - self.b + 1
        self.shift = np.full(1 << _TABLE_BITS, top, np.int64)
        for end in range(self.b, self.m + 1):  # later blocks allow shorter jumps only
            at = self.block(patterns[:, end - 1], patterns[:, end - self.b]) >> np.uint64(64 - _TABLE_BITS)
            self.shift[at] = np.minimum(self.shift[at], self.m - end)
        suffix = self.block(patterns[:, -1], patterns[:, self.m - self.b])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    @staticmethod
    def block(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return mix(last * np.uint64(0x2545F4914F6CDD1D) + first)

    def occurrences(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of each occurrence inside one row of ``first``.

        Lanes of bounded length advance together; each covers its own window ends."""
        begin, stop = first[:-1] + self.m - 1, first[1:]
        lanes = np.maximum(0, -(-(stop - begin) // _LANE))
        row = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = begin[row] + nth * _LANE
        end = np.minimum(at + _LANE, stop[row])
        found = []
        while len(at):
            jump = self.shift[self.block(number[at], number[at - self.b + 1]) >> np.uint64(64 - _TABLE_BITS)]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            left = at < end
            at, end = at[left], end[left]
        last = np.concatenate(found) if found else np.zeros(0, np.int64)
        key = self.block(number[last], number[last - self.b + 1])
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        n = high - low
        last, low = np.repeat(last, n), np.repeat(low, n)
        pattern = self.order[low + np.arange(len(last)) - np.repeat(np.cumsum(n) - n, n)]
        same = np.ones(len(last), bool)
        for k in range(self.m):
            same[same] = number[last[same] - k] == self.patterns[pattern[same], self.m - 1 - k]
        return last[same] - self.m + 1, pattern[same]


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted intervals without overlap that cover the same words."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]


def search_block(docs: DataFrame, windows: list[tuple[str, list[int]]], into: str, before: str | None, text: str = "text") -> DataFrame:
    """One search: append (or extend) the column ``into`` with the hits of these windows."""
    spark = docs.sparkSession
    by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, numbers in windows:
        by_length[len(numbers)][tuple(numbers)].add(item)
    held = spark.sparkContext.broadcast([(np.array(list(p), np.int64).view(np.uint64), [sorted(x for x in s if x is not None) for s in p.values()]) for p in by_length.values()])

    def work():
        searches = [(Search(p), items) for p, items in held.value]

        def make(texts: pa.Array) -> dict[str, pa.Array]:
            n, starts, ends, items = [], [], [], []
            for part in words(texts, "alnum_lower"):
                n.append(part.counts)
                size = len(part.counts)
                hits: dict[int, list] = defaultdict(lambda: [[], [], set()])
                for search, names in searches:
                    at, pattern = search.occurrences(part.number, part.first)
                    for row, a, p in zip(np.searchsorted(part.first, at, "right") - 1, at, pattern):
                        hits[row][0].append(a - part.first[row])
                        hits[row][1].append(a - part.first[row] + search.m)
                        hits[row][2].update(names[p])
                rows = [[], [], []]
                for row in range(size):
                    if row in hits:
                        s, e = _joined(np.array(hits[row][0]), np.array(hits[row][1]))
                        rows[0].append(s), rows[1].append(e), rows[2].append(sorted(hits[row][2]))
                    else:
                        rows[0].append(()), rows[1].append(()), rows[2].append(())
                starts += rows[0]
                ends += rows[1]
                items += rows[2]
            return {
                "n_words": pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()),
                "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string())),
            }

        return make

    new = free_name(docs, into)
    out = map_text(docs, FIELDS, work, text=text, into=new)
    if before is None:
        return out.withColumnRenamed(new, into)
    a, b = F.col(before), F.col(new)
    both = F.struct(a["n_words"].alias("n_words"), F.concat(a["starts"], b["starts"]).alias("starts"), F.concat(a["ends"], b["ends"]).alias("ends"), F.array_union(a["items"], b["items"]).alias("items"))
    return out.withColumn(before, both).drop(new)


def find_leaks(docs: DataFrame, benchmark: DataFrame, into: str = "leaks", text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, starts and ends (word intervals
    covered by hits, which may overlap if the benchmark needs several blocks) and items.
    A name that ``docs`` has already is refused."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"documents have a column {into} already")
    windows = item_windows(pick(benchmark, "item_id", "text"), window)
    total = windows.count()
    blocks = max(1, -(-total // block_windows))
    part = F.pmod(F.xxhash64("item_id", "numbers"), F.lit(blocks))
    out = docs
    for k in range(blocks):
        if k and k % BLOCKS_AT_ONCE == 0:  # searches in one stage hold their blocks together
            out = written(out)
        rows = [(r.item_id, r.numbers) for r in windows.filter(part == k).toLocalIterator()]
        out = search_block(out, rows, into, into if k else None, text)
    return out


def leak_digests(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    hits = find_leaks(pick(docs, "doc_id", "text"), benchmark, "leaks", window=window)
    span = F.arrays_zip(F.col("leaks.starts").alias("s"), F.col("leaks.ends").alias("e"))
    covered = F.aggregate(
        F.array_sort(span), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    return hits.select(
        "doc_id", F.col("leaks.n_words").alias("n_words"), covered.alias("n_hit"), F.size("leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leaks.items"), ","), 256).alias("items_sha256"), (F.size("leaks.starts") > 0).alias("contaminated"),
    )
