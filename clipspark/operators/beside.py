"""What is said beside candidates, in one sorted pass over the blocks of a timeline.

A candidate lies in the block in which its span begins; a segment is also placed in those
earlier blocks from which a span may reach it (the longest span tells how far that is). So
candidates meet their segments within a block, and nothing that was met is shuffled again.
Rows that lie by source already are not shuffled at all."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipspark.operators.blocks import DAY_MS, block_of

#: Pairs of a candidate and a segment that are looked at together, one whole candidate more aside.
PAIRS = 100_000


class Met(NamedTuple):
    """Some candidates and their segments. Pair ``k`` is row ``seg[k]`` of ``segs`` beside row
    ``cand[k]`` of ``cands``; pairs are in order of candidate, start and segment."""

    cands: pa.Table
    segs: pa.Table
    cand: np.ndarray
    seg: np.ndarray


Work = Callable[[Met], dict[str, pa.Array]]


def longs(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].cast(pa.int64()).fill_null(0).to_numpy()


def counted(of: np.ndarray, n: int) -> np.ndarray:
    """Edges of the runs of 0 to n - 1 in ``of``, which is sorted."""
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def lists(edges: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first of that row and the numbers after it), ``many`` of them for each row."""
    row = np.repeat(np.arange(len(many)), many)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks; holds the block that is not over and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        first = np.flatnonzero(batch.column("_n").to_numpy() == 1)
        if len(first):
            held.append(batch.slice(0, first[-1]))
            yield pa.Table.from_batches(held)
            held, batch = [], batch.slice(first[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _side(rows: pa.Table, mask: np.ndarray, name: str) -> pa.Table:
    part = rows.select([name]).filter(pa.array(mask)).flatten()
    return part.rename_columns([c.split(".", 1)[1] for c in part.column_names]).combine_chunks()


def _met(rows: pa.Table) -> Iterator[Met]:
    block = np.cumsum(rows["_n"].to_numpy() == 1)
    wanted = rows["_side"].to_numpy() == 1
    known = wanted & rows["_lo"].is_valid().to_numpy() & rows["_hi"].is_valid().to_numpy() & rows["source_id"].is_valid().to_numpy()
    low, high = longs(rows, "_lo"), longs(rows, "_hi")
    real = known | ~wanted
    base = int(min(low[real].min(), high[real].min())) if real.any() else 0
    width = int(max(low[real].max(), high[real].max())) - base + 2 if real.any() else 2
    # block after block on one scale; the latest end so far only grows
    starts, ends = (block * width + x - base for x in (low, high))
    begin, over = starts[~wanted], np.maximum.accumulate(ends[~wanted])
    first = np.where(known, np.searchsorted(over, starts, "right"), 0)[wanted]
    many = np.where(known, np.searchsorted(begin, ends, "left"), 0)[wanted] - first
    many = np.maximum(many, 0)
    cands, segs, last = _side(rows, wanted, "c"), _side(rows, ~wanted, "g"), high[~wanted]
    since, done = low[wanted], 0
    total = np.concatenate([[0], np.cumsum(many)])
    while done < len(many):
        to = max(done + 1, int(np.searchsorted(total, total[done] + PAIRS, "right")) - 1)
        cand, seg = spread(first[done:to], many[done:to])
        some = last[seg] > since[done:to][cand]
        yield Met(cands.slice(done, to - done), segs, cand[some], seg[some])
        done = to


def beside(cands: DataFrame, segments: DataFrame, span: tuple[str, str], fields: str, work: Work, block_ms: int = DAY_MS) -> DataFrame:
    """The rows of ``cands`` with the columns ``fields`` (DDL) that ``work`` makes of the segments
    meeting their span. ``segments``: source_id, segment_id, start_ms, end_ms, and what else
    ``work`` needs. A candidate without a source or an end has no segments."""
    lo, hi = (F.col(c) for c in span)
    edge = cands.agg(F.min(block_of(lo, block_ms)), F.max(block_of(lo, block_ms)), F.max(hi - lo)).first()
    low, high, far = (int(x) if x is not None else 0 for x in edge)
    start, end = F.col("start_ms"), F.col("end_ms")
    first, last = F.greatest(F.lit(low), block_of(start - far, block_ms)), F.least(F.lit(high), block_of(end, block_ms))
    types = [T.StructType(df.schema.fields) for df in (cands, segments)]
    # not as a filter, which would be pushed below the shuffle that candidates may share
    blocks = F.when(F.col("source_id").isNotNull() & start.isNotNull() & end.isNotNull() & (first <= last), F.sequence(first, last))
    said = segments.select(
        "source_id", F.explode(blocks).alias("block"), F.lit(0).alias("_side"), start.alias("_lo"), end.alias("_hi"),
        F.col("segment_id").alias("_id"), F.lit(None).cast(types[0]).alias("c"), F.struct(*segments.columns).alias("g"),
    )
    asked = cands.select(
        "source_id", F.coalesce(block_of(lo, block_ms), F.lit(0).cast("long")).alias("block"), F.lit(1).alias("_side"), lo.alias("_lo"), hi.alias("_hi"),
        F.lit(None).cast(segments.schema["segment_id"].dataType).alias("_id"), F.struct(*cands.columns).alias("c"), F.lit(None).cast(types[1]).alias("g"),
    )
    order = Window.partitionBy("source_id", "block").orderBy("_side", "_lo", "_id")
    rows = said.union(asked).withColumn("_n", F.row_number().over(order)).select("source_id", "_n", "_side", "_lo", "_hi", "c", "g")
    schema = T.StructType([*cands.schema.fields, *T.StructType.fromDDL(fields).fields])
    made = schema.fieldNames()[len(cands.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            for met in _met(table):
                out = work(met)
                for name in made:
                    met = met._replace(cands=met.cands.append_column(name, out[name]))
                yield from met.cands.combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def joined(met: Met, on: np.ndarray, text: str = "text", sep: str = " ") -> pa.Array:
    """For each candidate the texts of its pairs ``on``, in their order; nulls are left out."""
    on = on & met.segs[text].is_valid().to_numpy()[met.seg]
    found = met.segs[text].take(pa.array(met.seg[on])).combine_chunks()
    return pc.binary_join(lists(counted(met.cand[on], len(met.cands)), found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)), sep)
