"""Greedy cuts of a timeline in one sorted pass over its blocks.

Where a piece ends depends on a bounded look-ahead from its first unit only (a segment, a
word). So a block can be cut alone once it is known where the pieces before it end. Most
sources are one block and begin at their first unit. Of the others, each block first tells
where the cut leaves it for every unit it can be entered at; these few rows are followed
per source, and the pass over the units then starts each block at its entry. Units are
sorted by block and go through a task once; no pointer per unit is written or joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.operators.chains import whole_blocks
from clipspark.operators.stages import materialise

KEY = ["source_id", "block"]


class Units(NamedTuple):
    """The units of some whole blocks. Block ``k`` has those from ``low[k]`` to ``high[k]``;
    from ``own[k]`` on they belong to later blocks and are only looked at."""

    pos: list[int]
    block: list[int]  # the block a unit belongs to
    low: list[int]
    own: list[int]
    high: list[int]
    doors: list[int]  # block k can be entered at its first units up to here
    piece: Callable[[int, int], tuple[int, int]]  # (unit, high) -> (end of its piece, first unit of the next or -1)
    counted: Callable[[int, int, int], bool]  # (unit, end, high) -> whether its piece is kept


class Piece(NamedTuple):
    k: int
    first: int
    end: int
    number: int


Reader = Callable[[pa.Table, list[int]], Units]


def _routes(units: Units, rows: pa.Table, edges: list[int]) -> pa.Table:
    """For each unit a block can be entered at: where the cut leaves it, and the pieces kept."""
    at, out = [], {c: [] for c in ("entry", "out", "out_block", "n")}
    for k, (low, own, high) in enumerate(zip(units.low, units.own, units.high)):
        leaves, count = {}, {}
        for i in range(own - 1, low - 1, -1):
            end, onward = units.piece(i, high)
            inside = 0 <= onward < own
            leaves[i] = leaves[onward] if inside else onward
            count[i] = int(units.counted(i, end, high)) + (count[onward] if inside else 0)
        for i in range(low, min(units.doors[k], own)):
            known = leaves[i] >= 0
            at.append(edges[k])
            out["entry"].append(units.pos[i])
            out["out"].append(units.pos[leaves[i]] if known else None)
            out["out_block"].append(units.block[leaves[i]] if known else None)
            out["n"].append(count[i])
    taken = rows.select(KEY).take(pa.array(at, pa.int64()))
    for c, v in out.items():
        taken = taken.append_column(c, pa.array(v, pa.int64()))
    return taken


def _ordered(rows: DataFrame, order: Sequence[str], spread: dict[str, Column]) -> DataFrame:
    """Blocks side by side in each partition, entry first, then own units, then those looked
    at. A window asks for that without a shuffle where rows lie by source already; units are
    spread out behind the sort."""
    window = Window.partitionBy(*KEY).orderBy("halo", *order)
    return rows.withColumn("_n", F.row_number().over(window)).withColumns(spread)


def entries(rows: DataFrame, links: DataFrame, order: Sequence[str], spread: dict[str, Column], read: Reader) -> DataFrame:
    """``source_id, block, entry, base, total`` of every block of the sources that have several:
    the unit its cut starts at (null: none), the pieces kept before it and in all."""
    some = rows.join(links.select("source_id").distinct(), "source_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_blocks(batches, KEY):
            yield from _routes(read(table, edges), table, edges).to_batches()

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in KEY) + ", entry bigint, out bigint, out_block bigint, n bigint"
    doors = materialise(_ordered(some, order, spread).mapInArrow(run, schema))
    steps = doors.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("block", "entry", "out", "out_block", "n"))).alias("s"))
    followed = steps.select(
        "source_id",
        F.expr(
            """aggregate(s,
              named_struct('b', s[0].block, 'e', s[0].entry, 'total', 0L, 'used', cast(array() as array<struct<block: bigint, entry: bigint, base: bigint>>)),
              (a, x) -> if(x.block <=> a.b and x.entry <=> a.e,
                named_struct('b', x.out_block, 'e', x.out, 'total', a.total + x.n,
                  'used', concat(a.used, array(named_struct('block', x.block, 'entry', x.entry, 'base', a.total)))), a))"""
        ).alias("w"),
    )
    used = followed.select("source_id", F.inline("w.used"))
    blocks = doors.select(*KEY).distinct().join(followed.select("source_id", "w.total"), "source_id")
    return materialise(blocks.join(used, KEY, "left"))


def cut(
    rows: DataFrame, known: DataFrame | None, order: Sequence[str], spread: dict[str, Column], read: Reader,
    emit: Callable[[pa.Table, Units, list[Piece]], pa.Table], schema: str,
) -> DataFrame:
    """The pieces of every source, as ``emit`` writes them. ``known``: the entries of sources of
    several blocks. A source of one block that keeps no piece is one piece as a whole."""
    if known is not None:
        rows = rows.unionByName(known.select(*KEY, "entry", "base", F.lit(True).alias("mark")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_blocks(batches, KEY):
            begin = {}
            if "mark" in table.column_names:
                marks = table["mark"].fill_null(False).to_numpy()
                before = np.concatenate([[0], np.cumsum(marks)])
                for k, low in enumerate(edges[:-1]):
                    if marks[low]:
                        begin[k] = table["entry"][low].as_py(), table["base"][low].as_py()
                table, edges = table.filter(pa.array(~marks)), [int(e - before[e]) for e in edges]
            units, pieces = read(table, edges), []
            for k, (low, own, high) in enumerate(zip(units.low, units.own, units.high)):
                entry, number = begin.get(k, (None, 0))
                i = low if k not in begin else -1 if entry is None else units.pos.index(entry, low, own)
                some = k in begin
                while 0 <= i < own:
                    end, onward = units.piece(i, high)
                    if units.counted(i, end, high):
                        number, some = number + 1, True
                        pieces.append(Piece(k, i, end, number))
                    i = onward
                if own > low and not some:
                    pieces.append(Piece(k, low, own, 1))
            yield from emit(table, units, pieces).to_batches()

    return _ordered(rows, order, spread).mapInArrow(run, schema)
