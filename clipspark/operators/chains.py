"""Following "next" pointers through a timeline without one task per source.

Greedy cutting rules (windows, chapters, caption cards) are all of one form: where a
piece that starts at row ``i`` ends, and where the following one starts, depends on a
bounded look-ahead from ``i`` only. So each row's pointer is computed independently,
and what remains is to find the rows that are reached from the first one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipspark.operators.stages import materialise


def _visits(rows: pa.Table, low: int, high: int) -> Iterator[tuple[int, list[int]]]:
    """For each entry of a block (``rows[low:high]``, sorted by ``pos``): its row and the
    rows visited from it. Pointers lead to later rows, so none is visited twice."""
    part = rows.slice(low, high - low)
    entry = part["root"].is_valid().to_numpy()
    hop = np.flatnonzero(~entry)
    pos = part["pos"].to_numpy()
    nxt = part["nxt"].fill_null(0).to_numpy()[hop]
    known = part["nxt"].is_valid().to_numpy()[hop]
    at = np.searchsorted(pos[hop], nxt)
    near = np.minimum(at, len(hop) - 1)
    onward = np.where(known & (pos[hop][near] == nxt) & (near > np.arange(len(hop))), near, -1).tolist()
    for i in np.flatnonzero(entry):
        here = int(np.searchsorted(pos[hop], pos[i]))
        path = []
        if here < len(hop) and pos[hop][here] == pos[i]:
            while here >= 0:
                path.append(low + int(hop[here]))
                here = onward[here]
        yield low + int(i), path


def whole_blocks(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole blocks (equal ``names``) of a sorted partition, and the blocks' edges;
    holds one block and one batch."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        new = np.zeros(max(len(rows) - 1, 0), bool)
        for n in names:
            new |= pc.not_equal(rows[n].slice(1), rows[n].slice(0, max(len(rows) - 1, 0))).to_numpy()
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        held = rows.slice(edges[-1])
        if len(edges) > 1:
            yield rows.slice(0, edges[-1]), edges
    if held is not None and len(held):
        yield held, [0, len(held)]


def _walker(names: Sequence[str]):
    """Walks the blocks (equal ``names``) of a sorted partition."""

    def walk(rows: pa.Table, edges: list[int]) -> pa.Table:
        found = [v for low, high in zip(edges, edges[1:]) for v in _visits(rows, low, high) if v[1]]
        size = [len(path) for _, path in found]
        begun = np.repeat(np.array([e for e, _ in found], np.int64), size)
        tail = np.zeros(sum(size), bool)
        tail[np.cumsum(size, dtype=np.int64) - 1] = True
        taken = rows.drop_columns(["root"]).take(pa.array([r for _, path in found for r in path], pa.int64()))
        first = rows.select(["pos", "root"]).take(pa.array(begun))
        return taken.append_column("entry", first["pos"]).append_column("root", first["root"]).append_column("tail", pa.array(tail))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_blocks(batches, names):
            yield from walk(rows, edges).to_batches()

    return run


def reach(nodes: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Rows reached from each key's first ``pos`` by following ``nxt``.

    ``nodes`` has the keys, ``block``, ``pos`` (unique per key; rows without one of these
    are left out), ``nxt`` and ``nxt_block`` (both null at the end of the source) and the
    payload columns. Each block is walked once from every place it can be entered (only
    pointers that cross a block edge enter one); the list of entries, a few per block, is
    then walked per key, and only the block walks that list uses are kept.
    """
    keys, by_block = list(keys), [*keys, "block"]
    nodes = nodes.select(*by_block, "pos", "nxt", "nxt_block", *payload).dropna(subset=[*by_block, "pos"])
    lead = nodes.groupBy(*keys).agg(F.min(F.struct("block", "pos")).alias("lead"))
    roots = lead.select(*keys, "lead.block", "lead.pos", F.lit(True).alias("root"))
    crossing = nodes.where(F.col("nxt_block") != F.col("block")).select(
        *keys, F.col("nxt_block").alias("block"), F.col("nxt").alias("pos"), F.lit(False).alias("root")
    )
    entries = roots.unionByName(crossing).groupBy(*by_block, "pos").agg(F.max("root").alias("root"))
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "entry bigint", "root boolean", "tail boolean"])
    walks = materialise(
        nodes.unionByName(entries, allowMissingColumns=True)
        .repartition(*by_block)
        .sortWithinPartitions(*by_block, "pos")
        .mapInArrow(_walker(by_block), schema)
    )
    steps = walks.where("tail").select(*keys, "entry", "root", F.col("nxt").alias("out"))
    step = F.struct("entry", "out")
    routes = steps.groupBy(*keys).agg(
        F.min(F.when(F.col("root"), F.col("entry"))).alias("cur"),
        F.sort_array(F.collect_set(step)).alias("steps"),
    )
    used = routes.select(
        *keys,
        F.explode(
            F.aggregate(
                "steps",
                F.struct(F.col("cur"), F.expr("cast(array() as array<bigint>)").alias("used")),
                lambda acc, s: F.when(
                    s["entry"] == acc["cur"],
                    F.struct(s["out"].alias("cur"), F.concat(acc["used"], F.array(s["entry"])).alias("used")),
                ).otherwise(acc),
                lambda acc: acc["used"],
            )
        ).alias("entry"),
    )
    # a source's first entry is always used: only what other entries reached is looked up
    others = walks.where(~F.col("root")).join(used, [*keys, "entry"], "left_semi")
    return walks.where("root").unionByName(others).drop("entry", "root", "tail")
