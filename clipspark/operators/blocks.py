"""Splitting one long source over many tasks.

A source can hold a large share of a whole table, so no operator keys its work by
source alone. Every timeline is cut into blocks of bounded length (a day by
default); windows, folds and joins run per (source, block), rows near a block edge
are also placed in the neighbour block as *halo* rows, and only one summary row per
block is ever ordered per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.operators.stages import materialise

DAY_MS = 86_400_000


def block_of(at: Column, width: int) -> Column:
    return F.floor(at / F.lit(width)).cast("long")


def block_links(df: DataFrame, keys: Sequence[str], at: str, width: int, rows: int = 1) -> DataFrame | None:
    """``keys, block, _to``: each block that has others before it, with the ``rows + 1``
    before it. None where every source is one block."""
    keys = list(keys)
    past = Window.partitionBy(*keys).orderBy("block")
    earlier = F.array(*[F.lag("block", i).over(past) for i in range(1, rows + 2)])
    links = materialise(
        df.select(*keys, block_of(F.col(at), width).alias("block"))
        .distinct()
        .select(*keys, "block", earlier.alias("_tos"))
        .select(*keys, "block", F.explode("_tos").alias("_to"))
        .where(F.col("_to").isNotNull())
    )
    return None if links.isEmpty() else links


def with_lookahead(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    width: int,
    ahead: int,
    rows: int = 1,
    links: DataFrame | None = None,
) -> DataFrame:
    """Add ``block`` and ``halo``. Each block also receives, flagged as halo, what its
    last rows may need to see: every row starting within ``ahead`` of the block's end,
    and at least the ``rows`` next rows however long the silence before them.

    Rows travel to other blocks only in sources of several blocks (``links``, see
    ``block_links``; None: there are none)."""
    if ahead > width:
        raise ValueError("the look-ahead must fit in one block")
    keys = list(keys)
    own = df.withColumn("block", block_of(F.col(at), width))
    if links is None:
        return own.withColumn("halo", F.lit(False))
    near = (F.col(at) - F.col("block") * F.lit(width) < F.lit(ahead)) & (F.col("block") > 0)
    shift = F.when(near, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    timed = (
        own.withColumn("_shift", F.explode(shift))
        .withColumn("block", F.col("block") - F.col("_shift"))
        .withColumn("halo", F.col("_shift") == 1)
        .drop("_shift")
    )
    # and the first rows beyond that stretch: they lie in the next non-empty blocks, of
    # which the very next may end before the stretch does. A block's first rows, and its
    # first beyond the stretch, are found once for all targets
    late = F.col(at) - F.col("block") * F.lit(width) >= F.lit(ahead)
    first = Window.partitionBy(*keys, "block", "_late").orderBy(*order)
    within = Window.partitionBy(*keys, "block", "_to").orderBy(*order)
    heads = (
        own.join(links.select(*keys).distinct(), keys, "left_semi")
        .withColumn("_late", late)
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= rows)
        .join(links, [*keys, "block"])
        .where(F.col("_late") | (F.col("_to") != F.col("block") - 1))
        .withColumn("_rn", F.row_number().over(within))
        .where(F.col("_rn") <= rows)
        .withColumn("block", F.col("_to"))
        .withColumn("halo", F.lit(True))
        .drop("_to", "_rn", "_late")
    )
    return timed.unionByName(heads)


def number_rows(
    df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column], out: str
) -> DataFrame:
    """1-based row number per key, following blocks then ``order``. Rows are numbered
    inside their block; a running sum over one row per block gives the offset."""
    keys = list(keys)
    local = Window.partitionBy(*keys, block).orderBy(*order)
    per_block = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    return (
        df.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, block])
        .withColumn(out, F.col("_local") + F.col("_base"))
        .drop("_local", "_base")
    )


def with_key_totals(
    df: DataFrame, keys: Sequence[str], block: str, totals: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Attach per-key totals (``name -> (kind, column)``, kind in min/max/sum) to each
    row. Partial totals per block are combined per key and joined back per block, so
    the join key is never the bare source."""
    keys = list(keys)
    fns = {"min": F.min, "max": F.max, "sum": F.sum}
    per_block = df.groupBy(*keys, block).agg(
        *[fns[kind](col).alias(f"_{name}") for name, (kind, col) in totals.items()]
    )
    whole = Window.partitionBy(*keys)
    combined = per_block.select(
        *keys,
        block,
        *[fns[kind](f"_{name}").over(whole).alias(name) for name, (kind, _) in totals.items()],
    )
    return df.join(combined, [*keys, block])
