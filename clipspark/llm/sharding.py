"""Shards by extendible hashing.

A row's bucket is given by the leading bits of its key's hash. A bucket over the byte limit
splits on one more bit, alone; the others keep their depth, as directory entries that share
a bucket do. A bucket of one row cannot split. Rows with equal keys share all bits of the
hash; behind them come bits of a number drawn for each row, so a key that holds a third of
all rows splits as well.

Sizes are summed once for a depth at which most buckets fit, and the tree above is folded
from these sums; only buckets that are still too large there are looked at again, eight bits
further. What is shuffled are (bits, bytes) rows and sums, never texts, and nothing is
collected.

Defined results: a null key is a key like any other; a null or empty text has no bytes; a
row over the limit gets a shard of its own; an empty table gives no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

SHARD_BYTES = 16 << 20
_BITS = 60  # of the hash, and again of the row's number


def _number(value: Column) -> Column:
    """60 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def _head(high: Column, low: Column, depth: int) -> tuple[Column, Column]:
    """The first ``depth`` bits of (high, low) as two numbers."""
    return (
        F.shiftright(high, max(0, _BITS - depth)),
        F.shiftright(low, max(0, 2 * _BITS - depth)) if depth > _BITS else F.lit(0).cast("long"),
    )


def _leaves(sums: DataFrame, first: int, last: int, limit: int) -> DataFrame:
    """(h, l, depth, bytes, rows, fits) for the buckets that the tree over sums at depth
    ``last`` ends in; those at ``last`` may be too large still."""
    levels = None
    for depth in range(first, last + 1):
        up_high = F.shiftright("h", min(last, _BITS) - min(depth, _BITS))
        up_low = F.shiftright("l", max(last - _BITS, 0) - max(depth - _BITS, 0)) if depth > _BITS else F.lit(0).cast("long")
        one = F.struct(F.lit(depth).alias("depth"), up_high.alias("h"), up_low.alias("l"))
        levels = [one] if levels is None else [*levels, one]
    each = sums.select("h", "l", "bytes", "rows", F.explode(F.array(*levels)).alias("up"))
    nodes = each.groupBy("up").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    nodes = nodes.select("up", "b", "r", ((F.col("b") <= limit) | (F.col("r") == 1)).alias("fits"))
    # a path's leaf is its first node that fits, or its last node
    own = each.join(nodes, "up").groupBy("h", "l").agg(
        F.coalesce(F.min(F.when(F.col("fits"), F.struct("up.depth", "up.h", "up.l", F.col("b").alias("bytes"), "fits"))), F.max(F.struct("up.depth", "up.h", "up.l", F.col("b").alias("bytes"), "fits"))).alias("leaf")
    )
    return own.select(F.col("h").alias("h_"), F.col("l").alias("l_"), "leaf")


def extendible_shards(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes) for rows with columns key and bytes. The
    shard's name is its leading bits."""
    slim = written(rows.select("key", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), _number(F.coalesce(F.col("key").cast("string"), F.lit("null"))).alias("high"), F.monotonically_increasing_id().alias("row")))
    slim = slim.withColumn("low", _number(F.col("row").cast("string"))).drop("row")
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    first, last = 0, min(_BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + 4)
    done, rest = None, slim
    while True:
        h, l = _head(F.col("high"), F.col("low"), last)
        placed = rest.withColumn("h", h).withColumn("l", l)
        sums = placed.groupBy("h", "l").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        sums = sums.select("h", "l", F.col("bytes").alias("bytes"), "rows")
        leaves = _leaves(sums, first, last, limit)
        found = written(placed.join(leaves, (F.col("h") == F.col("h_")) & (F.col("l") == F.col("l_"))).select("key", "bytes", "high", "low", "leaf"))
        end = last >= 2 * _BITS
        fit = found if end else found.filter("leaf.fits")
        name = F.concat(F.lpad(F.bin("leaf.h"), F.least(F.col("leaf.depth"), F.lit(_BITS)), F.lit("0")), F.when(F.col("leaf.depth") > _BITS, F.lpad(F.bin("leaf.l"), F.col("leaf.depth") - _BITS, F.lit("0"))).otherwise(""))
        part = fit.select("key", "bytes", F.when(F.col("leaf.depth") == 0, "").otherwise(name).alias("shard"), F.col("leaf.depth").cast("long").alias("depth"), F.col("leaf.bytes").alias("shard_bytes"))
        done = part if done is None else done.union(part)
        if end or found.filter("not leaf.fits").limit(1).count() == 0:
            return done
        rest = found.filter("not leaf.fits").select("key", "bytes", "high", "low")
        first, last = last + 1, min(2 * _BITS, last + 8)


def shard_table(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard, depth, shard_bytes of every document."""
    rows = docs.select(F.col("doc_id").alias("key"), F.octet_length("text").alias("bytes"))
    return extendible_shards(rows, limit).select(F.col("key").alias("doc_id"), F.col("bytes").alias("n_bytes"), "shard", "depth", "shard_bytes")
