"""Interval, nearest and as-of joins on a timeline.

All of them meet in (source, time bucket): a long source is spread over its buckets
and a pair is produced exactly once, in the bucket in which its intersection begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.operators.blocks import DAY_MS, block_of

BUCKET_MS = 120_000


def interval_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    l_span: tuple[str, str],
    r_span: tuple[str, str],
    closed: bool = False,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Pairs whose spans intersect; ``closed`` counts touching ends as intersecting."""

    def spread(df: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        lo, hi = (block_of(F.col(c), bucket_ms) for c in span)
        return df.withColumn(name, F.explode(F.sequence(lo, F.greatest(lo, hi))))

    a, b = spread(left, l_span, "_lb"), spread(right.withColumnRenamed(key, "_rk"), r_span, "_rb")
    ls, le, rs, re = (F.col(c) for c in (*l_span, *r_span))
    meet = (ls <= re) & (rs <= le) if closed else (ls < re) & (rs < le)
    owner = block_of(F.greatest(ls, rs), bucket_ms)
    return a.join(
        b, (F.col(key) == F.col("_rk")) & (F.col("_lb") == F.col("_rb")) & meet & (owner == F.col("_lb"))
    ).drop("_lb", "_rb", "_rk")


def asof(
    points: DataFrame,
    events: DataFrame,
    key: str,
    at: str,
    when: str,
    value: Column,
    out: str,
    forward: bool = False,
    strict: bool = False,
    block_ms: int = DAY_MS,
) -> DataFrame:
    """Attach to each point the greatest ``value`` among events at or before it (or,
    ``forward``, the least among events at or after it); ``strict`` excludes equal times.

    One sorted pass per (key, block); what earlier blocks have to offer arrives through
    one summary row per block.
    """
    names = points.columns
    best = F.min if forward else F.max
    p = points.withColumn("_t", F.col(at)).withColumn("_v", F.lit(None)).withColumn("_p", F.lit(1))
    e = events.select(F.col(key), F.col(when).alias("_t"), value.alias("_v"), F.lit(0).alias("_p"))
    for name in names:
        if name != key:
            e = e.withColumn(name, F.lit(None))
    both = p.unionByName(e.select(*p.columns)).withColumn("_b", block_of(F.col("_t"), block_ms))
    side = F.col("_p").desc() if strict else F.col("_p").asc()
    time = F.col("_t").desc() if forward else F.col("_t").asc()
    run = (
        Window.partitionBy(key, "_b").orderBy(time, side).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    block = F.col("_b").desc() if forward else F.col("_b").asc()
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        both.groupBy(key, "_b").agg(best("_v").alias("_m")).select(key, "_b", best("_m").over(earlier).alias("_c"))
    )
    pick = F.least if forward else F.greatest
    return (
        both.withColumn("_r", best("_v").over(run))
        .where(F.col("_p") == 1)
        .join(carry, [key, "_b"])
        .withColumn(
            out,
            F.when(F.col("_r").isNull(), F.col("_c")).when(F.col("_c").isNull(), F.col("_r")).otherwise(
                F.when(F.col("_r") <= F.col("_c"), F.col("_r") if forward else F.col("_c")).otherwise(
                    F.col("_c") if forward else F.col("_r")
                )
            ),
        )
        .select(*names, out)
    )


def ordered_text(key: Sequence[str], text: str = "text", sep: str = " ", when: Column | None = None) -> Column:
    """Aggregate: texts joined in ``key`` order, of the rows for which ``when`` holds."""
    item = F.struct(*key, F.col(text).alias("_x"))
    rows = F.collect_list(F.when(when, item) if when is not None else item)
    return F.array_join(F.transform(F.sort_array(rows), lambda r: r["_x"]), sep)
