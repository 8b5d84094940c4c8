"""Ranking, suppression, shortlists and fusion over scored candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.operators.stages import materialise

TIE_BLOCK = 1 << 20


def number_by_score(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    tie: str,
    out: str = "rank",
    descending: bool = True,
    tie_block: int = TIE_BLOCK,
) -> DataFrame:
    """1-based rank per key by score, ties in ``tie`` (an integer sequence) order.

    A key may hold a large share of all rows, so its rows are never sorted in one
    task: counts per score value, then per block of tied rows, give each block its
    offset and rows are numbered inside their block. Scores are rounded values, so
    the per-key summary is as small as the score scale.
    """
    keys = list(keys)
    rows = df.withColumn("_tb", F.floor(F.col(tie) / F.lit(tie_block)).cast("long"))
    per_block = rows.groupBy(*keys, score, "_tb").agg(F.count(F.lit(1)).alias("_n"))
    per_score = per_block.groupBy(*keys, score).agg(F.sum("_n").alias("_m"))
    order = F.col(score).desc() if descending else F.col(score).asc()
    before_score = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before_block = Window.partitionBy(*keys, score).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    base_score = per_score.select(*keys, score, F.coalesce(F.sum("_m").over(before_score), F.lit(0)).alias("_a"))
    offsets = (
        per_block.withColumn("_b", F.coalesce(F.sum("_n").over(before_block), F.lit(0)))
        .join(base_score, [*keys, score])
        .select(*keys, score, "_tb", (F.col("_a") + F.col("_b")).alias("_base"))
    )
    local = Window.partitionBy(*keys, score, "_tb").orderBy(tie)
    return (
        rows.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, score, "_tb"])
        .withColumn(out, (F.col("_local") + F.col("_base")).cast("long"))
        .drop("_tb", "_local", "_base")
    )


def rank_predictions(scores: DataFrame, keys: Sequence[str] = ("source_id",), tie: str = "candidate_seq") -> DataFrame:
    """Rank by score, best first; equal scores keep candidate order.

    The scores are read for the counts and for the rows: they are computed once."""
    return number_by_score(materialise(scores), keys, "score", tie)


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_pairs(cands: DataFrame, block_ms: int = 300_000) -> DataFrame:
    """Every overlapping pair of candidates of one source, with both overlap ratios.

    Pairs meet in the time bucket where their intersection starts, so a long source
    is spread over its buckets and no pair is seen twice.
    """
    bucketed = cands.select(
        "source_id",
        "candidate_seq",
        "start_ms",
        "end_ms",
        F.explode(
            F.sequence(
                F.floor(F.col("start_ms") / block_ms),
                F.floor(F.greatest(F.col("start_ms"), F.col("end_ms") - 1) / block_ms),
            )
        ).alias("bucket"),
    )
    a, b = bucketed.alias("a"), bucketed.alias("b")
    inter = F.least("a.end_ms", "b.end_ms") - F.greatest("a.start_ms", "b.start_ms")
    shorter = F.least(F.col("a.end_ms") - F.col("a.start_ms"), F.col("b.end_ms") - F.col("b.start_ms"))
    union = (F.col("a.end_ms") - F.col("a.start_ms")) + (F.col("b.end_ms") - F.col("b.start_ms")) - inter
    return (
        a.join(
            b,
            (F.col("a.source_id") == F.col("b.source_id"))
            & (F.col("a.bucket") == F.col("b.bucket"))
            & (F.col("a.candidate_seq") < F.col("b.candidate_seq"))
            & (F.col("a.start_ms") < F.col("b.end_ms"))
            & (F.col("b.start_ms") < F.col("a.end_ms"))
            & (F.floor(F.greatest("a.start_ms", "b.start_ms") / block_ms) == F.col("a.bucket")),
        )
        .select(
            F.col("a.source_id").alias("source_id"),
            F.col("a.candidate_seq").alias("a_seq"),
            F.col("b.candidate_seq").alias("b_seq"),
            inter.alias("overlap_ms"),
            F.when(shorter > 0, inter / shorter).otherwise(F.lit(0.0)).alias("overlap_ratio"),
            F.when(union > 0, inter / union).otherwise(F.lit(0.0)).alias("iou"),
        )
    )


def _defeats(rows: DataFrame, threshold: float, block_ms: int = 300_000) -> DataFrame:
    """``source_id, loser, winner``: clashing candidates, the better one as the winner
    (higher score, then lower number; a null score is the lowest)."""
    bucket = F.sequence(F.floor(F.col("start_ms") / block_ms), F.floor(F.greatest(F.col("start_ms"), F.col("end_ms") - 1) / block_ms))
    bucketed = rows.select("source_id", "candidate_seq", "start_ms", "end_ms", "score", F.explode(bucket).alias("bucket"))
    a, b = bucketed.alias("a"), bucketed.alias("b")
    inter = overlap_ms(*[F.col(c) for c in ("a.start_ms", "a.end_ms", "b.start_ms", "b.end_ms")])
    shorter = F.least(F.col("a.end_ms") - F.col("a.start_ms"), F.col("b.end_ms") - F.col("b.start_ms"))
    mine, other = (F.coalesce(F.col(f"{s}.score").cast("double"), F.lit(float("-inf"))) for s in "ab")
    return (
        a.join(b, (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.bucket") == F.col("b.bucket")))
        .where(F.col("a.candidate_seq") != F.col("b.candidate_seq"))
        .where((mine < other) | ((mine == other) & (F.col("a.candidate_seq") > F.col("b.candidate_seq"))))
        .where((inter > 0) & (shorter > 0) & (inter / shorter >= F.lit(threshold)))
        # once, in the bucket where the overlap starts
        .where(F.floor(F.greatest("a.start_ms", "b.start_ms") / block_ms) == F.col("a.bucket"))
        .select(F.col("a.source_id").alias("source_id"), F.col("a.candidate_seq").alias("loser"), F.col("b.candidate_seq").alias("winner"))
    )


def nms_top_k(scored: DataFrame, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """Best ``k`` candidates per source such that none overlaps a better kept one.

    ``scored``: source_id, candidate_seq, start_ms, end_ms, score. Only clashing pairs are
    worked on: a candidate that no standing one defeats stays, those it defeats fall, and
    their pairs go. A round settles at least each source's best unsettled candidate, so the
    first ``k`` picks are settled after ``k`` rounds; they end sooner when no pair is left.
    No round reads the candidates again, and pairs meet in time buckets.
    """
    # read by the pairs and by the result: computed once
    rows = materialise(scored.select("source_id", "candidate_seq", "start_ms", "end_ms", "score"))
    pairs = materialise(_defeats(rows, threshold))
    fallen = []
    for _ in range(k):
        if pairs.isEmpty():
            break
        losers = pairs.select("source_id", F.col("loser").alias("winner")).distinct()
        out = pairs.join(losers, ["source_id", "winner"], "left_anti").select("source_id", "loser").distinct()
        out = materialise(out)
        fallen.append(out)
        beaten = out.withColumnRenamed("loser", "winner")
        pairs = materialise(pairs.join(out, ["source_id", "loser"], "left_anti").join(beaten, ["source_id", "winner"], "left_anti"))
    standing = rows
    for out in fallen:
        standing = standing.join(out.withColumnRenamed("loser", "candidate_seq"), ["source_id", "candidate_seq"], "left_anti")
    order = Window.partitionBy("source_id").orderBy(F.col("score").desc_nulls_last(), "candidate_seq")
    return (
        standing.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("source_id", F.col("rank").cast("long").alias("rank"), "candidate_seq", "start_ms", "end_ms", "score")
    )
