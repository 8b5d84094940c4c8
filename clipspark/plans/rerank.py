"""Comparative reranking of a frozen shortlist as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipspark.operators import tournament as tn
from clipspark.operators.responses import SURVIVING
from clipspark.operators.stages import materialise

SET, ID = tn.SET, tn.ID


def split_survivors(shortlist: DataFrame, editorial: DataFrame, critic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shortlisted candidates that reach comparison, and those that do not."""
    rows = (
        editorial.select(SET, ID, "editorial_class", "scroll_stop", "confidence", "quality_penalty")
        .join(shortlist.select(SET, ID), [SET, ID], "left_semi")
        .join(critic.select(SET, ID, "decision", F.col("penalty").alias("critic_penalty")), [SET, ID], "left")
    )
    alive = F.col("editorial_class").isin(*SURVIVING) & (F.col("decision") != "REJECT")
    penalty = F.round((F.col("quality_penalty") + F.coalesce("critic_penalty", F.lit(0.0))) / 100.0, 6)
    # a shortlist per set, read by every later stage: written once
    judged = materialise(rows.withColumn("alive", F.coalesce(alive, F.lit(False))).withColumn("penalty", penalty))
    return judged.where("alive").drop("alive"), judged.where(~F.col("alive")).drop("alive")


def ready(survivors: DataFrame, orderings: DataFrame | None = None) -> DataFrame:
    """Seeded survivors with their listwise points."""
    seeded = tn.seed_order(survivors)
    batches = tn.deal_batches(seeded)
    points = tn.borda_points(batches, orderings) if orderings is not None else None
    if points is None:
        return seeded.withColumn("listwise_points", F.lit(0.0))
    return seeded.join(points.select(SET, ID, "listwise_points"), [SET, ID], "left").withColumn(
        "listwise_points", F.coalesce("listwise_points", F.lit(0.0))
    )


def rerank(
    shortlist: DataFrame, editorial: DataFrame, critic: DataFrame, orderings: DataFrame, judgments: DataFrame, previous: DataFrame
) -> DataFrame:
    """Shortlist to final ranking; pairs nobody judged are ties."""
    survivors, rejected = split_survivors(shortlist, editorial, critic)
    seeded = materialise(ready(survivors, orderings))
    swiss = materialise(tn.swiss_rounds(seeded, judgments))
    table = seeded.join(tn.standings(swiss), [SET, ID], "left").withColumn(
        "standing", F.coalesce("points", F.lit(0.0)) + F.col("penalty")
    )
    finals = tn.final_pairs(table, swiss).join(judgments, [SET, "a", "b"], "left").select(
        SET, "a", "b", F.coalesce("winner", F.lit("TIE")).alias("winner")
    )
    played = swiss.select(SET, "a", "b", "winner").unionByName(finals)
    return tn.emit_ranking(tn.final_order(seeded, played), rejected, previous)
