"""Ranking quality against human labels.

Inputs: ``preds`` (candidate_set_id, scorer, candidate_id, rank, score, ...) and
``pool`` (candidate_set_id, candidate_id, human_score, publishable, ...), the whole
candidate pool with nulls where nobody has labelled. A candidate set may be most of a
table: all measures are sums over a top-k or over the pool, combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import first_match, flag_list

RELEVANT = 3.0
PERFECT = 4.0
BAD = 2.0
SET = "candidate_set_id"
DIMENSIONS = ("hook_score", "standalone_score", "payoff_score", "value_score", "context_dependency")


def _gain(rel: Column, position: Column) -> Column:
    return F.when(rel > 0, (F.pow(F.lit(2.0), rel) - 1.0) / F.log2(position + 1)).otherwise(F.lit(0.0))


def _top(preds: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """The first ``k`` ranks with their labels; unlabelled counts as relevance 0."""
    labels = pool.select(SET, "candidate_id", "human_score", "publishable")
    return (
        preds.where(F.col("rank") <= k)
        .select(SET, "scorer", "candidate_id", "rank")
        .join(labels, [SET, "candidate_id"], "left")
        .withColumn("rel", F.coalesce("human_score", F.lit(0.0)))
    )


def dcg(preds: DataFrame, pool: DataFrame, k: int = 10) -> DataFrame:
    return (
        _top(preds, pool, k)
        .groupBy(SET, "scorer")
        .agg(F.round(F.sum(_gain(F.col("rel"), F.col("rank"))), 6).alias("dcg"))
    )


def _ideal(pool: DataFrame, ks: Sequence[int]) -> DataFrame:
    best = Window.partitionBy(SET).orderBy(F.col("human_score").desc())
    top = (
        pool.where(F.col("human_score").isNotNull())
        .select(SET, "human_score", F.row_number().over(best).alias("pos"))
        .where(F.col("pos") <= max(ks))
    )
    return (
        top.withColumn("k", F.explode(_ks(ks)))
        .groupBy(SET, "k")
        .agg(F.sum(F.when(F.col("pos") <= F.col("k"), _gain(F.col("human_score"), F.col("pos")))).alias("idcg"))
    )


def _ks(ks: Sequence[int]) -> Column:
    return F.array(*[F.lit(k).cast("long") for k in ks])


def metrics_at_k(preds: DataFrame, pool: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """nDCG, precision, perfect/bad/publishable rates, mean label and hit rate per k."""
    top = _top(preds, pool, max(ks)).withColumn("k", F.explode(_ks(ks))).where(F.col("rank") <= F.col("k"))

    def share(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    sums = top.groupBy(SET, "scorer", "k").agg(
        F.sum(_gain(F.col("rel"), F.col("rank"))).alias("dcg"),
        share(F.col("rel") >= RELEVANT).alias("relevant"),
        share(F.col("rel") >= PERFECT).alias("perfect"),
        share(F.col("rel") <= BAD).alias("bad"),
        share(F.coalesce("publishable", F.lit(False))).alias("pub"),
        F.avg("human_score").alias("mean"),
    )
    k = F.col("k")
    return sums.join(_ideal(pool, ks), [SET, "k"], "left").select(
        SET,
        "scorer",
        "k",
        F.when(F.col("idcg") > 0, F.round(F.least(F.lit(1.0), F.col("dcg") / F.col("idcg")), 4))
        .otherwise(F.lit(0.0))
        .alias("ndcg"),
        F.round(F.col("relevant") / k, 4).alias("precision"),
        F.round(F.col("perfect") / k, 4).alias("perfect_rate"),
        F.round(F.col("bad") / k, 4).alias("bad_rate"),
        F.round(F.col("pub") / k, 4).alias("publishable_rate"),
        F.coalesce(F.round("mean", 3), F.lit(0.0)).alias("mean_human_score"),
        F.when(F.col("relevant") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit_rate"),
        F.col("relevant").alias("relevant_found"),
    )


def recall_at_k(preds: DataFrame, pool: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Recall, defined only where every candidate of the set is labelled."""
    whole = pool.groupBy(SET).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("human_score").alias("labelled"),
        F.sum((F.col("human_score") >= RELEVANT).cast("long")).alias("relevant_total"),
    )
    complete = F.col("labelled") == F.col("total")
    total = F.coalesce("relevant_total", F.lit(0))
    return (
        metrics_at_k(preds, pool, ks)
        .select(SET, "scorer", "k", "relevant_found")
        .join(whole, SET)
        .select(
            SET,
            "scorer",
            "k",
            F.when(complete & (total > 0), F.round(F.try_divide("relevant_found", total), 4))
            .when(complete, F.lit(0.0))
            .alias("recall"),
            F.when(
                ~complete,
                F.format_string(
                    "Recall requires 100%% labeled candidate pool (currently %d/%d labeled)",
                    F.col("labelled"),
                    F.col("total"),
                ),
            )
            .when(total == 0, "No candidates in candidate pool met relevance threshold (human_score >= 3)")
            .alias("message"),
        )
    )


def shortlist_recall(preds: DataFrame, pool: DataFrame) -> DataFrame:
    """How much of the pool, and of its best candidates, a scorer's list covers."""
    flags = pool.select(
        SET,
        "candidate_id",
        F.coalesce(F.col("human_score") >= PERFECT, F.lit(False)).cast("long").alias("perfect"),
        F.coalesce("publishable", F.lit(False)).cast("long").alias("pub"),
    )
    whole = flags.groupBy(SET).agg(
        F.count(F.lit(1)).alias("total"), F.sum("perfect").alias("all_perfect"), F.sum("pub").alias("all_pub")
    )
    found = (
        preds.select(SET, "scorer", "candidate_id")
        .join(flags, [SET, "candidate_id"], "left")
        .groupBy(SET, "scorer")
        .agg(F.count(F.lit(1)).alias("scored"), F.sum("perfect").alias("got_perfect"), F.sum("pub").alias("got_pub"))
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.round(F.try_divide(F.coalesce(a, F.lit(0)), b), 4)).otherwise(F.lit(1.0))

    return found.join(whole, SET).select(
        SET,
        "scorer",
        "scored",
        F.round(F.col("scored") / F.col("total"), 4).alias("coverage"),
        F.when(F.col("scored") < F.col("total"), F.col("scored")).alias("shortlist_size"),
        ratio("got_perfect", "all_perfect").alias("perfect_recall"),
        ratio("got_pub", "all_pub").alias("publishable_recall"),
    )


def compare_scorers(
    preds: DataFrame, pool: DataFrame, scorers: Sequence[str], ks: Sequence[int] = (5, 10)
) -> DataFrame:
    """Measures side by side, one column per scorer. Predictions for a candidate set
    the pool does not know fail the query rather than vanish from it."""
    known = pool.select(F.col(SET).alias("_known")).distinct()
    checked = preds.join(known, F.col(SET) == F.col("_known"), "left").withColumn(
        SET,
        F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("Candidate set ID mismatch: "), F.col(SET))))
        .otherwise(F.col(SET)),
    )
    names = ("ndcg", "precision", "perfect_rate", "bad_rate", "publishable_rate", "mean_human_score", "hit_rate")
    long = metrics_at_k(checked.drop("_known"), pool, ks).select(
        SET, "scorer", "k", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    )
    return long.groupBy(SET, "metric", "k").pivot("scorer", list(scorers)).agg(F.first("value"))


def score_distribution(preds: DataFrame) -> DataFrame:
    """Percentiles, distinct counts and collapse warnings of each scorer's scores."""
    # scores repeat (they are rounded), so count them first and weigh the percentiles
    counted = preds.groupBy(SET, "scorer", "score").agg(F.count(F.lit(1)).alias("times"))
    s, w = F.col("score"), F.col("times")
    ps = F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)])
    stats = counted.groupBy(SET, "scorer").agg(
        F.min(s).alias("lo"),
        F.max(s).alias("hi"),
        F.percentile(s, ps, w).alias("p"),
        F.sum(w).alias("n"),
        F.count(F.lit(1)).alias("unique_raw"),
        F.count_distinct(F.round(s, 2)).alias("unique_rounded"),
        F.sum(F.when(F.round(s, 2) == 0, w).otherwise(0)).alias("zeros"),
        F.sum(s * w).alias("s1"),
        F.sum(s * s * w).alias("s2"),
    )
    mean = F.col("s1") / F.col("n")
    spread = F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)), 2)
    shown = stats.withColumn("sd", spread)
    note = flag_list(
        [
            (
                (F.col("n") >= 10) & (F.col("unique_rounded") < 10),
                F.format_string(
                    "Score collapse warning: only %d unique rounded scores among %d candidates",
                    F.col("unique_rounded"),
                    F.col("n"),
                ),
            ),
            (
                F.col("sd") < 2.0,
                F.format_string(
                    "Low variance warning: standard deviation is %.2f (expected spread across 0-100)", F.col("sd")
                ),
            ),
            (
                F.col("zeros") / F.col("n") >= 0.30,
                F.format_string(
                    "Zero-score collapse warning: %d/%d (%.1f%%) candidates scored 0.0",
                    F.col("zeros"),
                    F.col("n"),
                    F.col("zeros") / F.col("n") * 100,
                ),
            ),
        ]
    )
    cuts = ("p10", "p25", "median", "p75", "p90")
    return shown.select(
        SET,
        "scorer",
        F.round("lo", 2).alias("min"),
        *[F.round(F.col("p")[i], 2).alias(c) for i, c in enumerate(cuts)],
        F.round("hi", 2).alias("max"),
        "unique_raw",
        "unique_rounded",
        "zeros",
        F.col("sd").alias("standard_deviation"),
        F.when(note != "", note).alias("warning"),
    )


def _share(hit: Column, of: Column) -> Column:
    """Share of labelled rows under ``of`` for which ``hit`` holds; null when none."""
    base = F.sum((of & F.col("human_score").isNotNull()).cast("long"))
    return F.round(F.try_divide(F.sum((of & hit & F.col("human_score").isNotNull()).cast("long")), base), 4)


def editorial_precision(preds: DataFrame, pool: DataFrame) -> DataFrame:
    """Whether rejected, strong and critic-rejected candidates deserved it."""
    joined = preds.join(pool.select(SET, "candidate_id", "human_score", "publishable"), [SET, "candidate_id"], "left")
    cls, human = F.col("editorial_class"), F.col("human_score")
    no = F.lit(False)
    rejected = F.coalesce(cls == "REJECT", no) | F.coalesce(F.col("status").startswith("rejected"), no)
    strong = F.coalesce(cls == "STRONG", no)
    critic = F.coalesce(F.col("critic_result") == "REJECT", no)

    def labelled(c: Column) -> Column:
        return F.sum((c & human.isNotNull()).cast("long"))

    out = joined.groupBy(SET, "scorer").agg(
        F.count("human_score").alias("labelled_predictions"),
        F.sum(rejected.cast("long")).alias("reject_count"),
        labelled(rejected).alias("reject_labelled"),
        _share(human <= BAD, rejected).alias("reject_precision"),
        F.sum(strong.cast("long")).alias("strong_count"),
        labelled(strong).alias("strong_labelled"),
        _share(F.coalesce("publishable", no) | (human >= PERFECT), strong).alias("strong_precision"),
        F.sum(critic.cast("long")).alias("critic_reject_count"),
        _share(human <= BAD, critic).alias("critic_reject_precision"),
        F.count("editorial_class").alias("_classed"),
    )
    note = flag_list(
        [
            (F.col("_classed") == 0, "No editorial_class fields found."),
            (
                (F.col("reject_count") > 0) & (F.col("reject_labelled") == 0),
                "No REJECT decision has a human label; RejectPrecision is undefined.",
            ),
            (
                (F.col("strong_count") > 0) & (F.col("strong_labelled") == 0),
                "No STRONG decision has a human label; StrongPrecision is undefined.",
            ),
        ]
    )
    return out.withColumn("message", F.when(note != "", note)).drop("_classed")


def class_agreement(preds: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates and mean label of each editorial class."""
    return (
        preds.where(F.col("editorial_class").isNotNull())
        .join(pool.select(SET, "candidate_id", "human_score"), [SET, "candidate_id"], "left")
        .groupBy(SET, "scorer", "editorial_class")
        .agg(F.count(F.lit(1)).alias("candidates"), F.round(F.avg("human_score"), 3).alias("mean_human"))
    )


def label_summary(pool: DataFrame) -> DataFrame:
    human = F.col("human_score")

    def n(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    any_dim = F.coalesce(*[F.col(d).cast("string") for d in DIMENSIONS], F.col("bad_start").cast("string"),
                         F.col("bad_end").cast("string")).isNotNull()
    return (
        pool.groupBy(SET)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count(human).alias("labelled"),
            n(any_dim).alias("dimension_labelled"),
            n(human >= 3.0).alias("strong"),
            n(human == 2.0).alias("borderline"),
            n(human <= 1.0).alias("reject"),
            n(F.col("publishable")).alias("publishable_count"),
            F.round(F.avg(human), 3).alias("mean_human"),
            *[n(F.bround(human) == b).alias(f"h{b}") for b in range(5)],
            n(F.col("bad_start")).alias("bad_start_count"),
            n(F.col("bad_end")).alias("bad_end_count"),
            n(F.col("bad_start").isNotNull() | F.col("bad_end").isNotNull()).alias("boundary_labelled"),
        )
        .withColumn("complete", F.col("labelled") == F.col("total"))
        .withColumn("strong_rate", F.round(F.try_divide("strong", "labelled"), 4))
        .withColumn("publishable_rate", F.round(F.try_divide("publishable_count", "labelled"), 4))
    )


def label_dimensions(pool: DataFrame) -> DataFrame:
    """Mean, median and histogram of every labelled dimension."""
    long = pool.select(
        SET, F.inline(F.array(*[F.struct(F.lit(d).alias("field"), F.col(d).alias("value")) for d in DIMENSIONS]))
    )
    # labels sit on a small scale, so medians are taken over counted values
    counted = long.groupBy(SET, "field", "value").agg(F.count(F.lit(1)).alias("times"))
    v, w = F.col("value"), F.when(F.col("value").isNotNull(), F.col("times")).otherwise(F.lit(0))
    return counted.groupBy(SET, "field").agg(
        F.sum(w).alias("labelled"),
        F.round(F.try_divide(F.sum(v * w), F.sum(w)), 3).alias("mean"),
        F.round(F.percentile(v, F.lit(0.5), w), 3).alias("median"),
        *[F.sum(F.when(F.bround(v) == b, w).otherwise(0)).alias(f"h{b}") for b in range(5)],
    )


def disagreements(
    preds: DataFrame, pool: DataFrame, scorer_a: str, scorer_b: str,
    top_k: int = 5, low_rank: int = 5, min_gap: int = 3,
) -> DataFrame:
    """Where people and scorers, or two scorers, do not agree."""
    labels = pool.select(SET, "candidate_id", "human_score")
    a = preds.where(F.col("scorer") == scorer_a).select(
        SET, "candidate_id", F.col("rank").alias("rank_a"), F.col("score").alias("score_a")
    )
    b = preds.where(F.col("scorer") == scorer_b).select(
        SET, "candidate_id", F.col("rank").alias("rank_b"), F.col("score").alias("score_b")
    )
    # one pass over the outer join; each row may disagree in more than one way
    wide = labels.where(F.col("human_score").isNotNull()).join(a, [SET, "candidate_id"], "full_outer").join(
        b, [SET, "candidate_id"], "left"
    )
    human, gap = F.col("human_score"), F.abs(F.col("rank_a") - F.col("rank_b"))
    kinds = F.array_compact(
        F.array(
            F.when((F.col("rank_a") <= top_k) & (human <= 1.0), F.lit("false_positive")),
            F.when((human >= 3.0) & (F.col("rank_a").isNull() | (F.col("rank_a") > low_rank)), F.lit("false_negative")),
            F.when(gap >= min_gap, F.lit("scorer_divergence")),
        )
    )
    diverges = F.col("disagreement_type") == "scorer_divergence"
    return wide.select("*", F.explode(kinds).alias("disagreement_type")).select(
        SET,
        "candidate_id",
        "disagreement_type",
        "human_score",
        F.col("rank_a").alias("model_rank"),
        F.col("score_a").alias("model_score"),
        F.when(diverges, F.col("rank_b")).alias("model_b_rank"),
        F.when(diverges, F.col("score_b")).alias("model_b_score"),
        F.when(diverges, gap).alias("rank_gap"),
    )


def regression_check(cases: DataFrame, preds: DataFrame, default_k: int = 5) -> DataFrame:
    """Evaluate each expectation against one scorer's predictions.

    Cases of candidate sets the scorer has not ranked are reported as skipped."""
    known = preds.select(SET).distinct().withColumn("_known", F.lit(True))
    items = preds.select(
        SET, "candidate_id", F.col("rank").alias("new_rank"), "previous_rank", "status", F.lit(True).alias("_found")
    )
    rows = cases.join(known, SET, "left").join(items, [SET, "candidate_id"], "left")
    expect = F.col("expectation")
    rank, prev, status = F.col("new_rank"), F.col("previous_rank"), F.col("status")
    k = F.coalesce("k", F.lit(default_k))
    ranked = status.isNull() | (status == "ranked")
    moves = expect.isin("rank_up", "rank_down")
    shown = F.coalesce(status, F.lit("None"))
    passed = first_match(
        [
            (F.col("_known").isNull(), F.lit(None).cast("boolean")),
            (F.col("_found").isNull(), False),
            (moves & prev.isNull(), False),
            (expect == "rank_up", rank < prev),
            (expect == "rank_down", rank > prev),
            (expect == "in_top_k", (rank <= k) & ranked),
            (expect == "out_of_top_k", (rank > k) | ~ranked),
            (expect == "rejected", F.coalesce(status.startswith("rejected"), F.lit(False))),
        ],
        False,
    )
    message = first_match(
        [
            (F.col("_known").isNull(), "Skipped: another candidate set."),
            (F.col("_found").isNull(), "Candidate is absent from the prediction document (not scored)."),
            ((expect == "rank_up") & prev.isNull(), "No previous rank recorded; cannot verify upward movement."),
            ((expect == "rank_down") & prev.isNull(), "No previous rank recorded; cannot verify downward movement."),
            (moves, F.format_string("Moved from #%d to #%d.", prev, rank)),
            (
                expect.isin("in_top_k", "out_of_top_k"),
                F.format_string("Rank #%d against K=%d (status=%s).", rank, k, shown),
            ),
            (expect == "rejected", F.concat(F.lit("Status is "), shown, F.lit("."))),
        ],
        F.concat(F.lit("Unknown expectation '"), expect, F.lit("'.")),
    )
    return rows.select(
        SET, "candidate_id", "expectation", passed.alias("passed"), message.alias("message"),
        F.when(F.col("_known").isNotNull(), rank).alias("new_rank"), F.col("_known").isNull().alias("skipped"),
    )


def regression_totals(checked: DataFrame) -> DataFrame:
    ran = ~F.col("skipped")
    return checked.groupBy(SET).agg(
        F.sum(ran.cast("long")).alias("total"),
        F.sum((ran & F.col("passed")).cast("long")).alias("passed"),
        F.sum((ran & ~F.col("passed")).cast("long")).alias("failed"),
        F.sum(F.col("skipped").cast("long")).alias("skipped"),
    )


def derive_regressions(preds: DataFrame, pool: DataFrame, k: int = 5) -> DataFrame:
    """Hard cases of a labelled run: each candidate joins the first group it fits."""
    rows = preds.join(
        pool.where(F.col("human_score").isNotNull()).select(SET, "candidate_id", "human_score"), [SET, "candidate_id"]
    )
    human, rank = F.col("human_score"), F.col("rank")
    rejected = F.coalesce("status", F.lit("ranked")) != "ranked"
    group = first_match(
        [
            ((human >= 4.0) & ((rank > k) | rejected), "strong_positives"),
            ((human <= 2.0) & (rank <= k) & ~rejected, "false_positives"),
            ((human >= 3.0) & rejected, "false_negatives"),
        ]
    )
    return (
        rows.withColumn("case_group", group)
        .where(F.col("case_group").isNotNull())
        .select(
            SET, "scorer", "candidate_id", "human_score", "case_group",
            F.when(F.col("case_group") == "false_positives", "out_of_top_k").otherwise("in_top_k").alias("expectation"),
            F.lit(k).cast("long").alias("k"),
        )
    )
