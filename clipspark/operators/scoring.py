"""Score formulas, blends, caps and fallbacks over candidate tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import clamp, digest, first_match, flag_list, pin

# Weights, penalties, ceilings and answer values of the versioned formulas.
V2_WEIGHTS = {
    "story_payoff": 1.4, "retention": 1.4, "hook": 1.2, "standalone": 1.1,
    "shareability": 1.0, "humor": 0.8, "surprise": 0.8, "emotion": 0.7,
}
V21_WEIGHTS = {
    "hook": 0.12, "standalone": 0.14, "story_payoff": 0.18, "emotion": 0.08,
    "humor": 0.10, "surprise": 0.08, "retention": 0.18, "shareability": 0.12,
}
V21_REQUIRED = (
    "hook", "standalone", "story_payoff", "emotion", "humor", "surprise", "retention", "shareability",
    "boringness", "context_dependency", "setup_only", "transitional", "outside_payoff", "reason",
)
GRADE_VALUES = {"strong": 100.0, "decent": 66.667, "weak": 33.333, "dead": 0.0}
BINARY_VALUES = {"yes": 100.0, "no": 0.0}


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _on(flag: str | Column, value: float) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.when(F.coalesce(flag, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))


def score_v2(features: DataFrame) -> DataFrame:
    """Weighted dimensions less penalties, blended 75/25 with the model's own score and
    held under ceilings. A missing dimension counts as 50."""

    def dim(name: str) -> Column:
        return clamp(F.coalesce(F.col(name), F.lit(50.0)), 0.0, 100.0)

    boring, dependent, own = dim("boringness"), dim("context_dependency"), dim("llm_quality_score")
    positive = _sum([dim(n) * w for n, w in V2_WEIGHTS.items()]) / F.lit(sum(V2_WEIGHTS.values()))
    penalty = (
        F.greatest(F.lit(0.0), boring - 35.0) * 0.7
        + F.greatest(F.lit(0.0), dependent - 35.0) * 0.5
        + _on("setup_only", 25.0)
        + _on("transitional", 30.0)
        + _on("outside_payoff", 20.0)
    )
    blended = 0.75 * F.greatest(F.lit(0.0), positive - penalty) + 0.25 * own
    ceiling = F.least(
        *[
            F.when(F.coalesce(cond, F.lit(False)), F.lit(top)).otherwise(F.lit(100.0))
            for cond, top in (
                (F.col("transitional"), 35.0),
                (F.col("setup_only"), 40.0),
                (F.col("outside_payoff"), 45.0),
                (boring >= 75.0, 35.0),
                (dependent >= 75.0, 40.0),
            )
        ]
    )
    return features.withColumn("score", F.round(clamp(F.least(blended, ceiling), 0.0, 100.0), 2))


def score_v2_1(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Second formula; a row lacking a required field is rejected, never imputed.

    Returns (scored, rejected)."""
    missing = flag_list([(F.col(c).isNull(), c) for c in V21_REQUIRED], ",")
    rows = features.withColumn("_missing", missing)
    rejected = rows.where(F.col("_missing") != "").withColumnRenamed("_missing", "missing")

    def dim(name: str) -> Column:
        return clamp(F.col(name), 0.0, 100.0)

    positive = _sum([dim(n) * w for n, w in V21_WEIGHTS.items()])
    penalty = dim("boringness") * 0.25 + dim("context_dependency") * 0.12 + (_on("setup_only", 15.0) + _on("transitional", 12.0))
    caps = [
        ("setup_only_low_payoff", 40.0, F.col("setup_only") & (dim("story_payoff") < 30.0)),
        ("transitional_low_retention", 35.0, F.col("transitional") & (dim("retention") < 30.0)),
        ("extreme_boringness", 30.0, (dim("boringness") >= 85.0) & (dim("story_payoff") < 25.0)),
    ]
    lowest = F.least(*[F.when(cond, F.lit(top)).otherwise(F.lit(1000.0)) for _, top, cond in caps])
    scored = (
        rows.where(F.col("_missing") == "")
        .drop("_missing")
        .withColumn("positive_score", positive)
        .withColumn("total_penalty", penalty)
        .withColumn("applied_caps", flag_list([(cond, f"{name}:{int(top)}") for name, top, cond in caps], ","))
        .withColumn(
            "score", F.round(clamp(F.least(F.col("positive_score") - F.col("total_penalty"), lowest), 0.0, 100.0), 2)
        )
    )
    return scored, rejected


def score_logprob(top_logprobs: DataFrame, values: dict[str, float], keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Probability-weighted mean over the answer tokens, null where none was offered.

    ``top_logprobs``: keys, token, logprob."""
    token = F.lower(F.trim(F.regexp_replace("token", r"(?U)[^\w]", "")))
    answer = first_match([(F.col("_t") == t, v) for t, v in values.items()], F.lit(None).cast("double"))
    rows = top_logprobs.withColumn("_t", token).withColumn("_v", answer)
    mass = F.when(F.col("_v").isNotNull(), F.exp("logprob"))
    return rows.groupBy(*keys).agg(
        F.round(F.try_divide(F.sum(F.col("_v") * mass), F.sum(mass)), 4).alias("score")
    )


def rank_fraction(df: DataFrame, value: str, keys: Sequence[str], out: str) -> DataFrame:
    """Tie-averaged rank of ``value`` within its key, scaled to [0, 1] (0.5 if alone).

    Only counts per distinct value are ordered per key; rows never are."""
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    average = F.coalesce(F.sum("_n").over(below), F.lit(0)) + (F.col("_n") - 1) / 2.0
    total = F.sum("_n").over(whole)
    ranks = counts.select(
        *keys, value, F.when(total == 1, F.lit(0.5)).otherwise(F.try_divide(average, total - 1)).alias(out)
    )
    return df.join(ranks, [*keys, value])


def blend_ranks(df: DataFrame, a: str, b: str, keys: Sequence[str], weight: float = 0.4) -> DataFrame:
    """``weight`` of the rank by ``a`` and the rest of the rank by ``b``, times 100.

    A row without ``b`` is an error unless ``weight`` is 1, which ignores ``b``."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError("weight must be in [0, 1]")
    ranked = rank_fraction(df, a, keys, "a_rank")
    if weight >= 1.0:
        return ranked.withColumn("b_rank", F.lit(0.0)).withColumn("score", F.round(F.col("a_rank") * 100.0, 4))
    checked = ranked.withColumn(
        b, F.when(F.col(b).isNull(), F.raise_error(F.lit(f"a candidate has no {b}")).cast("double")).otherwise(F.col(b))
    )
    both = rank_fraction(checked, b, keys, "b_rank")
    mixed = F.lit(weight) * F.col("a_rank") + F.lit(1.0 - weight) * F.col("b_rank")
    return both.withColumn("score", F.round(mixed * 100.0, 4))


def score_multimodal(results: DataFrame, packages: DataFrame) -> DataFrame:
    """The model's own quality score under three caps; thin visual evidence lowers the
    confidence, never the score."""
    r = results.join(packages.select("candidate_id", F.col("insufficient").alias("_thin")), "candidate_id", "left")
    dull = (F.col("boringness") >= 85.0) & (F.col("retention") <= 25.0)
    elsewhere = F.col("outside_payoff") & ~F.col("observable_event")
    headless = F.col("missing_setup") & (F.col("context_dependency") >= 80.0)
    q = F.col("quality_score")
    r = pin(r, _s1=F.when(dull, F.least(q, F.lit(35.0))).otherwise(q))
    r = pin(r, _s2=F.when(elsewhere, F.least("_s1", F.lit(40.0))).otherwise(F.col("_s1")))
    s1, s2 = F.col("_s1"), F.col("_s2")
    s3 = F.when(headless, F.least(s2, F.lit(45.0))).otherwise(s2)
    thin = F.coalesce("_thin", F.lit(False)) | F.col("insufficient_visual_evidence")
    lowered = F.greatest(F.lit(0.2), F.least("confidence", F.lit(0.4)))
    caps = flag_list(
        [
            (dull & (q > 35.0), "boring_low_retention_cap:35.0"),
            (elsewhere & (s1 > 40.0), "outside_payoff_unobservable_cap:40.0"),
            (headless & (s2 > 45.0), "missing_setup_context_cap:45.0"),
            (
                thin,
                F.concat(F.lit("insufficient_visual_evidence_confidence_lowered:"), F.format_string("%.2f", F.round(lowered, 2))),
            ),
        ],
        ",",
    )
    return r.select(
        "candidate_id",
        F.round(clamp(s3, 0.0, 100.0), 2).alias("score"),
        F.when(thin, lowered).otherwise(F.col("confidence")).alias("effective_confidence"),
        caps.alias("applied_caps"),
    )


def with_fallback(primary: DataFrame, heuristic: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Primary scores, with the heuristic one where the primary is absent or failed.

    ``primary``: keys, score, error. Under ``strict`` a failure fails the query."""
    p = primary.select(*keys, F.col("score").alias("_ps"), F.col("error").alias("_err"))
    rows = heuristic.join(p, list(keys), "left")
    failed = F.col("_ps").isNull() | F.col("_err").isNotNull()
    why = F.coalesce("_err", F.lit("no primary result"))
    score = F.when(~failed, F.col("_ps"))
    if strict:
        score = score.otherwise(F.raise_error(why).cast("double"))
    else:
        score = score.otherwise(F.col("score"))
    return rows.select(
        *keys, score.alias("score"), failed.alias("fallback_used"), F.when(failed, why).alias("fallback_reason")
    )


def fallback_summary(scored: DataFrame, key: str, order: str) -> DataFrame:
    """Whether any candidate of a run fell back, and the reason of the first that did."""
    used = F.col("fallback_used")
    return scored.groupBy(key).agg(
        F.bool_or(used).alias("any_fallback"),
        F.sum(used.cast("long")).alias("fallbacks"),
        F.min_by(F.when(used, F.col("fallback_reason")), F.when(used, F.col(order))).alias("first_reason"),
    )


def package_hashes(cands: DataFrame, version: str = "package_v1_1", max_edge: int = 768) -> DataFrame:
    """Content address of a candidate's evidence package."""
    return cands.withColumn(
        "package_hash",
        digest(
            F.lit(version), F.col("candidate_set_id"), F.col("source_id"), F.col("candidate_seq"),
            F.col("start_ms"), F.col("end_ms"), F.lit(max_edge), sep=":",
        ),
    )


def request_hashes(
    packages: DataFrame, provider: str, model: str, prompt_version: str, schema_version: str,
    effort: str | None = None, temperature: float | None = None,
) -> DataFrame:
    """Identity of one model request; changing any setting changes it."""
    return packages.withColumn(
        "request_hash",
        digest(
            F.col("package_hash"), F.lit(provider), F.lit(model), F.lit(prompt_version), F.lit(schema_version),
            F.lit((effort or "none").lower()), F.lit("none" if temperature is None else f"{temperature:.4f}"), sep=":",
        ),
    )


FORMULAS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "v2": score_v2,
    "v2_1": lambda df: score_v2_1(df)[0],
}
