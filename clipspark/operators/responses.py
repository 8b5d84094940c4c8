"""Turning stored model answers into typed tables.

Answers are text that should hold one JSON object, and sometimes does not. Parsing,
coercion and the editorial safety rules are column expressions, so a stage's answers
are read once and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import clamp, digest, first_match, flag_list, pin

# Classes, phrases and thresholds of the editorial and critic rules.
VALID_CLASSES = ("FATAL_REJECT", "WEAK", "MAYBE", "GOOD", "STRONG")
SURVIVING = ("STRONG", "GOOD", "MAYBE", "WEAK")
MIN_REASON_WORDS = 4
VAGUE_REASONS = (
    r"^\s*(they|the participants?|the speakers?|the hosts?)\s+(continue|keep|are|is)\b",
    r"^\s*(a|the)?\s*(general|casual|normal|ordinary)\s+(conversation|discussion|chat)\b",
    r"^\s*(discussion|conversation|talk|chat)\s+about\b",
    r"\bcontinues? (?:to )?(?:discuss|talk|chat)\b",
)
FATAL_PHRASES = (
    "dead air", "duplicate", "near-duplicate", "technical corruption", "cannot be decoded",
    "no meaningful content", "no understandable event", "no useful event",
)
HARD_REJECT_CONFIDENCE = 0.85
LEGACY_CUTS = ("REJECT", "NO", "FALSE", "CUT", "DROP")
CRITIC_WORDS = ("", "KEEP", "REJECT", "YES", "TRUE", "PUBLISH", "NO", "FALSE", "CUT", "DROP")
CONTENT_TYPES = ("stream", "interview", "vlog", "game", "challenge", "other")
PRICES = {"gpt-4o-mini": (0.150, 0.600), "gpt-4o": (2.50, 10.00)}
PERCENT_FIELDS = (
    "visual_event", "reaction", "emotion", "humor", "surprise", "energy", "standalone", "retention",
    "shareability", "boringness", "context_dependency", "quality_score",
)
UNITS = (
    "scroll_stop", "hook", "payoff", "surprise", "humor", "tension", "emotion", "visual_interest", "novelty",
    "self_contained", "shareability", "context_dependency", "dead_air",
)


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def parse_responses(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Add ``body`` (field name to text, null when unusable) and ``error``.

    Fences are stripped; text that is not JSON is retried from its first to its last
    brace; anything but an object is an error."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(column)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    valid = F.try_parse_json(F.col("_bare")).isNotNull()
    first = F.instr("_bare", "{")
    last = F.length("_bare") - F.instr(F.reverse(F.col("_bare")), "}") + 1
    braces = (first > 0) & F.col("_bare").contains("}") & (last > first)
    text = (
        F.when(valid, F.col("_bare"))
        .when(braces, F.substring(F.col("_bare"), first, last - first + 1))
    )
    rows = pin(pin(raw, _bare=bare), _text=text)
    rows = pin(rows, _ok=_is_object(F.col("_text")))
    error = first_match(
        [
            (F.col(column).isNull() | (F.col("_bare") == ""), "Empty model response"),
            (F.col("_ok"), F.lit(None).cast("string")),
            (F.try_parse_json(F.col("_text")).isNotNull(), "Expected a JSON object"),
        ],
        "Response is not JSON",
    )
    body = F.when(F.col("_ok"), F.from_json("_text", "map<string,string>"))
    return pin(rows, body=body, error=error).drop("_bare", "_text", "_ok")


def _get(*names: str) -> Column:
    """Text of the first of the fields that is there (an explicit null counts as there
    in JSON but reads as null here)."""
    return F.coalesce(*[F.try_element_at("body", F.lit(n)) for n in names])


def as_unit(value: Column, default: float = 0.0) -> Column:
    n = value.try_cast("double")
    scaled = clamp(F.when(n > 1.0, n / 100.0).otherwise(n), 0.0, 1.0)
    return F.when(n.isNotNull(), scaled).otherwise(F.lit(default))


def as_bool(value: Column, default: Column | bool = False) -> Column:
    low = F.lower(F.trim(value))
    number = value.try_cast("double")
    default = default if isinstance(default, Column) else F.lit(default)
    return (
        F.when(low.isin("true", "yes", "1"), F.lit(True))
        .when(low.isin("false", "no", "0"), F.lit(False))
        .when(number.isNotNull(), number != 0)
        .otherwise(default)
    )


def as_penalty(value: Column, default: Column | float = 0.0) -> Column:
    n = value.try_cast("double")
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(n.isNotNull(), clamp(-F.abs(n), -100.0, 0.0)).otherwise(default)


def as_list(value: Column, limit: int = 8) -> Column:
    """A JSON array's non-blank texts (at most ``limit``), or one text as a list."""
    items = F.transform(F.from_json(value, "array<string>"), lambda x: F.trim(x))
    many = F.slice(F.filter(items, lambda x: x != ""), 1, limit)
    one = F.when(F.trim(value) != "", F.array(F.trim(value)))
    return F.coalesce(F.when(value.startswith("["), many).otherwise(one), F.array().cast("array<string>"))


def as_reason(value: Column) -> Column:
    t = F.trim(value)
    return F.when((t != "") & ~F.lower(t).isin("null", "none", "n/a", "-"), t)


def _fatal_evidence(text: Column) -> Column:
    t = F.lower(text)
    named = F.lit(False)
    for phrase in FATAL_PHRASES:
        named = named | t.contains(phrase)
    outside = t.contains("payoff") & t.contains("outside") & (t.contains("no useful") | t.contains("nothing"))
    unreadable = (
        (t.contains("severe") | t.contains("unintelligible"))
        & (t.contains("transcript") | t.contains("asr"))
        & (t.contains("no visual") | t.contains("no useful visual"))
    )
    return named | outside | unreadable


def _vague(reason: Column) -> Column:
    words = F.size(F.split(F.trim(reason), r"\s+"))
    hit = F.lit(False)
    for pattern in VAGUE_REASONS:
        hit = hit | F.lower(reason).rlike(pattern)
    return reason.isNull() | (words < MIN_REASON_WORDS) | hit


def _append(reasons: Column, cond: Column, text: Column | str) -> Column:
    text = text if isinstance(text, Column) else F.lit(text)
    return F.when(F.coalesce(cond, F.lit(False)), F.concat(reasons, F.array(text))).otherwise(reasons)


def editorial_table(cands: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One coerced editorial row per candidate; a missing or broken answer leaves the
    candidate WEAK with no confidence, never rejected."""
    parsed = parse_responses(responses)
    rows = cands.join(parsed.select(*keys, "body", "error", F.lit(True).alias("_there")), list(keys), "left")
    raw = F.upper(F.trim(F.coalesce(_get("editorial_class"), F.lit(""))))
    named = F.when(F.col("_raw") == "REJECT", "FATAL_REJECT").otherwise(F.col("_raw"))
    odd = (F.col("_raw") != "") & ~F.col("_raw").isin(*VALID_CLASSES, "REJECT")
    usable = F.col("body").isNotNull()
    units = {u: F.round(as_unit(_get(u)), 6) for u in UNITS}
    rows = pin(rows, _raw=raw)
    rows = pin(rows, editorial_class=F.when(usable & named.isin(*VALID_CLASSES), named).otherwise("WEAK"))
    fields = {
        **units,
        "salvageable": as_bool(_get("salvageable"), F.col("editorial_class") != "FATAL_REJECT"),
        "internal_moment": as_bool(_get("best_internal_moment_present")),
        "needs_more_setup": as_bool(_get("needs_more_setup")),
        "needs_refinement": as_bool(_get("needs_boundary_refinement")),
        "payoff_inside": as_bool(_get("payoff_inside_candidate")),
        "standalone_probability": F.round(as_unit(_get("standalone_after_refinement_probability")), 6),
        "quality_penalty": as_penalty(_get("quality_penalty", "penalty")),
        "fatal_evidence": F.array_join(as_list(_get("fatal_reject_evidence", "fatal_evidence")), " "),
        "reason_to_watch": as_reason(_get("reason_to_watch")),
        "reject_reasons": _append(
            as_list(_get("reject_reasons")),
            usable & odd,
            F.concat(F.lit("unrecognized editorial_class '"), F.col("_raw"), F.lit("' treated as WEAK")),
        ),
        "confidence": F.round(as_unit(_get("confidence")), 6),
        "parse_failed": ~usable,
        "error": F.when(~usable, F.coalesce("error", F.lit("no response stored"))),
    }
    return pin(rows, **fields).select(*cands.columns, "editorial_class", *fields)


def editorial_gates(editorial: DataFrame) -> DataFrame:
    """Keep uncertainty about context, transcript or boundaries from deleting anything.

    A degraded row passes untouched."""
    dep = F.col("context_dependency")
    derived = (
        F.when(F.col("needs_more_setup"), -10.0).otherwise(0.0)
        + F.when(F.col("needs_refinement"), -5.0).otherwise(0.0)
        + F.when(dep > 0.5, -20.0 * (dep - 0.5)).otherwise(0.0)
        + F.when(F.col("internal_moment") & ~F.col("payoff_inside"), -5.0).otherwise(0.0)
    )
    penalty = F.least(F.col("quality_penalty"), F.greatest(F.lit(-40.0), derived))
    live = ~F.col("parse_failed")
    fatal = live & (F.col("editorial_class") == "FATAL_REJECT")
    unfounded = fatal & (
        F.col("salvageable") | F.col("internal_moment") | F.col("payoff_inside") | ~_fatal_evidence(F.col("fatal_evidence"))
    )
    vague = live & ~fatal & _vague(F.col("reason_to_watch"))
    reasons = _append(
        F.col("reject_reasons"), fatal & (F.size("reject_reasons") == 0), "model rejected without naming a reason"
    )
    reasons = _append(reasons, unfounded, "fatal rejection downgraded: source window contains recoverable evidence")
    reasons = _append(
        reasons,
        vague,
        F.when(F.col("reason_to_watch").isNull(), "no reason to watch was produced").otherwise(
            "reason to watch describes continuation, not a concrete moment"
        ),
    )
    gated = pin(editorial, _new_reasons=reasons, _vague=vague, recovered=unfounded, _penalty=penalty)
    worst = first_match(
        [
            (F.col("parse_failed"), F.col("quality_penalty")),
            (F.col("recovered"), F.least("_penalty", F.lit(-30.0))),
            (F.col("_vague"), F.least("_penalty", F.lit(-25.0))),
        ],
        F.col("_penalty"),
    )
    out = pin(
        gated,
        reject_reasons=F.col("_new_reasons"),
        quality_penalty=F.round(worst, 6),
        editorial_class=F.when(F.col("recovered") | F.col("_vague"), "WEAK").otherwise(F.col("editorial_class")),
    )
    return out.select(*editorial.columns, "recovered")


def recover_rejections(gated: DataFrame, key: str, tie: str) -> DataFrame:
    """Where absolute judging rejected nearly a whole set, restore its best recoverable
    candidates, up to a quarter of the set and at most 16."""
    fatal = F.col("editorial_class") == "FATAL_REJECT"
    counts = gated.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum((~fatal).cast("long")).alias("_alive"),
        F.sum((fatal | F.col("recovered")).cast("long")).alias("_claims"),
    )
    quarter = F.ceil(F.col("_n") * 0.25)
    bad = (F.col("_n") >= 4) & (
        (F.col("_alive") < F.greatest(F.lit(2), quarter)) | (F.col("_claims") >= F.ceil(F.col("_n") * 0.75))
    )
    quota = F.greatest(F.lit(0), F.least(F.lit(16), F.greatest(F.lit(2), quarter)) - F.col("_alive"))
    limits = counts.select(key, F.when(bad, quota).otherwise(F.lit(0)).alias("_quota"))
    settled = (
        ~F.col("salvageable")
        & ~F.col("internal_moment")
        & ~F.col("payoff_inside")
        & _fatal_evidence(F.col("fatal_evidence"))
        & (F.col("confidence") >= 0.85)
    )
    best = Window.partitionBy(key).orderBy(
        (~F.col("internal_moment")).cast("int"),
        (~F.col("payoff_inside")).cast("int"),
        (~F.col("salvageable")).cast("int"),
        F.col("standalone_probability").desc(),
        F.col("scroll_stop").desc(),
        F.col("dead_air"),
        F.col(tie),
    )
    chosen = (
        gated.where(fatal & ~settled)
        .select(key, tie, "internal_moment", "payoff_inside", "salvageable", "standalone_probability", "scroll_stop", "dead_air")
        .withColumn("_rn", F.row_number().over(best))
        .where(F.col("_rn") <= 16)
        .join(limits, key)
        .where(F.col("_rn") <= F.col("_quota"))
        .select(key, tie, F.lit(True).alias("_back"))
    )
    back = F.coalesce("_back", F.lit(False))
    positive = F.col("salvageable") | F.col("internal_moment") | F.col("payoff_inside")
    return (
        gated.join(chosen, [key, tie], "left")
        .withColumn("reject_reasons", _append(F.col("reject_reasons"), back, "recovered after pathological rejection distribution"))
        .withColumn("editorial_class", F.when(back, F.when(positive, "MAYBE").otherwise("WEAK")).otherwise(F.col("editorial_class")))
        .withColumn("quality_penalty", F.when(back, F.least("quality_penalty", F.lit(-35.0))).otherwise(F.col("quality_penalty")))
        .withColumn("recovered", F.col("recovered") | back)
        .drop("_back")
    )


def critic_table(cands: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Critic verdicts: only an explicit, evidenced and confident hard reject removes a
    candidate; an old-style rejection is a penalty; no answer keeps it."""
    parsed = parse_responses(responses)
    rows = cands.join(parsed.select(*keys, "body", "error"), list(keys), "left")
    usable = F.col("body").isNotNull()
    raw = F.upper(F.trim(F.coalesce(_get("decision"), F.lit(""))))
    evidence = F.concat_ws(
        " ", as_list(_get("failure_modes")), as_list(_get("fatal_evidence", "fatal_reject_evidence"))
    )
    confidence = as_unit(_get("confidence"))
    hard = (
        as_bool(_get("hard_reject", "fatal_reject"))
        & ~as_bool(_get("keep_for_comparison"), True)
        & _fatal_evidence(evidence)
        & (confidence >= HARD_REJECT_CONFIDENCE)
    )
    fallback = F.when(F.col("_raw").isin(*LEGACY_CUTS), -30.0).otherwise(0.0)
    new_style = F.lit(False)
    for name in ("penalty", "critic_penalty", "failure_modes", "keep_for_comparison"):
        new_style = new_style | F.map_contains_key("body", name)
    return (
        pin(pin(rows, _raw=raw), hard_reject=F.coalesce(usable & hard, F.lit(False)))
        .select(
            *cands.columns,
            F.when(F.col("hard_reject"), "REJECT").otherwise("KEEP").alias("decision"),
            "hard_reject",
            F.when(usable, F.round(confidence, 6)).otherwise(0.0).alias("confidence"),
            F.when(usable, as_penalty(_get("penalty", "critic_penalty"), fallback)).otherwise(0.0).alias("penalty"),
            F.when(usable, F.trim(F.coalesce(_get("reason"), F.lit(""))))
            .when(F.col("error").isNotNull(), "Critic unavailable; candidate retained.")
            .otherwise("Critic skipped: no response stored.")
            .alias("reason"),
            F.coalesce(
                ~usable | ~F.col("_raw").isin(*CRITIC_WORDS) | ((F.col("_raw") == "") & ~new_style), F.lit(True)
            ).alias("parse_failed"),
        )
    )


def usage_report(calls: DataFrame) -> DataFrame:
    """Calls, tokens, cache hits, failures and estimated cost per model and stage, with
    totals. ``calls``: model, stage, tokens_in, tokens_out, cached, failed."""
    real = ~F.col("cached") & ~F.col("failed")
    sums = calls.rollup("model", "stage").agg(
        F.sum(real.cast("long")).alias("calls"),
        F.sum(F.when(real, F.col("tokens_in")).otherwise(0)).alias("tokens_in"),
        F.sum(F.when(real, F.col("tokens_out")).otherwise(0)).alias("tokens_out"),
        F.sum(F.col("cached").cast("long")).alias("cache_hits"),
        F.sum((F.col("failed") & ~F.col("cached")).cast("long")).alias("failed_calls"),
    )
    price = first_match([(F.col("model") == m, F.array(F.lit(a), F.lit(b))) for m, (a, b) in PRICES.items()], F.array(F.lit(0.0), F.lit(0.0)))
    cost = F.col("tokens_in") * price[0] / 1_000_000 + F.col("tokens_out") * price[1] / 1_000_000
    return sums.where(F.col("model").isNotNull()).select(
        "model",
        F.coalesce("stage", F.lit("ALL")).alias("stage"),
        "calls", "tokens_in", "tokens_out",
        (F.col("tokens_in") + F.col("tokens_out")).alias("tokens_total"),
        "cache_hits", "failed_calls",
        F.round(cost, 6).alias("estimated_cost_usd"),
    )


def chapter_contexts(chapters: DataFrame, responses: DataFrame) -> DataFrame:
    """Chapter summaries from stored answers; an absent or broken answer leaves an
    empty, degraded row with its reason."""
    parsed = parse_responses(responses).select("source_id", "chapter", "body", "error")
    rows = chapters.join(parsed, ["source_id", "chapter"], "left")

    def text(name: str) -> Column:
        return F.trim(F.coalesce(_get(name), F.lit(""))).alias(name)

    def many(name: str) -> Column:
        return F.array_join(as_list(_get(name), 12), "|").alias(name)

    return rows.select(
        "source_id", "chapter", text("summary"), text("topic"), many("participants"), many("events"), many("setups"),
        many("payoffs"), many("open_loops"),
        F.col("body").isNull().alias("degraded"),
        F.when(F.col("body").isNull(), F.coalesce("error", F.lit("no response stored"))).alias("degraded_reason"),
    )


def source_context(sources: DataFrame, chapters: DataFrame, responses: DataFrame) -> DataFrame:
    """Whole-source understanding from stored answers, with its identity hash."""
    parsed = parse_responses(responses).select("source_id", "body", "error")
    counts = chapters.groupBy("source_id").agg(F.count(F.lit(1)).alias("chapter_count"))
    kind = F.lower(F.trim(F.coalesce(_get("content_type"), F.lit("other"))))

    def many(name: str) -> Column:
        return F.array_join(as_list(_get(name), 12), "|")

    rows = (
        sources.select("source_id")
        .join(counts, "source_id", "left")
        .join(parsed, "source_id", "left")
        .select(
            "source_id",
            F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
            F.trim(F.coalesce(_get("video_summary"), F.lit(""))).alias("video_summary"),
            F.when(kind.isin(*CONTENT_TYPES), kind).otherwise("other").alias("content_type"),
            many("main_topics").alias("main_topics"),
            many("conflicts").alias("conflicts"),
            F.col("body").isNull().alias("degraded"),
            F.when(F.col("body").isNull(), F.coalesce("error", F.lit("no response stored"))).alias("degraded_reason"),
        )
    )
    return rows.withColumn(
        "context_hash",
        digest(F.col("source_id"), F.col("chapter_count"), F.col("video_summary"), F.col("content_type"), F.col("main_topics"), F.col("conflicts")),
    )


def multimodal_table(responses: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Answers within the contract, and a reject table naming each breach.

    Returns (accepted, rejected)."""
    parsed = parse_responses(responses)
    need_bool = ("observable_event", "visual_payoff")

    def num(name: str) -> Column:
        return _get(name).try_cast("double")

    def flag(name: str) -> Column:
        return F.lower(F.trim(_get(name)))

    breaches = flag_list(
        [(F.col("body").isNull(), F.col("error"))]
        + [
            (F.col("body").isNotNull() & ~F.coalesce(num(n).between(0, 100), F.lit(False)), f"{n} outside 0-100 or missing")
            for n in PERCENT_FIELDS
        ]
        + [(F.col("body").isNotNull() & ~F.coalesce(num("confidence").between(0, 1), F.lit(False)), "confidence outside 0-1 or missing")]
        + [(F.col("body").isNotNull() & ~F.coalesce(flag(n).isin("true", "false"), F.lit(False)), f"{n} is not a boolean") for n in need_bool]
        + [(F.col("body").isNotNull() & _get("reason").isNull(), "reason missing")]
    )
    rows = pin(parsed, breaches=breaches)
    fields = {
        **{n: num(n) for n in (*PERCENT_FIELDS, "confidence")},
        **{n: flag(n) == "true" for n in need_bool},
        **{n: as_bool(_get(n)) for n in ("outside_payoff", "missing_setup", "insufficient_visual_evidence")},
        "reason": _get("reason"),
    }
    accepted = pin(rows.where(F.col("breaches") == ""), **fields).select(*keys, *fields)
    return accepted, rows.where(F.col("breaches") != "").select(*keys, "breaches")
