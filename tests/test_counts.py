"""Counts of words on Arrow batches against the same patterns as column expressions."""

import random

from pyspark.sql import functions as F

from clipspark.functions.exprs import tokens
from clipspark.operators import lexical

ODD = [
    "a", "Так", "ёЖ", "ÉTÉ", "GROß", "ß", "ẞ", "ΟΔΟΣ", "ΟΔΟΣ.", "İSTANBUL", "ǅ", "²½", "٣٤", "1,5", "1.5x", "12abc", "a_b", "_", "__x", "x‿y", "été",
    "́ab", "Ⓐⓑ", "中文", "a‍b", "100%", "$5", "€", "₽7.0", "3.14.15", "don't", "«Да»", "NASA!", "WOW", "why", "but", "NO", "-", "so-so", "ab cd", "wow...wow", "1,2,3",
]


def _plain(df):
    """The counts as they were before: patterns over the whole text."""
    t = F.trim("text")
    loud = F.filter(F.split(t, r"\s+"), lambda x: (F.length(x) > 2) & (F.upper(x) == x) & (F.lower(x) != x))
    some = lambda words: F.arrays_overlap(F.slice("w", 1, 25), F.array(*[F.lit(w) for w in words]))
    listed = lambda words: F.size(F.filter("w", lambda w: w.isin(*words)))
    top = F.coalesce(F.array_max(F.transform(F.array_distinct("w"), lambda x: F.size("w") - F.size(F.array_remove("w", x)))), F.lit(0))
    return df.withColumn("w", tokens(t)).select(
        "id", F.size("w").alias("_n"), (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).alias("_bangs"),
        listed(lexical.EMOTION_WORDS).alias("_emo"), listed(lexical.INFO_WORDS).alias("_info"), F.size(loud).alias("_caps"),
        F.size(F.regexp_extract_all(t, F.lit(r"(?U)\b\d+([.,]\d+)?\b|%|\$|€|₽"), F.lit(0))).alias("_nums"),
        F.size(F.array_distinct("w")).alias("_kinds"), top.alias("_top"),
        (F.substring(t, 1, 120).contains("?") | some(lexical.QUESTION_WORDS)).alias("_ask"),
        some(lexical.INTRIGUE_WORDS).alias("_tease"), some(lexical.ADDRESS_WORDS).alias("_talk"),
        F.coalesce(F.get("w", F.lit(0)).isin(*lexical.DANGLING_WORDS), F.lit(False)).alias("_dangling"),
    )


def _texts(spark):
    r = random.Random(8)
    words = ODD + list(lexical.EMOTION_WORDS[:3] + lexical.INFO_WORDS[:3] + lexical.INTRIGUE_WORDS[:2] + lexical.ADDRESS_WORDS[:2])
    texts = ["", " ", "  ab\tcd\n", "!?", " "]
    for _ in range(400):
        texts.append("".join(r.choice(words) + r.choice([" ", "  ", "\n", ", ", "! ", "? ", "", "　"]) for _ in range(r.randint(1, 60))))
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_counts_match_the_patterns(spark):
    df = _texts(spark)
    want = {x["id"]: x.asDict() for x in _plain(df).collect()}
    got = lexical.with_counts(df).drop("text").collect()
    assert len(got) == len(want) == 405
    for x in got:
        assert x.asDict() == want[x["id"]], df.where(F.col("id") == x["id"]).first()


def test_no_pattern_runs_over_whole_texts(spark):
    df = _texts(spark).withColumn("duration_ms", F.lit(60_000))
    plan = lexical.score_heuristic(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("MapInArrow") == 1
