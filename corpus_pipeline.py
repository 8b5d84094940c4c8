"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on all rows that the stage before has kept, and all but the last return
the columns of documents: toxic documents go; one document of each near-duplicate class
stays; documents with benchmark passages go; secrets are replaced by a mark (the document
stays); what is left is packed into sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipspark.llm.decontamination import find_leaks
from clipspark.llm.near_duplicates import one_of_each
from clipspark.llm.packing import packed_digests
from clipspark.llm.secrets import redacted
from clipspark.llm.tables import free_name, written
from clipspark.llm.toxicity import THRESHOLD, learn, toxicity_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches the threshold."""
    into = free_name(docs, "toxicity")
    scored = toxicity_scores(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), into)
    return scored.filter(F.col(f"{into}.score") < THRESHOLD).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class by the rule of op2: three words and 0.9. Copies that only
    ``Rule(5, 80)`` links stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    into = free_name(docs, "leaks")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into)
    return found.filter(F.size(f"{into}.starts") == 0).drop(into)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    clean = redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packed_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Scores and token ids can't be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
