"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .cotraining import quality_scores
from .decontamination import leak_digests
from .near_duplicates import class_digests
from .packing import packed_digests
from .quality import quality_table
from .repeats import removal_digests
from .secrets import secret_digests
from .sharding import shard_table
from .simhash import fingerprint_table
from .token_counts import read_pieces, token_counts, zipf_scores
from .toxicity import toxicity_table
from .turn_trie import conversation_trie
from .vector_codes import vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of `documents`."""
    return secret_digests(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all `documents`."""
    return class_digests(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and cross-document line frequency of all `documents`, by source."""
    return quality_table(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text of `documents`."""
    return toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of `benchmark` in every whole text of `documents`."""
    return leak_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in shards of at most 16 MiB of text."""
    return shard_table(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` as pieces of sequences of 2048 ids."""
    import public_tokenizers

    return packed_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for all `documents`, learned from `labels` by co-training."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every whole text of `documents`."""
    import public_tokenizers

    scores = zipf_scores(read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts(table(spark, sf_dir, "documents"), scores, keep=["doc_id"])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` without repeated passages of 35 words or more."""
    return removal_digests(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all `conversations`, openings shared by hundreds."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole and edited texts of `documents`, and the near ones of each hundredth."""
    return fingerprint_table(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all `embeddings` in four parts, with codebooks of 256 entries."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_simhash": op12_simhash,
    "op13_vector_codes": op13_vector_codes,
}
SQL: dict[str, str] = {
    "op1_secret_scan": sql.OP1,
    "op2_jaccard_join": sql.OP2,
    "op3_quality_rules": sql.OP3,
    "op5_benchmark_decontamination": sql.OP5,
    "op6_sharding": sql.OP6,
    "op10_substring_dedup": sql.OP10,
    "op11_conversation_trie": sql.OP11,
    "op13_vector_codes": sql.OP13,
}
