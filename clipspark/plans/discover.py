"""Stored transcripts to the best non-overlapping moments of every source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipspark.operators.lexical import score_heuristic
from clipspark.operators.ranking import nms_top_k
from clipspark.operators.segmentation import candidate_windows


def discover(segments: DataFrame, top_k: int = 5, threshold: float = 0.6, pad_ms: int = 2000) -> DataFrame:
    """Windows, scores, suppression and padding as one plan over all sources."""
    scored = score_heuristic(candidate_windows(segments))
    best = nms_top_k(scored, top_k, threshold)
    length = segments.groupBy("source_id").agg(F.max("end_ms").alias("source_end_ms"))
    return best.join(length, "source_id").select(
        "source_id",
        "rank",
        "candidate_seq",
        "start_ms",
        "end_ms",
        "score",
        F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("padded_start_ms"),
        F.least(F.col("source_end_ms"), F.col("end_ms") + pad_ms).alias("padded_end_ms"),
    )
