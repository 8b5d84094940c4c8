"""Extension points: own scorers, model callers, formulas, and functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipspark.operators.context import pending_requests
from clipspark.operators.lexical import score_heuristic
from clipspark.operators.scoring import FORMULAS

Scorer = Callable[[DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {"heuristic": score_heuristic}


def register_scorer(name: str, fn: Scorer, *, per_row: bool = False) -> None:
    """Add a scorer that maps a candidate table to a scored one. With ``per_row``, ``fn``
    scores a pandas Series of texts and is run in Arrow batches."""
    if name in SCORERS:
        raise ValueError(f"scorer {name} is already registered")
    if per_row:
        scored = F.pandas_udf(fn, "double")
        SCORERS[name] = lambda df: df.withColumn("score", scored("text"))
    else:
        SCORERS[name] = fn


def score(name: str, cands: DataFrame) -> DataFrame:
    """Run a registered scorer; its name is stamped on every row."""
    if name not in SCORERS:
        raise KeyError(f"unknown scorer {name}; there are {sorted(SCORERS)}")
    return SCORERS[name](cands).withColumn("scorer", F.lit(name))


def register_formula(version: str, fn: Scorer) -> None:
    if version in FORMULAS:
        raise ValueError(f"formula {version} is already registered")
    FORMULAS[version] = fn


def apply_formula(version: str, features: DataFrame) -> DataFrame:
    """Score features by a versioned formula; the version is stamped on every row."""
    return FORMULAS[version](features).withColumn("formula_version", F.lit(version))


def score_with(
    fn: Callable[[pd.DataFrame], list[str]], requests: DataFrame, cache: DataFrame, force: bool = False
) -> DataFrame:
    """Call a model for every request the cache lacks and return the new answers
    (request_hash, raw) for appending to it. ``fn`` gets an Arrow batch as pandas and
    returns one answer text per row; a task calls it for its own rows only."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_hash": batch["request_hash"], "raw": fn(batch)})

    todo = pending_requests(requests, cache, force).dropDuplicates(["request_hash"])
    return todo.mapInPandas(call, "request_hash string, raw string")


@F.udtf(returnType="first int, last int, start_ms bigint, end_ms bigint")
class ExplodeWindows:
    """SQL face of the windowing rule for one source given as arrays of times; for whole
    tables use ``segmentation.candidate_windows``."""

    def eval(self, starts: list, ends: list, min_ms: int, target_ms: int, max_ms: int, overlap_ms: int):
        n, i = len(starts), 0
        while i < n:
            fits = [j for j in range(i + 1, n)]
            stop = next((j for j in fits if ends[j] - starts[i] >= target_ms), None)
            last = n - 1 if stop is None else stop if ends[stop] - starts[i] <= max_ms else max(stop - 1, i)
            length = ends[last] - starts[i]
            if length >= min_ms or (last == n - 1 and length >= 0.6 * min_ms):
                yield i, last, starts[i], ends[last]
            if last == n - 1:
                return
            goal = starts[i] + max(10_000, target_ms - overlap_ms)
            i = next((j for j in range(i + 1, n) if starts[j] >= goal), n)


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``explode_windows`` (table function) and ``dcg`` (aggregate) callable in SQL."""

    def dcg(relevance: pd.Series, rank: pd.Series) -> float:
        import numpy as np

        rel = relevance.fillna(0.0).clip(lower=0.0)
        return float(((2.0**rel - 1.0) / np.log2(rank + 1.0)).sum())

    spark.udtf.register("explode_windows", ExplodeWindows)
    dcg.__annotations__ = {"relevance": pd.Series, "rank": pd.Series, "return": float}
    spark.udf.register("dcg", F.pandas_udf(dcg, "double"))
