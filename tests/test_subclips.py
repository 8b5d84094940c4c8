"""The subclip search: rounding as Spark's, odd candidates, and one pass over the pairs."""

import numpy as np
from pyspark.sql import functions as F

from clipspark.operators.subclips import refine_subclip, rounded
from tests.conftest import rows


def test_rounding_is_sparks(spark):
    values = [k / n for n in (2, 3, 7, 20_000, 30_000, 450_000) for k in range(0, 3 * n, max(1, n // 700))] + [0.00005, 0.12345, 1.00005, 99.99995]
    d = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 4).alias("r"))
    assert all(rounded(np.array([x.v]))[0] == x.r for x in d.collect())


def _found(spark, cands, units=()):
    c = spark.createDataFrame([(1, k, d) for k, d in enumerate(cands)], "source_id long, seq long, duration_ms long")
    u = spark.createDataFrame(list(units), "source_id long, seq long, start_ms long, end_ms long, terminal boolean, gap_after_ms long, run_index long")
    curve = c.select("source_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("bin")).withColumn("norm", F.when(F.col("bin") == 20, 1.0).otherwise(0.5))
    none = F.lit(None).cast("double")
    advice = c.select("source_id", "seq", none.alias("a0"), none.alias("a1"), F.lit(60.0).alias("duration"))
    return refine_subclip(c, u, curve, advice)


def test_odd_candidates(spark):
    said = [(1, 0, 10_000, 30_000, True, 0, 0), (1, 1, 0, 1_000, None, 0, 0)]
    got = {r.seq: r for r in _found(spark, [60_000, 9_000, 5_000, None, 60_000], said).collect()}
    assert [got[k].boundary_source for k in range(5)] == ["speech_units", "speech_units", "full_candidate", "full_candidate", "grid"]
    assert (got[0].start_ms, got[0].end_ms) == (9_850, 30_300)
    assert [(got[k].end_ms, got[k].evaluated) for k in (2, 3)] == [(5_000, 0), (45_000, 0)] and got[4].evaluated == 5_100


def test_pairs_are_scored_once(spark):
    plan = _found(spark, [60_000])._jdf.queryExecution().optimizedPlan().toString()
    # each further look at the found pairs had them scored anew, as rows with their curve
    assert "LeftAnti" not in plan and plan.count("MapInArrow") == 1
