"""Extension points."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipspark import extend
from clipspark.operators import segmentation
from clipspark.sources import derived
from tests.conftest import rows


def test_own_scorer_and_formula(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "text string")
    extend.register_scorer("words", lambda s: s.str.split().str.len().astype(float), per_row=True)
    assert rows(extend.score("words", df), "score", "scorer") == [("1.0", "words"), ("2.0", "words")]
    with pytest.raises(KeyError):
        extend.score("nobody", df)
    extend.register_formula("flat", lambda f: f.withColumn("score", F.lit(1.0)))
    assert rows(extend.apply_formula("flat", df), "formula_version") == [("flat",), ("flat",)]


def test_model_is_called_for_misses_only(spark):
    req = spark.createDataFrame([("h1", 1), ("h2", 2), ("h2", 2)], "request_hash string, v int")
    cache = spark.createDataFrame([("h1", "{}")], "request_hash string, raw string")
    fake = lambda batch: [f'{{"v": {v}}}' for v in batch["v"]]
    assert rows(extend.score_with(fake, req, cache)) == [("h2", '{"v": 2}')]
    assert extend.score_with(fake, req, cache, force=True).count() == 2


def test_sql_functions(spark, sf_dir):
    extend.register_sql_functions(spark)
    spark.createDataFrame(pd.DataFrame({"rel": [4.0, 2.0, 3.0], "rank": [1, 2, 3]})).createOrReplaceTempView("judged")
    assert abs(spark.sql("select dcg(rel, rank) from judged").collect()[0][0] - 20.392789) < 1e-6
    seg = derived.segments(spark, sf_dir)
    arrays = seg.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("segment_id", "start_ms", "end_ms"))).alias("a"))
    arrays.selectExpr("source_id", "transform(a, x -> x.start_ms) s", "transform(a, x -> x.end_ms) e").createOrReplaceTempView("timed")
    by_sql = spark.sql(
        "select source_id, w.start_ms, w.end_ms from timed, lateral explode_windows(s, e, 30000, 60000, 90000, 15000) w"
    )
    by_plan = segmentation.candidate_windows(seg).where("duration_ms >= 18000").select("source_id", "start_ms", "end_ms")
    got = set(rows(by_sql))
    # sources in which nothing qualifies become one window in the table operator only
    assert len(got) > 50 and got <= set(rows(by_plan))
