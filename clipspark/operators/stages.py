"""Cutting a plan where one intermediate result feeds several branches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a session that has
    none (a local test) gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage (``shared_folder``) and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
