"""Run a streaming transformation over slices of tables, as restarts of one long query.

Each slice is appended to a folder of files per input; then the query runs with
``availableNow`` from its checkpoint until the folder is read, and stops. So state is
carried over restarts, slices may hold late rows, and a last slice far ahead in time moves
the watermark over everything before it. Every micro-batch is written to a folder named
by its number, so a repeated batch replaces itself."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipspark.operators.stages import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Replayed(NamedTuple):
    """``table``: the rows of all micro-batches with their number in ``batch``. ``dropped``: rows
    that state operators refused as late (after partial aggregation). ``kept``: rows in the
    state stores at the end of each run."""

    table: DataFrame
    dropped: int
    kept: list[int]


def replay(spark: SparkSession, slices: list[dict[str, DataFrame]], build: Callable[[dict[str, DataFrame]], DataFrame], mode: str = "append") -> Replayed:
    """Feed ``slices`` one after another to the query that ``build`` makes of one streaming
    DataFrame per input. The first slice has all inputs."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schemas = {name: df.schema for name, df in slices[0].items()}
    out, dropped, kept, before = None, 0, [], spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        for part in slices:
            for name, df in part.items():
                df.select(schemas[name].fieldNames()).write.mode("append").parquet(f"{top}/in/{name}")
            out = build({name: spark.readStream.schema(s).parquet(f"{top}/in/{name}") for name, s in schemas.items()})
            writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True)
            query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{top}/out/batch={batch}")).start()
            query.awaitTermination()
            progress = [p.stateOperators for p in query.recentProgress]
            dropped += sum(s.numRowsDroppedByWatermark for p in progress for s in p)
            kept.append(sum(s.numRowsTotal for s in progress[-1]) if progress else 0)
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])
    return Replayed(spark.read.schema(schema).option("basePath", f"{top}/out").parquet(f"{top}/out"), dropped, kept)


def by_time(df: DataFrame, column: str, parts: int) -> list[DataFrame]:
    """``df`` cut into ``parts`` slices of equal length in time."""
    low, high = df.agg(F.min(F.unix_micros(column)), F.max(F.unix_micros(column))).first()
    at = F.unix_micros(column)
    step = (high - low) // parts + 1 if low is not None else 1
    return [df.where((at >= low + k * step) & (at < low + (k + 1) * step)) if low is not None else df for k in range(parts)]
