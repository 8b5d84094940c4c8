"""Helpers of the operators: one pass of Python over Arrow batches, and shared tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet (Spark compares without case)."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; what else a table holds cannot clash any more."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def map_text(df: DataFrame, fields: str, work: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]], text: str = "text", keep: list[str] | None = None, into: str | None = None) -> DataFrame:
    """Append what ``work()`` makes of the text column, one Arrow batch at a time.

    ``work`` is called once per task and returns a function from the texts of a batch to
    arrays of the same length named as in ``fields`` (a DDL string). ``keep`` names the
    input columns of the result, all of them by default; ``into`` puts the new columns
    into one struct of that name instead of appending them. Nothing is shuffled.
    """
    keep = df.columns if keep is None else keep
    need = list(dict.fromkeys([*keep, text]))
    df = pick(df, *need)
    made = T.StructType.fromDDL(fields) if "<" not in fields or not fields.startswith("struct") else fields
    schema = T.StructType([f for f in df.schema.fields if f.name in keep])
    schema = schema.add(into, made) if into else T.StructType([*schema.fields, *made.fields])
    names = made.fieldNames()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = work()
        for batch in batches:
            out = make(batch.column(need.index(text)))
            new = [out[n] for n in names]
            if into:
                new = [pa.StructArray.from_arrays(new, names=names)]
            yield pa.RecordBatch.from_arrays([*[batch.column(need.index(k)) for k in keep], *new], names=[*keep, *([into] if into else names)])

    return df.mapInArrow(task, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir. Only a local
    session without that setting gets a folder of its own."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        top = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later plans start from its files,
    which outlive lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph with columns a, b of type long.

    The component is the smallest node. Each round every node takes the smallest label
    around it and then its label's label, so long chains halve; the state is written to
    the shared folder each round and only a count reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        around = both.join(state.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = state.join(around, "node").select("node", "component", F.least("component", "low").alias("low"))
        target = state.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        # a label that is itself a node passes on the label it holds
        step = written(lower.join(target, "low", "left").select("node", "component", F.least("low", F.coalesce("lower", "low")).alias("low")))
        moved = step.filter("low < component").limit(1).count()
        state = step.select("node", F.col("low").alias("component"))
        if not moved:
            return state


class Sieve:
    """A Bloom filter of fixed size (8 MB) over numbers of type long, for use before an
    exact join: what it holds back has no partner. With more keys it lets more rows
    through, never fewer."""

    WORDS = 1 << 20

    def __init__(self, keys: DataFrame):
        words = Sieve.WORDS

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(words, np.uint64)
            for batch in batches:
                for word, bit in Sieve._places(batch.column(0).to_numpy()):
                    np.bitwise_or.at(table, word, bit)
            at = np.flatnonzero(table)
            for i in range(0, len(at), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(table[at[i : i + 100_000]].view(np.int64))], names=["word", "bits"])

        parts = keys.mapInArrow(task, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        table = np.zeros(words, np.uint64)
        table[parts["word"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
        self.held = keys.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def _places(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for salt in (1, 2):
            h = mix(keys.view(np.uint64) + np.uint64(salt))
            yield (h >> np.uint64(44)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        table, out = self.held.value, np.ones(len(keys), bool)
        for word, bit in Sieve._places(keys):
            out &= table[word] & bit != 0
        return out

    def rows(self, df: DataFrame, key: str) -> DataFrame:
        """The rows of ``df`` whose key passes; a key is never null."""
        at = df.columns.index(key)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(self.passes(batch.column(at).to_numpy())))

        return df.mapInArrow(task, df.schema)
