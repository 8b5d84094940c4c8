"""Reading and publishing run artifacts.

Every reader takes whole text files (one JSON document each) and keeps unusable ones
in a reject table instead of failing; parsing is a column expression, so documents
are spread over the cluster by file."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipspark.functions.exprs import pin
from clipspark.operators.stages import materialise

CHUNK = 65_536

WORD = "struct<start:double,end:double,word:string,probability:double>"
SEGMENT = f"struct<id:bigint,start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,words:array<{WORD}>>"
TRANSCRIPT = f"struct<source_id:string,language:string,duration:double,model:string,segments:array<{SEGMENT}>>"
CANDIDATE = "struct<id:string,start:double,end:double,duration:double,text:string,segment_ids:array<bigint>>"
PREDICTION = "struct<candidate_id:string,rank:bigint,score:double,reason:string>"
TIMING = "struct<stage:string,seconds:double,skipped:boolean>"
JOB = f"struct<job_id:string,source_id:string,status:string,created_at:string,stage_timings:array<{TIMING}>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _parse(raw: DataFrame, schema: str) -> DataFrame:
    valid = F.try_parse_json("value").isNotNull()
    return pin(raw, doc=F.when(valid, F.from_json("value", schema)))


def parse_transcripts(raw: DataFrame) -> dict[str, DataFrame]:
    """Nested transcripts to sources, segments and words; broken ones and those without
    segments to rejects. Words that were never asked for and words that were asked for
    and absent stay distinguishable (``words_requested``)."""
    docs = _parse(raw, TRANSCRIPT)
    empty = F.coalesce(F.size("doc.segments"), F.lit(0)) <= 0
    good = docs.where(F.col("doc").isNotNull() & ~empty)
    flat = good.select("path", F.col("doc.source_id").alias("source_id"), F.explode("doc.segments").alias("s"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return {
        "sources": good.select(
            "path", "doc.source_id", "doc.language", ms("doc.duration").alias("duration_ms"), "doc.model", F.size("doc.segments").cast("long").alias("segments")
        ),
        "segments": flat.select(
            "source_id", F.col("s.id").alias("segment_id"), ms("s.start").alias("start_ms"), ms("s.end").alias("end_ms"), "s.text",
            "s.avg_logprob", "s.no_speech_prob", F.col("s.words").isNotNull().alias("words_requested"),
        ),
        "words": flat.select("source_id", F.col("s.id").alias("segment_id"), F.posexplode("s.words").alias("word_idx", "w")).select(
            "source_id", "segment_id", "word_idx", ms("w.start").alias("start_ms"), ms("w.end").alias("end_ms"), "w.word", "w.probability"
        ),
        "rejects": docs.where(F.col("doc").isNull() | empty).select(
            "path", F.when(F.col("doc").isNull(), "not a JSON object").otherwise("no segments").alias("reason")
        ),
    }


def read_transcripts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return parse_transcripts(read_documents(spark, path))


def parse_candidates(raw: DataFrame) -> DataFrame:
    """Candidates from a wrapped document or from a bare list (which has no set id)."""
    wrapped = F.from_json("value", f"candidate_set_id string, candidates array<{CANDIDATE}>")
    bare = F.from_json("value", f"array<{CANDIDATE}>")
    listed = F.ltrim("value").startswith("[")
    docs = raw.where(F.try_parse_json("value").isNotNull()).select(
        "path",
        F.when(listed, F.lit("legacy")).otherwise(wrapped["candidate_set_id"]).alias("candidate_set_id"),
        F.when(listed, bare).otherwise(wrapped["candidates"]).alias("items"),
    )
    return docs.select("path", "candidate_set_id", F.posexplode("items").alias("seq", "c")).select(
        "path", "candidate_set_id", F.col("seq").cast("long").alias("candidate_seq"), F.col("c.id").alias("candidate_id"),
        F.round(F.col("c.start") * 1000).cast("long").alias("start_ms"), F.round(F.col("c.end") * 1000).cast("long").alias("end_ms"), "c.text", "c.segment_ids",
    )


def _rejected(raw: DataFrame, usable: Column, missing: str) -> DataFrame:
    """(path, reason) of documents that a reader leaves out."""
    broken = F.try_parse_json("value").isNull()
    return raw.where(broken | ~F.coalesce(usable, F.lit(False))).select("path", F.when(broken, "not JSON").otherwise(missing).alias("reason"))


def candidate_rejects(raw: DataFrame) -> DataFrame:
    """Documents without a list of candidates."""
    wrapped = F.from_json("value", f"candidate_set_id string, candidates array<{CANDIDATE}>")
    return _rejected(raw, F.ltrim("value").startswith("[") | wrapped["candidates"].isNotNull(), "no candidates")


def prediction_rejects(raw: DataFrame) -> DataFrame:
    """Documents without a list of predictions."""
    return _rejected(raw, F.from_json("value", f"predictions array<{PREDICTION}>")["predictions"].isNotNull(), "no predictions")


def job_rejects(raw: DataFrame) -> DataFrame:
    """Documents without a job id."""
    return _rejected(raw, F.from_json("value", "job_id string")["job_id"].isNotNull(), "no job id")


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return parse_candidates(read_documents(spark, path))


def parse_predictions(raw: DataFrame) -> DataFrame:
    """Every scorer's predictions in one table; unreadable files are left out, and a
    missing rank is the position in the file."""
    docs = _parse(raw, f"struct<candidate_set_id:string,scorer:string,predictions:array<{PREDICTION}>>").where(F.col("doc").isNotNull())
    name = F.coalesce("doc.scorer", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    return docs.select("path", "doc.candidate_set_id", name.alias("scorer"), F.posexplode("doc.predictions").alias("i", "p")).select(
        "candidate_set_id", "scorer", "p.candidate_id", F.coalesce("p.rank", F.col("i") + 1).cast("long").alias("rank"), "p.score", "p.reason"
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return parse_predictions(read_documents(spark, path))


def parse_jobs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and their stage timings; one corrupt file does not hide the others. Sort by
    ``created_at`` descending for newest first."""
    docs = _parse(raw, JOB).where(F.col("doc.job_id").isNotNull())
    jobs = docs.select("doc.job_id", "doc.source_id", "doc.status", "doc.created_at", F.to_timestamp("doc.created_at").alias("created"))
    timings = docs.select("doc.job_id", F.posexplode_outer("doc.stage_timings").alias("i", "t")).where(F.col("t").isNotNull())
    return jobs, timings.select("job_id", F.col("i").cast("long").alias("attempt"), "t.stage", "t.seconds", F.coalesce("t.skipped", F.lit(False)).alias("skipped"))


def read_jobs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_jobs(read_documents(spark, path))


def open_ranged(path: str) -> pa.NativeFile:
    """A file as Spark lists it, opened for reading at any place."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, at = fs.FileSystem.from_uri(quote(path.replace("s3a:", "s3:", 1), safe=":/@"))
    return system.open_input_file(at)


RANGED = ("file", "s3", "s3a", "gs", "abfs", "abfss")


def _sampled_hash(path: str, size: int, opener: Callable[[str], BinaryIO]) -> str:
    digest = hashlib.sha256()
    starts = (0, size // 2 - CHUNK // 2, size - CHUNK) if size > 3 * CHUNK else (0,)
    with opener(path) as f:
        for start in starts:
            f.seek(start)
            digest.update(f.read(CHUNK if len(starts) > 1 else size))
    return digest.hexdigest()


def _whole_hash() -> Column:
    size = F.col("length")
    piece = lambda start: F.substring("content", start, CHUNK)
    middle = (F.floor(size / 2) - CHUNK // 2 + 1).cast("int")
    sampled = F.concat(piece(F.lit(1)), piece(middle), piece((size - CHUNK + 1).cast("int")))
    return F.sha2(F.when(size <= 3 * CHUNK, F.col("content")).otherwise(sampled), 256)


def fingerprint_files(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """Size, modification time and content id of each file: the hash covers the head,
    middle and tail 64 KiB, or the whole of a small file.

    Spark lists the files; a task seeks the three ranges of each, so that a file costs at
    most 192 KiB however large it is. ``opener`` opens a listed path for reading;
    ``open_ranged`` knows the schemes in ``RANGED``. Under any other scheme, and without an
    ``opener``, Spark's reader brings whole files, of at most 2 GiB each. Empty files are
    not in the catalog, as Spark's listing leaves them out."""
    listed = spark.read.format("binaryFile").load(path)
    one = listed.select("path").first()
    if opener is None and one and one.path.partition(":")[0] in RANGED:
        opener = open_ranged
    if opener is None:
        hashed = listed.select("path", "length", "modificationTime", _whole_hash().alias("content_hash"))
    else:
        def task(batches):
            for b in batches:
                found = [_sampled_hash(p, n, opener) for p, n in zip(b.column("path").to_pylist(), b.column("length").to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "content_hash"])

        hashed = listed.select("path", "length", "modificationTime").mapInArrow(task, "path string, length long, modificationTime timestamp, content_hash string")
    return hashed.select(
        "path", F.col("length").alias("bytes"), F.unix_seconds("modificationTime").alias("mtime_s"), "content_hash",
        F.substring(F.sha2(F.concat_ws("|", F.col("length").cast("string"), "content_hash"), 256), 1, 16).alias("fingerprint_id"),
    )


MARKER = "_complete"
MARKER_SCHEMA = "source_id string, run string, finished_at timestamp"


def completed(spark: SparkSession, path: str) -> DataFrame:
    """The latest completed run of each source."""
    try:
        marks = spark.read.schema(MARKER_SCHEMA).json(f"{path}/{MARKER}")
    except AnalysisException as e:  # nothing has been published yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MARKER_SCHEMA)
    return marks.groupBy("source_id").agg(F.max_by("run", F.struct("finished_at", "run")).alias("run"))


def unfinished(sources: DataFrame, path: str) -> DataFrame:
    """Sources without a completion marker under ``path``."""
    done = completed(sources.sparkSession, path).select(F.col("source_id").alias("_done"))
    return sources.join(done, F.col("source_id").cast("string") == F.col("_done"), "left_anti")


def write_run(tables: dict[str, DataFrame], path: str, overwrite: bool = False) -> str:
    """Publish a run's tables, then the completion markers. Returns the run's name.

    A completed source is left alone unless ``overwrite``; one whose earlier run died
    before its marker was written is simply written again, as nothing without a marker
    is ever read. A run is one directory per table, not one per source, so many short
    sources do not become many small files."""
    run = uuid.uuid4().hex
    # a source may have rows in some of the tables only
    named = [df.select(F.col("source_id").cast("string").alias("source_id")).distinct() for df in tables.values()]
    every = reduce(DataFrame.union, named).distinct()
    todo = materialise(every if overwrite else unfinished(every, path))
    for name, df in tables.items():
        rows = df.withColumn("source_id", F.col("source_id").cast("string")).join(todo, "source_id", "left_semi")
        rows.write.mode("errorifexists").parquet(f"{path}/{name}/run={run}")
    marks = todo.select("source_id", F.lit(run).alias("run"), F.current_timestamp().alias("finished_at"))
    marks.write.mode("append").json(f"{path}/{MARKER}")
    return run


def read_run(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A published table, of each source its latest completed run only."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{path}/{table}")
    return rows.join(completed(spark, path), ["source_id", "run"], "left_semi").drop("run")
