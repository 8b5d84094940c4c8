"""Readers and streaming transformations, over documents and rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.sources import derived, files


def _transcripts(spark, sf_dir):
    """Transcript documents as JSON text; some broken, some empty."""
    seg = derived.segments(spark, sf_dir)
    words = F.when(
        F.col("segment_id") % 7 != 3,
        F.transform(F.split("text", " "), lambda w: F.struct((F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), w.alias("word"))),
    )
    item = F.struct(
        F.col("segment_id").alias("id"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", words.alias("words")
    )
    docs = seg.groupBy("source_id").agg(F.sort_array(F.collect_list(item)).alias("segments"), (F.max("end_ms") / 1000.0).alias("duration"))
    i = F.col("source_id")
    body = F.to_json(
        F.struct(
            i.cast("string").alias("source_id"), F.lit("en").alias("language"), "duration", F.lit("m").alias("model"),
            F.when(i % 10 == 3, F.slice("segments", 1, 0)).otherwise(F.col("segments")).alias("segments"),
        )
    )
    cut = F.expr("substring(_b, 1, length(_b) - 2)")
    return docs.withColumn("_b", body).select(
        F.concat(F.lit("f"), i.cast("string")).alias("path"), F.when(i % 10 == 7, cut).otherwise(F.col("_b")).alias("value")
    )


@register(
    "s1_transcript_segments",
    "select cast(source_id as varchar) as source_id, segment_id, start_ms, end_ms, text, segment_id % 7 <> 3 as words_requested from segments where source_id % 10 not in (3, 7)",
)
def s1(spark, sf_dir):
    return files.parse_transcripts(_transcripts(spark, sf_dir))["segments"].drop("avg_logprob", "no_speech_prob")


@register(
    "s1_transcript_words",
    """select cast(source_id as varchar) as source_id, segment_id, i - 1 as word_idx, start_ms, end_ms, string_split(text, ' ')[i] as word
      from (select *, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from segments where source_id % 10 not in (3, 7) and segment_id % 7 <> 3)""",
)
def s1_words(spark, sf_dir):
    return files.parse_transcripts(_transcripts(spark, sf_dir))["words"].drop("probability").withColumn("word_idx", F.col("word_idx").cast("long"))


@register(
    "s1_transcript_rejects",
    "select distinct 'f' || source_id as path, case when source_id % 10 = 7 then 'not a JSON object' else 'no segments' end as reason from segments where source_id % 10 in (3, 7)",
)
def s1_rejects(spark, sf_dir):
    return files.parse_transcripts(_transcripts(spark, sf_dir))["rejects"]


CLIPS = "clips as (select source_id, start_ms // 45000 as candidate_seq, min(start_ms) as start_ms, min(start_ms) + 60000 as end_ms, string_agg(text, ' ' order by segment_id) as text from segments group by 1, 2)"


def _candidates(spark, sf_dir):
    q = F.col("candidate_seq")
    item = F.struct(q.alias("k"), F.concat(F.lit("c"), q.cast("string")).alias("id"), (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text")
    docs = derived.clips(spark, sf_dir).groupBy("source_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    i = F.col("source_id")
    wrapped = F.to_json(F.struct(F.concat(F.lit("set"), i.cast("string")).alias("candidate_set_id"), F.col("items").alias("candidates")))
    text = F.when(i % 10 == 7, "{broken").when(i % 2 == 0, F.to_json("items")).otherwise(wrapped)
    return docs.select(F.concat(F.lit("f"), i.cast("string")).alias("path"), text.alias("value"))


@register(
    "s2_read_candidates",
    f"with {CLIPS} select 'f' || source_id as path, case when source_id % 2 = 0 then 'legacy' else 'set' || source_id end as candidate_set_id, row_number() over (partition by source_id order by candidate_seq) - 1 as candidate_seq, 'c' || candidate_seq as candidate_id, start_ms, end_ms, text from clips where source_id % 10 <> 7",
)
def s2(spark, sf_dir):
    return files.parse_candidates(_candidates(spark, sf_dir)).drop("segment_ids")


@register("s2_candidate_rejects", "select distinct 'f' || source_id as path, 'not JSON' as reason from segments where source_id % 10 = 7")
def s2_rejects(spark, sf_dir):
    return files.candidate_rejects(_candidates(spark, sf_dir))


def _prediction_documents(spark, sf_dir):
    preds = derived.predictions(spark, sf_dir)
    odd = F.col("candidate_set_id").isin("src1", "src11")
    item = F.struct(F.col("rank").alias("k"), F.concat(F.lit("c"), F.col("candidate_id").cast("string")).alias("candidate_id"),
                    F.when(odd, F.col("rank") * 2).alias("rank"), "score")
    docs = preds.groupBy("candidate_set_id", "scorer").agg(F.sort_array(F.collect_list(item)).alias("predictions"))
    text = F.when(F.col("candidate_set_id").isin("src7", "src17"), "not json").otherwise(F.to_json(F.struct("candidate_set_id", "predictions")))
    return docs.select(F.concat(F.lit("run/"), "candidate_set_id", F.lit("/"), "scorer", F.lit(".json")).alias("path"), text.alias("value"))


@register(
    "s3_read_predictions",
    """select candidate_set_id, scorer, 'c' || candidate_id as candidate_id, case when candidate_set_id in ('src1', 'src11') then rank * 2 else rank end as rank, score
      from predictions where candidate_set_id not in ('src7', 'src17')""",
)
def s3(spark, sf_dir):
    return files.parse_predictions(_prediction_documents(spark, sf_dir)).drop("reason")


@register("s3_prediction_rejects", "select distinct 'run/' || candidate_set_id || '/' || scorer || '.json' as path, 'not JSON' as reason from predictions where candidate_set_id in ('src7', 'src17')")
def s3_rejects(spark, sf_dir):
    return files.prediction_rejects(_prediction_documents(spark, sf_dir))


@register(
    "s5_read_jobs",
    """select cast(l_orderkey as varchar) as job_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag = 'R') - 1 as attempt, 's' || l_linenumber as stage, l_quantity as seconds, l_returnflag = 'R' as skipped
      from lineitem where l_orderkey % 10 <> 7""",
)
def s5(spark, sf_dir):
    li = derived.table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("stage"),
                    F.col("l_quantity").alias("seconds"), F.when(F.col("l_returnflag") == "R", True).alias("skipped"))
    docs = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("stage_timings"))
    k = F.col("l_orderkey")
    text = F.when(k % 10 == 7, "{").otherwise(F.to_json(F.struct(k.cast("string").alias("job_id"), F.lit("DONE").alias("status"), "stage_timings")))
    return files.parse_jobs(docs.select(k.cast("string").alias("path"), text.alias("value")))[1]


@register("s6_fingerprint_files")
def s6(spark, sf_dir):
    return files.fingerprint_files(spark, f"{sf_dir}/*.parquet")
