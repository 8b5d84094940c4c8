"""Audit, report and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.operators import audits as au
from clipspark.operators import lexical, ranking, segmentation
from clipspark.operators.stages import materialise
from clipspark.sources import derived

STATUSES = ("QUEUED", "INGESTING", "TRANSCRIBING", "AWAITING_TRANSCRIPT", "DISCOVERING", "RANKING", "RENDERING", "UPLOADING", "DONE", "FAILED")
ERRORS = ("ReadTimeout", "ValueError", "ConnectionResetError", "WeirdError", "SSLError")
JOBS = """jobs as (select o_orderkey as job_id, o_orderkey as source_id, ['QUEUED', 'INGESTING', 'TRANSCRIBING', 'AWAITING_TRANSCRIPT', 'DISCOVERING', 'RANKING', 'RENDERING', 'UPLOADING', 'DONE', 'FAILED'][1 + o_orderkey % 10] as status,
  ['QUEUED', 'INGESTING', 'TRANSCRIBING', 'AWAITING_TRANSCRIPT', 'DISCOVERING', 'RANKING', 'RENDERING', 'UPLOADING', 'DONE', 'FAILED'][1 + o_custkey % 8] as stage,
  ['ReadTimeout', 'ValueError', 'ConnectionResetError', 'WeirdError', 'SSLError'][1 + o_orderkey // 10 % 5] as error_type from orders)
"""


def _jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    states = F.array(*[F.lit(s) for s in STATUSES])
    return derived.table(spark, sf_dir, "orders").select(
        k.alias("job_id"), k.alias("source_id"), F.get(states, (k % 10).cast("int")).alias("status"),
        F.get(states, (F.col("o_custkey") % 8).cast("int")).alias("stage"),
        F.get(F.array(*[F.lit(e) for e in ERRORS]), (F.floor(k / 10) % 5).cast("int")).alias("error_type"),
    )


def _classified(spark, sf_dir):
    kin = {"ReadTimeout": ["ReadTimeout", "OSError", "Exception"], "ValueError": ["ValueError", "Exception"],
           "ConnectionResetError": ["ConnectionResetError", "ConnectionError", "OSError", "Exception"],
           "WeirdError": ["WeirdError", "Exception"], "SSLError": ["SSLError", "OSError", "ValueError", "Exception"]}
    # the class tree of the error types is a small constant, as in any code base
    names = F.create_map(*[x for k, v in kin.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])
    types = _jobs(spark, sf_dir).select("error_type").distinct()
    ancestors = types.select("error_type", F.explode(names[F.col("error_type")]).alias("ancestor"))
    return au.classify_failures(_jobs(spark, sf_dir), ancestors)


@register(
    "p1_transcript_cache_audit",
    """with c as (select p_partkey as source_id, case when p_partkey % 7 = 0 then '' else 'f' || p_partkey % 50 end as fingerprint, case when p_partkey % 11 = 0 then 'small' else 'large' end as model,
       case when p_partkey % 13 = 0 then 'cpu' else 'cuda' end as device, case when p_partkey % 17 = 0 then 'int8' else 'f16' end as ct, ['ru', 'en'][1 + p_partkey % 2] as lang, p_partkey % 3 + 4 as beam, p_partkey % 19 <> 0 as vad from part where p_partkey % 10 <> 9),
     r as (select p_partkey as source_id, 'f' || p_size % 50 as rf, case when p_partkey % 5 <> 0 then 'en' end as rl from part)
     select r.source_id, case when c.source_id is null then 'MISS: nothing cached'
       when fingerprint <> '' and fingerprint <> rf then 'MISS: source fingerprint mismatch (cached=' || fingerprint || ', requested=' || rf || ')'
       when model <> 'large' then 'MISS: ASR model changed (cached=' || model || ', requested=large)' when device <> 'cuda' then 'MISS: ASR device changed (cached=' || device || ', requested=cuda)'
       when ct <> 'f16' then 'MISS: ASR compute_type changed (cached=' || ct || ', requested=f16)' when rl is not null and lang <> rl then 'MISS: ASR language changed (cached=' || lang || ', requested=' || rl || ')'
       when beam <> 5 then 'MISS: ASR beam_size changed (cached=' || beam || ', requested=5)' when not vad then 'MISS: ASR vad_filter changed (cached=false, requested=true)' else 'HIT' end as outcome
     from r left join c using (source_id)""",
)
def p1(spark, sf_dir):
    part = derived.table(spark, sf_dir, "part")
    p = F.col("p_partkey")
    cached = part.where(p % 10 != 9).select(
        p.alias("source_id"),
        F.when(p % 7 == 0, "").otherwise(F.concat(F.lit("f"), (p % 50).cast("string"))).alias("fingerprint"),
        F.when(p % 11 == 0, "small").otherwise("large").alias("model"),
        F.when(p % 13 == 0, "cpu").otherwise("cuda").alias("device"),
        F.when(p % 17 == 0, "int8").otherwise("f16").alias("compute_type"),
        F.when(p % 2 == 0, "ru").otherwise("en").alias("language"),
        (p % 3 + 4).alias("beam_size"), (p % 19 != 0).alias("vad_filter"),
    )
    requested = part.select(
        p.alias("source_id"), F.concat(F.lit("f"), (F.col("p_size") % 50).cast("string")).alias("fingerprint"),
        F.lit("large").alias("model"), F.lit("cuda").alias("device"), F.lit("f16").alias("compute_type"),
        F.when(p % 5 != 0, "en").alias("language"), F.lit(5).cast("long").alias("beam_size"), F.lit(True).alias("vad_filter"),
    )
    return au.transcript_cache_audit(cached, requested)


@register(
    "p2_candidate_cache_audit",
    """with c as (select p_partkey as source_id, 'h' || p_partkey % 6 as h, 30 + p_partkey % 2 as mn, 60 + p_partkey % 3 % 2 as tg, 90 as mx, 15 + p_partkey % 5 % 2 as ov from part where p_partkey % 8 <> 0)
     select p_partkey as source_id, case when c.source_id is null then 'MISS: nothing cached' when h <> 'h' || p_size % 6 then 'MISS: transcript changed (cached=' || h || ', requested=h' || p_size % 6 || ')'
       when mn <> 30 then 'MISS: min_seconds changed (cached=' || mn || ', requested=30)' when tg <> 60 then 'MISS: target_seconds changed (cached=' || tg || ', requested=60)'
       when ov <> 15 then 'MISS: overlap_seconds changed (cached=' || ov || ', requested=15)' else 'HIT' end as outcome from part left join c on c.source_id = p_partkey""",
)
def p2(spark, sf_dir):
    part = derived.table(spark, sf_dir, "part")
    p = F.col("p_partkey")
    cached = part.where(p % 8 != 0).select(
        p.alias("source_id"), F.concat(F.lit("h"), (p % 6).cast("string")).alias("transcript_hash"), (30 + p % 2).alias("min_s"),
        (60 + p % 3 % 2).alias("target_s"), F.lit(90).cast("long").alias("max_s"), (15 + p % 5 % 2).alias("overlap_s"),
    )
    requested = part.select(
        p.alias("source_id"), F.concat(F.lit("h"), (F.col("p_size") % 6).cast("string")).alias("transcript_hash"),
        *[F.lit(v).cast("long").alias(n) for n, v in (("min_s", 30), ("target_s", 60), ("max_s", 90), ("overlap_s", 15))],
    )
    return au.candidate_cache_audit(cached, requested)


CLIPS = "clips as (select source_id, start_ms // 45000 as candidate_seq, min(start_ms) as start_ms, min(start_ms) + 60000 as end_ms, string_agg(text, ' ' order by segment_id) as text from segments group by 1, 2)"


@register(
    "p3_pad_clips",
    f"""with {CLIPS}, l as (select source_id, max(end_ms) as d from segments group by 1)
    select source_id, candidate_seq as rank, greatest(0, start_ms - 2000) / 1000.0e0 as padded_start_s, least(d, end_ms + 2000) / 1000.0e0 as padded_end_s from clips join l using (source_id)""",
)
def p3(spark, sf_dir):
    h = derived.clips(spark, sf_dir).withColumnRenamed("candidate_seq", "rank")
    return au.pad_clips(h, derived.sources(spark, sf_dir))


@register(
    "p4_classify_failures",
    f"with {JOBS} select *, error_type in ('ReadTimeout', 'ConnectionResetError', 'SSLError') as retryable from jobs",
)
def p4(spark, sf_dir):
    return _classified(spark, sf_dir)


@register(
    "p5_job_progress",
    f"""with {JOBS}, pr as (select * from (values ('QUEUED', 0), ('INGESTING', 10), ('TRANSCRIBING', 30), ('AWAITING_TRANSCRIPT', 30), ('DISCOVERING', 55), ('RANKING', 65), ('RENDERING', 75), ('UPLOADING', 95), ('DONE', 100)) t(s, pct))
    select job_id, status, cast(pct as bigint) as progress, case when status = 'FAILED' then error_type end as error_type,
      case when status = 'FAILED' then error_type in ('ReadTimeout', 'ConnectionResetError', 'SSLError') end as error_retryable
    from jobs join pr on pr.s = case when status = 'FAILED' then stage else status end""",
)
def p5(spark, sf_dir):
    return au.job_progress(_classified(spark, sf_dir))


@register(
    "p6_duration_drift",
    """with p as (select o_orderkey as key, case when o_orderkey % 13 <> 0 then o_orderkey * 997 % 9000000 end as s, case when o_orderkey % 17 <> 0 then o_orderkey * 997 % 9000000 + o_custkey * 31 % 9000 - 4500 end as a from orders),
    t as (select *, greatest(2000.0e0, least(5000.0e0, s * 0.001e0)) as tol from p)
    select key, case when s > 0 then tol end as tolerance_ms, case when s is null or s <= 0 then null when a is null then 'the extracted audio has no readable duration'
      when abs(a - s) > tol then 'off by ' || abs(a - s) || ' ms' end as complaint from t""",
)
def p6(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k * 997 % 9_000_000
    pairs = derived.table(spark, sf_dir, "orders").select(
        k.alias("key"), F.when(k % 13 != 0, s).alias("source_ms"),
        F.when(k % 17 != 0, s + F.col("o_custkey") * 31 % 9000 - 4500).alias("audio_ms"),
    )
    return au.duration_drift(pairs)


@register("p7_select_backfill", "select candidate_set_id, candidate_id, human_score from pool where human_score is not null and hook_score is null and bad_start is null")
def p7(spark, sf_dir):
    return au.select_backfill(derived.pool(spark, sf_dir)).select("candidate_set_id", "candidate_id", "human_score")


@register(
    "s7_run_identity",
    "select doc_id as source_id, sha256('r2_transcript|' || doc_id || '|' || source || '|processing/' || doc_id || '/transcript.json|' || sha256(text)[:16])[:16] as fingerprint_id from documents",
)
def s7(spark, sf_dir):
    i = F.col("doc_id")
    runs = derived.table(spark, sf_dir, "documents").select(
        i.alias("source_id"), F.col("source").alias("bucket"),
        F.concat(F.lit("processing/"), i.cast("string"), F.lit("/transcript.json")).alias("transcript_key"),
        F.substring(F.sha2("text", 256), 1, 16).alias("transcript_hash"),
    )
    return au.run_identity(runs).select("source_id", "fingerprint_id")


@register(
    "e15_blind_export",
    "with c as (select source_id, start_ms // 45000 as candidate_seq, min(start_ms) as start_ms, min(start_ms) + 60000 as end_ms, string_agg(text, ' ' order by segment_id) as text from segments group by 1, 2)"
    " select *, sha256('42:' || source_id || ':' || candidate_seq) as blind_order, cast(null as double) as human_score, cast(null as boolean) as publishable from c",
)
def e15(spark, sf_dir):
    return au.blind_export(derived.clips(spark, sf_dir))


BLIND = """a as (select candidate_set_id, candidate_id, 'A' as g from (select *, row_number() over (partition by candidate_set_id order by rank, candidate_id) as rn from predictions where scorer = 'A' and rank between 16 and 32) where rn <= 4),
  b as (select candidate_set_id, candidate_id, 'B' as g from (select p.candidate_set_id, p.candidate_id, row_number() over (partition by p.candidate_set_id order by sha256('1337:' || p.candidate_id), p.candidate_id) as rn from pool p
     where not exists (select 1 from predictions l where l.rank <= 20 and l.candidate_set_id = p.candidate_set_id and l.candidate_id = p.candidate_id)) where rn <= 4),
  c as (select candidate_set_id, candidate_id, 'C' as g from (select *, row_number() over (partition by candidate_set_id order by rank, candidate_id) as rn from predictions where scorer = 'B' and (status is null or status = 'ranked')) where rn <= 4),
  ch as (select candidate_set_id, candidate_id, min(g) as blind_group from (select * from a union all select * from b union all select * from c) group by all),
  bg as (select *, format('blind_{:03d}', row_number() over (partition by candidate_set_id order by sha256('1338:' || candidate_id), candidate_id)) as blind_id from ch semi join pool using (candidate_set_id, candidate_id))"""


def _blind(spark, sf_dir):
    preds = derived.predictions(spark, sf_dir)
    return au.blind_groups(derived.pool(spark, sf_dir), preds, preds.where(F.col("rank") <= 20), "B", "A", sizes=(4, 4, 4))


@register("e16_blind_groups", f"with {BLIND} select candidate_set_id, candidate_id, blind_group, blind_id from bg")
def e16(spark, sf_dir):
    return _blind(spark, sf_dir)


@register("e16_blind_document", f"with {BLIND} select candidate_set_id, blind_id, d.text from bg join documents d on d.doc_id = bg.candidate_id")
def e16_document(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select(F.col("source").alias("candidate_set_id"), F.col("doc_id").alias("candidate_id"), "text")
    return au.blind_document(_blind(spark, sf_dir), docs)


@register(
    "e16_blind_mapping",
    f"""with {BLIND} select candidate_set_id, blind_id, candidate_id, blind_group, max(rank) filter (where scorer = 'A') as mid_rank, max(rank) filter (where scorer = 'B') as final_rank
      from bg left join predictions using (candidate_set_id, candidate_id) group by all""",
)
def e16_mapping(spark, sf_dir):
    return au.blind_mapping(_blind(spark, sf_dir), derived.predictions(spark, sf_dir), "B", "A")


@register(
    "e17_review_export",
    """select c.source_id, c.candidate_seq, c.start_ms, c.end_ms, h.rank, h.score, coalesce(cast(h.rank as double), 1e6) as review_key, cast(null as varchar) as human_label
     from candidates c left join (select * from (select *, row_number() over (partition by source_id order by score desc, candidate_seq) as rank from heuristic) where rank <= 5) h using (source_id, candidate_seq)""",
)
def e17(spark, sf_dir):
    # scored where they are cut: texts are not written
    cands = lexical.score_heuristic(segmentation.candidate_windows(derived.segments(spark, sf_dir)))
    scored = materialise(cands.select("source_id", "candidate_seq", "start_ms", "end_ms", "score"))
    ranked = ranking.rank_predictions(scored.select("source_id", "candidate_seq", "score"))
    return au.review_export(scored.drop("score"), ranked.where(F.col("rank") <= 5))


@register(
    "e18_manifest_counts",
    """with r as (select l_orderkey as batch_id, case when l_partkey % 4 = 0 or l_orderkey % 6 = 0 then 'failed' else 'success' end as status, l_suppkey % 3 = 0 as fb from lineitem),
    s as (select batch_id, count(*) as requested, count(*) filter (where status = 'success') as succeeded, count(*) filter (where status = 'success' and fb) as fallbacks, count(*) filter (where status <> 'success') as failed from r group by 1)
    select *, case when failed = 0 then 'success' when succeeded = 0 then 'failed' else 'partial_success' end as status from s""",
)
def e18(spark, sf_dir):
    res = derived.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.when((F.col("l_partkey") % 4 == 0) | (F.col("l_orderkey") % 6 == 0), "failed").otherwise("success").alias("status"),
        (F.col("l_suppkey") % 3 == 0).alias("fallback"),
    )
    return au.manifest_counts(res, "batch_id")


@register(
    "e19_stage_durations",
    "select l_orderkey as job_id, " + ", ".join(f"rnd2(sum(l_quantity) filter (where l_linenumber = {k})) as stage_{k}" for k in range(1, 8))
    + ", count(*) filter (where l_returnflag = 'R') as skipped, count(*) as attempts, rnd2(sum(l_quantity)) as total_seconds from lineitem group by 1",
)
def e19(spark, sf_dir):
    t = derived.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage"), F.col("l_quantity").alias("seconds"),
        (F.col("l_returnflag") == "R").alias("skipped"),
    )
    return au.stage_durations(t, range(1, 8))


FILES = f"""{JOBS}, files as (select l_orderkey as source_id, l_linenumber || '-' || l_partkey as path, case when l_linenumber = 1 then 'source' when l_linenumber <= 5 then 'clip' when l_linenumber = 6 then 'intermediate' else 'protected' end as kind,
   cast(round(l_extendedprice * 100) as bigint) as bytes, case when l_linenumber <= 5 and l_suppkey % 10 <> 0 then 'k' || l_orderkey || '-' || l_linenumber || '-' || l_partkey end as key from lineitem),
reps as (select key, case when bytes % 11 = 0 then bytes + 1 else bytes end as rb, sha256(case when bytes % 13 = 0 then 'x' else key end) <> sha256(key) as odd from (select key, min(bytes) as bytes from files where key is not null group by 1) where bytes % 9 <> 0),
acts as (select f.*, reps.rb, odd, kind in ('source', 'clip') as copied from files f left join reps on reps.key = f.key),
act as (select source_id, path, kind, bytes, case when copied and rb = bytes and not odd then 'DELETE' else 'KEEP' end as action,
   case when copied and key is null then 'remote_not_verified (no remote key)' when copied and rb is null then 'remote_not_verified (remote object missing)' when copied and rb <> bytes then 'remote_not_verified (remote size differs)' when copied and odd then 'remote_not_verified (remote sha256 differs)'
     when kind = 'clip' then 'published at ' || key when kind = 'source' then 're-fetchable from ' || key when kind = 'intermediate' then 'cheap to keep, expensive to regenerate' else 'needed to resume without re-downloading' end as reason from acts)
"""


def _files(spark, sf_dir):
    n = F.col("l_linenumber")
    key = F.concat(F.lit("k"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return derived.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("path"),
        F.when(n == 1, "source").when(n <= 5, "clip").when(n == 6, "intermediate").otherwise("protected").alias("kind"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("bytes"),
        F.when((n <= 5) & (F.col("l_suppkey") % 10 != 0), key).alias("key"), F.sha2(key, 256).alias("sha"),
    )


def _actions(spark, sf_dir):
    files = _files(spark, sf_dir)
    b = F.col("bytes")
    reps = (
        files.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("bytes").alias("bytes"))
        .where(b % 9 != 0)
        .select("key", F.when(b % 11 == 0, b + 1).otherwise(b).alias("bytes"), F.sha2(F.when(b % 13 == 0, "x").otherwise(F.col("key")), 256).alias("sha"))
    )
    return au.file_actions(files, reps)


@register("e20_file_actions", f"with {FILES} select * from act")
def e20_files(spark, sf_dir):
    return _actions(spark, sf_dir)


NOW = 883612800


@register(
    "e20_retention_plan",
    f"""with {FILES}, dirs as (select o_orderkey as source_id, cast(epoch(o_orderdate) as bigint) + o_orderkey % 86000 as mtime_s from orders),
    sz as (select source_id, sum(bytes) as bytes, coalesce(sum(bytes) filter (where action = 'DELETE'), 0) as reclaimable from act group by 1),
    ru as (select d.source_id, bytes, reclaimable, mtime_s, case when j.status in ('QUEUED', 'INGESTING', 'TRANSCRIBING', 'AWAITING_TRANSCRIPT', 'DISCOVERING', 'RANKING', 'RENDERING', 'UPLOADING') then 'active_job (' || j.status || ')'
       when row_number() over (order by mtime_s desc, d.source_id desc) <= 20 then 'keep_recent' when mtime_s > {NOW} - 3600 then 'newer_than' end as rule
      from dirs d left join sz using (source_id) left join jobs j on j.source_id = d.source_id),
    bu as (select *, greatest(0, sum(bytes) over () - 200000000000) - coalesce(sum(case when rule is null then coalesce(reclaimable, 0) else 0 end) over (order by mtime_s, source_id rows between unbounded preceding and 1 preceding), 0) <= 0 as met from ru)
    select source_id, cast(bytes as bigint) as bytes, cast(reclaimable as bigint) as reclaimable, case when rule like 'active%' then 'SKIP' when rule is not null or met then 'KEEP' else 'CLEAN' end as decision,
      coalesce(rule, case when met then 'disk target already met' else 'eligible' end) as reason from bu""",
)
def e20(spark, sf_dir):
    dirs = derived.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_id"),
        (F.unix_timestamp(F.to_timestamp("o_orderdate")) + F.col("o_orderkey") % 86000).alias("mtime_s"),
    )
    return au.retention_plan(dirs, _actions(spark, sf_dir), _jobs(spark, sf_dir), NOW, keep_recent=20, cap_bytes=200_000_000_000)


@register(
    "e21_run_inventory",
    """with f as (select l_orderkey as source_id, cast(round(l_extendedprice * 100) as bigint) as bytes from lineitem)
    select source_id, cast(sum(bytes) as bigint) as bytes, count(*) as files, cast(1 as bigint) as sources, 'source' as scope from f group by 1
    union all select null, cast(sum(bytes) as bigint), count(*), count(distinct source_id), 'all' from f""",
)
def e21(spark, sf_dir):
    return au.run_inventory(_files(spark, sf_dir))


@register(
    "e22_run_report",
    """select source_id, candidate_seq, rank, score, c.start_ms, c.end_ms, c.text, hook_score, emotion_score, information_score,
      case when candidate_seq % 4 <> 3 then case when source_id % 5 = 0 then 'failed' else 'success' end else 'not rendered' end as clip_status, case when candidate_seq % 4 <> 3 then source_id * 1000 + candidate_seq end as clip_bytes
     from (select *, row_number() over (partition by source_id order by score desc, candidate_seq) as rank from heuristic) h join candidates c using (source_id, candidate_seq) where rank <= 3""",
)
def e22(spark, sf_dir):
    cands = lexical.score_heuristic(segmentation.candidate_windows(derived.segments(spark, sf_dir)))
    scored = materialise(
        cands.select(
            "source_id", "candidate_seq", "start_ms", "end_ms", "text", "score", "hook_score", "emotion_score", "information_score"
        )
    )
    # texts are written once, not again for the ranks
    top = ranking.rank_predictions(scored.select("source_id", "candidate_seq", "start_ms", "end_ms", "score")).where(F.col("rank") <= 3)
    q = F.col("candidate_seq")
    clips = scored.where(q % 4 != 3).select(
        "source_id", "candidate_seq", F.when(F.col("source_id") % 5 == 0, "failed").otherwise("success").alias("status"),
        (F.col("source_id") * 1000 + q).alias("bytes"),
    )
    return au.run_report(top, scored, clips)
