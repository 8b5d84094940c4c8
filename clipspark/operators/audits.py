"""Audits and reports over jobs, caches, files and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import digest, first_match

# Job states, failure classes, tolerances.
STAGE_PROGRESS = {
    "QUEUED": 0, "INGESTING": 10, "TRANSCRIBING": 30, "AWAITING_TRANSCRIPT": 30, "DISCOVERING": 55,
    "RANKING": 65, "RENDERING": 75, "UPLOADING": 95, "DONE": 100, "FAILED": 0,
}
ACTIVE = ("QUEUED", "INGESTING", "TRANSCRIBING", "AWAITING_TRANSCRIPT", "DISCOVERING", "RANKING", "RENDERING", "UPLOADING")
RETRYABLE = (
    "ConnectionError", "ReadTimeout", "ConnectTimeout", "Timeout", "EndpointConnectionError", "ClientError",
    "IncompleteRead", "ChunkedEncodingError", "ProtocolError", "SSLError", "OSError", "R2UploadError", "TimeoutExpired",
)
FINAL = (
    "InvalidUrlError", "ValueError", "FileNotFoundError", "KeyError", "SubtitleBurnUnsupportedError",
    "FFmpegNotFoundError", "R2ConfigurationError", "InsufficientDiskSpaceError", "SourceBlockedError",
)
DRIFT_MIN_MS, DRIFT_MAX_MS = 2_000, 5_000


def _audit(cached: DataFrame, requested: DataFrame, key: str, checks: Sequence[tuple[str, str, Column | None]]) -> DataFrame:
    """HIT, or the first field (in the given order) whose cached and requested values
    differ; a check with a condition counts only where that holds."""
    c = cached.select(key, *[F.col(f).alias(f"_c_{f}") for f, _, _ in checks], F.lit(True).alias("_have"))
    rows = requested.join(c, key, "left")
    ladder: list[tuple[Column, Column]] = [(F.col("_have").isNull(), F.lit("MISS: nothing cached"))]
    for field, label, when in checks:
        differs = ~F.col(f"_c_{field}").eqNullSafe(F.col(field))
        if when is not None:
            differs = differs & when
        shown = [F.coalesce(x.cast("string"), F.lit("None")) for x in (F.col(f"_c_{field}"), F.col(field))]
        ladder.append(
            (differs, F.concat(F.lit(f"MISS: {label} (cached="), shown[0], F.lit(", requested="), shown[1], F.lit(")")))
        )
    return rows.select(key, first_match(ladder, "HIT").alias("outcome"))


def transcript_cache_audit(cached: DataFrame, requested: DataFrame, key: str = "source_id") -> DataFrame:
    return _audit(
        cached, requested, key,
        [
            ("fingerprint", "source fingerprint mismatch", F.coalesce(F.col("_c_fingerprint") != "", F.lit(False))),
            ("model", "ASR model changed", None),
            ("device", "ASR device changed", None),
            ("compute_type", "ASR compute_type changed", None),
            ("language", "ASR language changed", F.col("language").isNotNull()),
            ("beam_size", "ASR beam_size changed", None),
            ("vad_filter", "ASR vad_filter changed", None),
        ],
    )


def candidate_cache_audit(cached: DataFrame, requested: DataFrame, key: str = "source_id") -> DataFrame:
    return _audit(
        cached, requested, key,
        [
            ("transcript_hash", "transcript changed", None),
            ("min_s", "min_seconds changed", None),
            ("target_s", "target_seconds changed", None),
            ("max_s", "max_seconds changed", None),
            ("overlap_s", "overlap_seconds changed", None),
        ],
    )


def pad_clips(highlights: DataFrame, sources: DataFrame, pad_ms: int = 2_000) -> DataFrame:
    """Room before and after each highlight, inside its source."""
    rows = highlights.join(sources.select("source_id", "duration_ms"), "source_id")
    return rows.select(
        "source_id", "rank",
        (F.greatest(F.lit(0), F.col("start_ms") - pad_ms) / 1000.0).alias("padded_start_s"),
        (F.least(F.col("duration_ms"), F.col("end_ms") + pad_ms) / 1000.0).alias("padded_end_s"),
    )


def classify_failures(jobs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Whether retrying a failed job can help. A class known to fail again wins over
    retryable ancestors. ``ancestors``: error_type, ancestor (itself included)."""
    kin = ancestors.groupBy("error_type").agg(
        F.bool_or(F.col("ancestor").isin(*RETRYABLE)).alias("_again"),
    )
    return jobs.join(kin, "error_type", "left").select(
        *jobs.columns,
        F.when(F.col("error_type").isin(*FINAL), False).otherwise(F.coalesce("_again", F.lit(False))).alias("retryable"),
    )


def job_progress(jobs: DataFrame) -> DataFrame:
    """Percent done; a failed job reports the stage it had reached."""
    reached = F.when(F.col("status") == "FAILED", F.col("stage")).otherwise(F.col("status"))
    percent = first_match([(reached == s, p) for s, p in STAGE_PROGRESS.items()], 0).cast("long")
    failed = F.col("status") == "FAILED"
    return jobs.select(
        "job_id", "status", percent.alias("progress"),
        F.when(failed, F.col("error_type")).alias("error_type"),
        F.when(failed, F.coalesce("retryable", F.lit(False))).alias("error_retryable"),
    )


def duration_drift(pairs: DataFrame) -> DataFrame:
    """Whether an audio artifact spans its source, within a tolerance that grows with
    the source between two bounds."""
    src, audio = F.col("source_ms"), F.col("audio_ms")
    tol = F.greatest(F.lit(DRIFT_MIN_MS * 1.0), F.least(F.lit(DRIFT_MAX_MS * 1.0), src * 0.001))
    drift = F.abs(audio - src)
    known = F.coalesce(src > 0, F.lit(False))
    return pairs.select(
        "key",
        F.when(known, tol).alias("tolerance_ms"),
        first_match(
            [
                (~known, F.lit(None).cast("string")),
                (audio.isNull(), "the extracted audio has no readable duration"),
                (drift > tol, F.concat(F.lit("off by "), drift.cast("string"), F.lit(" ms"))),
            ],
            F.lit(None).cast("string"),
        ).alias("complaint"),
    )


def select_backfill(labels: DataFrame, ids: DataFrame | None = None, include_complete: bool = False) -> DataFrame:
    """Judged candidates that still lack their dimensions."""
    dims = ("hook_score", "standalone_score", "payoff_score", "value_score", "context_dependency", "bad_start", "bad_end")
    out = labels.where(F.col("human_score").isNotNull())
    if ids is not None:
        out = out.join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi")
    if not include_complete:
        out = out.where(F.coalesce(*[F.col(d).cast("string") for d in dims]).isNull())
    return out


def run_identity(runs: DataFrame) -> DataFrame:
    """Identity of a run over a stored transcript."""
    return runs.withColumn(
        "fingerprint_id",
        digest(F.lit("r2_transcript"), F.col("source_id"), F.col("bucket"), F.col("transcript_key"), F.col("transcript_hash")),
    )


def drawn(seed: int, *columns: str) -> Column:
    """A sort key for drawing rows in an order that depends on the seed alone."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def blind_export(cands: DataFrame, seed: int = 42) -> DataFrame:
    """Candidates for blind review: no model column survives, and the order depends on
    the seed alone (shown as a sort key, so no task has to hold the whole order)."""
    return cands.select(
        "source_id", "candidate_seq", "start_ms", "end_ms", "text",
        drawn(seed, "source_id", "candidate_seq").alias("blind_order"),
        F.lit(None).cast("double").alias("human_score"),
        F.lit(None).cast("boolean").alias("publishable"),
    )


def blind_groups(
    pool: DataFrame, preds: DataFrame, shortlist: DataFrame, final: str, mid: str,
    mid_range: tuple[int, int] = (16, 32), sizes: tuple[int, int, int] = (4, 4, 0), seed: int = 1337,
) -> DataFrame:
    """Candidates for a blind spot check: some of middling rank, some never shortlisted,
    some at the top. Each candidate serves in its first group only."""
    key = ["candidate_set_id"]
    pick = Window.partitionBy(*key)
    a = (
        preds.where((F.col("scorer") == mid) & F.col("rank").between(*mid_range))
        .withColumn("_rn", F.row_number().over(pick.orderBy("rank", "candidate_id")))
        .where(F.col("_rn") <= sizes[0])
        .select(*key, "candidate_id", F.lit("A").alias("blind_group"))
    )
    b = (
        pool.select(*key, "candidate_id")
        .join(shortlist.select(*key, "candidate_id"), [*key, "candidate_id"], "left_anti")
        .withColumn("_rn", F.row_number().over(pick.orderBy(drawn(seed, "candidate_id"), "candidate_id")))
        .where(F.col("_rn") <= sizes[1])
        .select(*key, "candidate_id", F.lit("B").alias("blind_group"))
    )
    c = (
        preds.where((F.col("scorer") == final) & (F.col("status").isNull() | (F.col("status") == "ranked")))
        .withColumn("_rn", F.row_number().over(pick.orderBy("rank", "candidate_id")))
        .where(F.col("_rn") <= sizes[2])
        .select(*key, "candidate_id", F.lit("C").alias("blind_group"))
    )
    chosen = a.unionByName(b).unionByName(c).groupBy(*key, "candidate_id").agg(F.min("blind_group").alias("blind_group"))
    known = chosen.join(pool.select(*key, "candidate_id"), [*key, "candidate_id"], "left_semi")
    order = pick.orderBy(drawn(seed + 1, "candidate_id"), "candidate_id")
    return known.withColumn("blind_id", F.format_string("blind_%03d", F.row_number().over(order)))


def blind_document(groups: DataFrame, pool: DataFrame) -> DataFrame:
    """What a reviewer gets: texts under blind ids, without candidate ids, ranks, scores or
    groups. ``pool``: candidate_set_id, candidate_id, text."""
    return groups.join(pool, ["candidate_set_id", "candidate_id"]).select("candidate_set_id", "blind_id", "text")


def blind_mapping(groups: DataFrame, preds: DataFrame, final: str, mid: str) -> DataFrame:
    """What stays with the examiner: the candidate behind each blind id, and its ranks."""
    key = ["candidate_set_id", "candidate_id"]
    rank = lambda scorer: F.max(F.when(F.col("scorer") == scorer, F.col("rank")))
    ranks = preds.where(F.col("scorer").isin(final, mid)).groupBy(*key).agg(rank(mid).alias("mid_rank"), rank(final).alias("final_rank"))
    return groups.join(ranks, key, "left").select("candidate_set_id", "blind_id", "candidate_id", "blind_group", "mid_rank", "final_rank")


def review_export(cands: DataFrame, highlights: DataFrame) -> DataFrame:
    """Candidates for open review, ranked ones first; ``review_key`` sorts them."""
    h = highlights.select("source_id", "candidate_seq", "rank", "score")
    rows = cands.join(h, ["source_id", "candidate_seq"], "left")
    return rows.select(
        "source_id", "candidate_seq", "start_ms", "end_ms", "rank", "score",
        F.when(F.col("rank").isNotNull(), F.col("rank").cast("double")).otherwise(1e6 - F.coalesce("score", F.lit(0.0))).alias("review_key"),
        F.lit(None).cast("string").alias("human_label"),
    )


def manifest_counts(results: DataFrame, key: str) -> DataFrame:
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = results.groupBy(key).agg(
        F.count(F.lit(1)).alias("requested"),
        n(F.col("status") == "success").alias("succeeded"),
        n((F.col("status") == "success") & F.col("fallback")).alias("fallbacks"),
        n(F.col("status") != "success").alias("failed"),
    )
    return out.withColumn(
        "status",
        first_match([(F.col("failed") == 0, "success"), (F.col("succeeded") == 0, "failed")], "partial_success"),
    )


def stage_durations(timings: DataFrame, stages: Sequence[object], key: str = "job_id") -> DataFrame:
    """Seconds per stage side by side, with skipped stages, attempts and the total."""
    return timings.groupBy(key).agg(
        *[F.round(F.sum(F.when(F.col("stage") == s, F.col("seconds"))), 2).alias(f"stage_{s}") for s in stages],
        F.sum(F.col("skipped").cast("long")).alias("skipped"),
        F.count(F.lit(1)).alias("attempts"),
        F.round(F.sum("seconds"), 2).alias("total_seconds"),
    )


def file_actions(files: DataFrame, replicas: DataFrame, aggressive: bool = False) -> DataFrame:
    """What may be deleted file by file: only what is verified to exist elsewhere.

    ``files``: source_id, path, kind, bytes, sha (may be null), key (null when never
    published); ``replicas``: key, bytes, sha. Equal sizes don't make a true copy when both
    checksums are known and differ."""
    r = replicas.select("key", F.col("bytes").alias("_rb"), F.col("sha").alias("_rs"), F.lit(True).alias("_there"))
    # files without a key meet no replica: in the join they would all go to one task
    found = files.where(F.col("key").isNotNull()).join(r, "key", "left")
    rows = found.unionByName(files.where(F.col("key").isNull()), allowMissingColumns=True)
    copied = F.col("kind").isin("clip", "source")
    sized = F.coalesce(F.col("_rb") == F.col("bytes"), F.lit(False))
    same = sized & F.coalesce(F.col("_rs") == F.col("sha"), F.lit(True))
    reason = first_match(
        [
            (copied & F.col("key").isNull(), "remote_not_verified (no remote key)"),
            (copied & F.col("_there").isNull(), "remote_not_verified (remote object missing)"),
            (copied & ~sized, "remote_not_verified (remote size differs)"),
            (copied & ~same, "remote_not_verified (remote sha256 differs)"),
            (F.col("kind") == "clip", F.concat(F.lit("published at "), F.col("key"))),
            (F.col("kind") == "source", F.concat(F.lit("re-fetchable from "), F.col("key"))),
            (F.col("kind") == "intermediate", "regenerable intermediate" if aggressive else "cheap to keep, expensive to regenerate"),
        ],
        "needed to resume without re-downloading",
    )
    gone = (copied & same) | ((F.col("kind") == "intermediate") & F.lit(aggressive))
    return rows.select("source_id", "path", "kind", "bytes", F.when(gone, "DELETE").otherwise("KEEP").alias("action"), reason.alias("reason"))


def retention_plan(
    dirs: DataFrame, actions: DataFrame, jobs: DataFrame, now_s: int, min_age_s: int = 3600,
    keep_recent: int = 0, cap_bytes: int | None = None, job_id: str | None = None,
) -> DataFrame:
    """Which run directories to clean: never active, recent or new ones, and oldest
    first only until the tree is under its cap.

    ``dirs``: source_id, mtime_s. The running total is kept per day of last use, with
    one row per day giving each day its offset, so no task orders the whole tree."""
    active = (
        jobs.where(F.col("status").isin(*ACTIVE)).groupBy("source_id").agg(F.min("status").alias("_state"))
    )
    sizes = actions.groupBy("source_id").agg(
        F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("action") == "DELETE", F.col("bytes")).otherwise(0)).alias("reclaimable")
    )
    visible = dirs.where(~F.col("source_id").cast("string").startswith("_"))
    if job_id is not None:  # only the directory of this job's source
        visible = visible.join(jobs.where(F.col("job_id") == job_id).select("source_id").distinct(), "source_id", "left_semi")
    # at most keep_recent rows
    recent = visible.orderBy(F.col("mtime_s").desc(), F.col("source_id").desc()).limit(keep_recent).select("source_id", F.lit(True).alias("_recent"))
    rows = visible.join(sizes, "source_id", "left").join(active, "source_id", "left").join(F.broadcast(recent), "source_id", "left")
    rule = first_match(
        [
            (F.col("_state").isNotNull(), F.concat(F.lit("active_job ("), F.col("_state"), F.lit(")"))),
            (F.col("_recent"), "keep_recent"),
            (F.col("mtime_s") > now_s - min_age_s, "newer_than"),
        ],
        F.lit(None).cast("string"),
    )
    ruled = rows.withColumn("rule", rule).withColumn("day", F.floor(F.col("mtime_s") / 86_400)).withColumn(
        "_take", F.when(F.col("rule").isNull(), F.coalesce("reclaimable", F.lit(0))).otherwise(0)
    )
    if cap_bytes is None:
        met = F.lit(False)
    else:
        per_day = ruled.groupBy("day").agg(F.sum("_take").alias("_d"), F.sum("bytes").alias("_b"))
        ahead = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        days = per_day.select(
            "day",
            F.coalesce(F.sum("_d").over(ahead), F.lit(0)).alias("_base"),
            (F.sum("_b").over(Window.partitionBy()) - F.lit(cap_bytes)).alias("_need"),
        )
        local = Window.partitionBy("day").orderBy("mtime_s", "source_id").rowsBetween(Window.unboundedPreceding, -1)
        ruled = ruled.join(days, "day").withColumn("_before", F.col("_base") + F.coalesce(F.sum("_take").over(local), F.lit(0)))
        met = F.greatest(F.lit(0), F.col("_need")) - F.col("_before") <= 0
    return ruled.select(
        "source_id", "bytes", "reclaimable",
        first_match(
            [(F.col("rule").startswith("active"), "SKIP"), (F.col("rule").isNotNull(), "KEEP"), (met, "KEEP")], "CLEAN"
        ).alias("decision"),
        first_match([(F.col("rule").isNotNull(), F.col("rule")), (met, "disk target already met")], "eligible").alias("reason"),
    )


def run_inventory(files: DataFrame) -> DataFrame:
    """Bytes and files per source with a grand total; underscore roots do not count."""
    seen = files.where(~F.col("source_id").cast("string").startswith("_"))
    per_source = seen.groupBy("source_id").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    return (
        per_source.rollup("source_id")
        .agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.count(F.lit(1)).alias("sources"))
        .withColumn("scope", F.when(F.col("source_id").isNull(), "all").otherwise("source"))
    )


def run_report(highlights: DataFrame, cands: DataFrame, clips: DataFrame) -> DataFrame:
    """Ranked highlights with full text, sub-scores and what became of their clips."""
    c = cands.select("source_id", "candidate_seq", "text", "hook_score", "emotion_score", "information_score")
    f = clips.select("source_id", "candidate_seq", F.col("status").alias("clip_status"), F.col("bytes").alias("clip_bytes"))
    return (
        highlights.select("source_id", "candidate_seq", "rank", "score", "start_ms", "end_ms")
        .join(c, ["source_id", "candidate_seq"], "left")
        .join(f, ["source_id", "candidate_seq"], "left")
        .withColumn("clip_status", F.coalesce("clip_status", F.lit("not rendered")))
    )
