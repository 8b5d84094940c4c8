"""Queries on streams: given tables are fed in slices of time to a running query.

Every query here reads a real stream over files (``clipspark/streaming/replay.py``), stopped
and restarted between slices. A last row far ahead in time closes what is still open; its own
results are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog import register
from clipspark.sources import derived
from clipspark.streaming import pipelines as st
from clipspark.streaming.replay import by_time, replay

SLICES = 3


def _events(spark, sf_dir):
    return derived.table(spark, sf_dir, "events").withColumn("ts", F.to_timestamp("ts"))


def _ahead(df: DataFrame, column: str, **fixed: object) -> DataFrame:
    """One row 400 days after the last, with ``fixed`` values or nulls elsewhere."""
    others = [F.lit(fixed.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != column]
    return df.agg((F.max(column) + F.expr("interval 400 days")).alias(column)).select(*others, column).select(df.columns)


def _fed(spark, df: DataFrame, column: str, build, **last: object) -> DataFrame:
    """Rows of a stream with one input that is cut by time and closed."""
    slices = [{"in": part} for part in by_time(df, column, SLICES)]
    return replay(spark, [*slices, {"in": _ahead(df, column, **last)}], lambda s: build(s["in"])).table.drop("batch")


@register(
    "st1_stream_activity",
    """select user_id as source_id, cast(epoch(date_trunc('second', ts)) as bigint) as second, count(*) as frames, max(value) as peak, count(*) filter (where value >= 0.01e0) / count(*) as speech from events group by 1, 2""",
)
def st1(spark, sf_dir):
    frames = _events(spark, sf_dir).select(F.col("user_id").alias("source_id"), "ts", F.col("value").alias("rms"))
    return _fed(spark, frames, "ts", st.stream_activity, source_id=-1).where("source_id >= 0")


@register(
    "st1_late_rows",
    """with e as (select user_id, epoch_us(ts) // 1000000 as second, event_id % 50 = 7 and epoch_us(ts) < lo + (hi - lo) // 3 + 1 as late
      from events, (select min(epoch_us(ts)) as lo, max(epoch_us(ts)) as hi from events))
     select count(distinct (user_id, second)) filter (where late) as late_bins, count(distinct (user_id, second)) filter (where not late) as bins, count(*) filter (where not late) as frames from e""",
)
def st1_late(spark, sf_dir):
    """Every fiftieth row of the first third arrives with the last third, and is refused."""
    frames = _events(spark, sf_dir).select(F.col("user_id").alias("source_id"), "ts", F.col("value").alias("rms"), "event_id")
    first, second, third = by_time(frames, "ts", 3)
    late = F.col("event_id") % 50 == 7
    slices = [{"in": p} for p in (first.where(~late), second, third.unionByName(first.where(late)), _ahead(frames, "ts", source_id=-1))]
    run = replay(spark, slices, lambda s: st.stream_activity(s["in"]))
    return run.table.where("source_id >= 0").agg(
        F.lit(run.dropped).cast("long").alias("late_bins"), F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum("frames"), F.lit(0)).cast("long").alias("frames")
    )


@register(
    "st2_stream_runs",
    """with s as (select *, coalesce(start_ms - max(end_ms) over (partition by source_id order by segment_id rows between unbounded preceding and 1 preceding) > 1200, false) as f from segments),
     r as (select *, sum(cast(f as int)) over (partition by source_id order by segment_id) as run from s)
     select source_id, min(start_ms) * 1000 as run_start_us, max(end_ms) * 1000 as run_end_us, count(*) as segments from r group by source_id, run""",
)
def st2(spark, sf_dir):
    seg = derived.segments(spark, sf_dir).select("source_id", F.timestamp_millis("start_ms").alias("start_ts"), F.timestamp_millis("end_ms").alias("end_ts"))
    slices = [{"in": part} for part in by_time(seg, "start_ts", SLICES)]
    last = _ahead(seg, "start_ts", source_id=-1).withColumn("end_ts", F.col("start_ts"))
    return replay(spark, [*slices, {"in": last}], lambda s: st.stream_runs(s["in"])).table.drop("batch").where("source_id >= 0")


@register(
    "st3_stream_context",
    """with w as (select source_id, text, unnest([0, 1, 2]) as k, start_ms // 15000 as b from segments), s as (select source_id, (b - k) * 15 as window_start, cast(sum(len(regexp_split_to_array(trim(text), '\\s+'))) as bigint) as words from w group by 1, 2)
     select *, rnd1(words / 0.75e0) as wpm from s""",
)
def st3(spark, sf_dir):
    seg = derived.segments(spark, sf_dir).select("source_id", F.timestamp_millis("start_ms").alias("start_ts"), "text")
    return _fed(spark, seg, "start_ts", st.stream_context, source_id=-1, text="").where("source_id >= 0")


@register(
    "st4_stream_stale",
    """with e as (select user_id, max(event_id) as event_id, epoch_us(ts) // 1000 as ms from events group by user_id, epoch_us(ts) // 1000),
     n as (select *, lead(ms) over (partition by user_id order by ms) as after from e)
     select user_id::varchar as owner, ms as last_seen_ms, 'j' || lpad(event_id::varchar, 12, '0') as orphaned_job from n where after is null or after - ms > 120000""",
)
def st4(spark, sf_dir):
    job = F.concat(F.lit("j"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    beats = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("owner"), "ts", job.alias("job_id"))
    return _fed(spark, beats, "ts", st.stream_stale, owner="end").where("owner <> 'end'")


@register(
    "st5_stream_handoff",
    """select r.user_id as source_id, epoch_us(r.ts) as requested_us, epoch_us(t.ts) as arrived_us, t.ts is not null as resumed from (select * from events where event_type = 'signup') r
      left join (select * from events where event_type = 'purchase') t on r.user_id = t.user_id and t.ts >= r.ts and t.ts <= r.ts + interval 12 hour""",
)
def st5(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumnRenamed("user_id", "source_id")
    req = ev.where(F.col("event_type") == "signup").select("source_id", F.col("ts").alias("requested_at"))
    arr = ev.where(F.col("event_type") == "purchase").select("source_id", F.col("ts").alias("arrived_at"))
    slices = [{"req": r, "arr": a} for r, a in zip(by_time(req, "requested_at", SLICES), by_time(arr, "arrived_at", SLICES))]
    last = {"req": _ahead(req, "requested_at", source_id=-1), "arr": _ahead(arr, "arrived_at", source_id=-2)}
    found = replay(spark, [*slices, last], lambda s: st.stream_handoff(s["req"], s["arr"], "12 hours")).table.where("source_id >= 0")
    return found.select("source_id", F.unix_micros("requested_at").alias("requested_us"), F.unix_micros("arrived_at").alias("arrived_us"), "resumed")


@register("st6_stream_dedup", "select distinct user_id || ':' || event_type as request_hash from events")
def st6(spark, sf_dir):
    req = _events(spark, sf_dir).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("request_hash"), "ts")
    slices = [{"in": part} for part in by_time(req, "ts", SLICES)]
    return replay(spark, slices, lambda s: st.stream_dedup(s["in"], "1000 days")).table.select("request_hash")


def split_frames(dets: DataFrame, border_ms: int = 4_000) -> list[dict[str, DataFrame]]:
    """Frames before the border, before twice the border, and the rest; of the last second
    before a border, the boxes of even subjects come a slice later, so frames are split over
    batches. Then one row far ahead."""
    at = dets.withColumn("ts", F.timestamp_millis(F.col("t_ms") + 86_400_000))  # Spark takes nothing at or before 1970-01-01 00:00
    slot: Column = F.least(F.floor(F.col("t_ms") / border_ms), F.lit(SLICES - 1))
    moved = (F.col("t_ms") % border_ms >= border_ms - 1_000) & F.coalesce(F.col("subject") % 2 == 0, F.lit(False))
    slot = F.least(slot + moved.cast("int"), F.lit(SLICES - 1))
    return [*({"in": at.where(slot == k)} for k in range(SLICES)), {"in": _ahead(at, "ts", clip_id=-1, frame=0, t_ms=0, scene_cut=False)}]


@register("st7_stream_tracks")
def st7(spark, sf_dir):
    run = replay(spark, split_frames(derived.detections(spark, sf_dir)), lambda s: st.stream_tracks(s["in"]))
    return run.table.drop("batch").where("clip_id >= 0")


@register(
    "st8_stream_progress",
    """with z as (select user_id as job_id, arg_max({'d': value, 'e': event_id}, {'t': ts, 'v': value}) as z from events group by 1)
     select job_id, rnd2(least(100.0e0, z.d / 500.0e0 * 100)) as percent, rnd3(z.d / (z.e % 100 + 1)) as realtime_factor, rnd2(greatest(0.0e0, 500.0e0 - z.d) / (z.d / (z.e % 100 + 1))) as eta_s from z""",
)
def st8(spark, sf_dir):
    p = _events(spark, sf_dir).select(
        F.col("user_id").alias("job_id"), "ts", F.col("value").alias("done_s"), F.lit(500.0).alias("total_s"), (F.col("event_id") % 100 + 1).cast("double").alias("elapsed_s")
    )
    told = replay(spark, [{"in": part} for part in by_time(p, "ts", SLICES)], lambda s: st.stream_progress(s["in"]), "update").table
    newest = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("batch")))
    return told.withColumn("nth", newest).where("nth = 1").drop("nth", "batch")
