"""Streaming runs over files, against the same transformation in batch."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import streams
from clipspark.operators import framing
from clipspark.sources import derived
from clipspark.streaming import pipelines as st
from clipspark.streaming.replay import replay
from tests.conftest import rows


def _stream(spark, df, path, parts, order):
    """Write ``df`` as several ordered files and read them one file per batch."""
    import time

    full = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(order))).cache()
    for i in range(1, parts + 1):
        full.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their modification time
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(df, name, tmp_path, mode="append"):
    q = (
        df.writeStream.outputMode(mode).format("memory").queryName(name)
        .option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(240)
    return df.sparkSession.table(name)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_runs_split_on_silence(spark):
    seg = spark.createDataFrame(
        [(1, 0, 2_000), (1, 3_200, 4_000), (1, 5_201, 6_000), (2, 0, 1_000)], "source_id long, s long, e long"
    ).select("source_id", F.timestamp_millis("s").alias("start_ts"), F.timestamp_millis("e").alias("end_ts"))
    got = [(r["source_id"], r["segments"]) for r in st.stream_runs(seg).orderBy("source_id", "run_start_us").collect()]
    assert got == [(1, 2), (1, 1), (2, 1)]  # a gap of exactly 1.2 s does not split


def test_dedup_serves_once(spark, sf_dir, tmp_path):
    ev = derived.table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("request_hash"), F.to_timestamp("ts").alias("ts"))
    out = _run(st.stream_dedup(_stream(spark, ev, str(tmp_path / "d"), 2, "ts"), "100 days"), "dedup_out", tmp_path)
    assert rows(out, "request_hash") == rows(ev.select("request_hash").distinct())


def test_tracks_equal_the_batch_ones(spark, sf_dir):
    """Row by row, with batch borders inside frames and rows that come late; no clip's state is left."""
    d = derived.detections(spark, sf_dir).where(F.col("clip_id") < 4_000_000)
    slices = streams.split_frames(d)
    assert all(s["in"].count() for s in slices)
    run = replay(spark, slices, lambda s: st.stream_tracks(s["in"]))
    assert rows(run.table.drop("batch").where("clip_id >= 0")) == rows(framing.track_subjects(d))
    assert run.table.select("batch").distinct().count() > 1
    # a buffered frame and its timer at most, of the clip that only moved time on
    assert run.kept[0] > 20 and run.kept[-1] <= 8


def test_a_silent_clip_starts_anew(spark):
    box = "0 as subject, 10 as x, 10 as y, 50 as w, 50 as h, 'face' as type, false as scene_cut"
    d = spark.sql(f"select 1L as clip_id, id as frame, id * 200 as t_ms, {box} from range(60) where id < 10 or id >= 30")
    d = d.selectExpr("*", "timestamp_millis(t_ms + 86400000) as ts")
    got = replay(spark, [{"in": d}, {"in": d.where("frame = 1").selectExpr("-1L as clip_id", *d.columns[1:-1], "ts + interval 1 day as ts")}], lambda s: st.stream_tracks(s["in"])).table
    ids = {r.frame: (r.track_id, r.hits) for r in got.where("clip_id = 1").collect()}
    assert ids[9] == (1, 10) and ids[30][1] == 1 and len(ids) == 40


def test_late_rows_are_counted(spark, sf_dir):
    late = entry.queries()["st1_late_rows"](spark, sf_dir).first()
    assert late.late_bins > 0 and late.bins > 0


def test_silent_owner_is_reported(rocks, tmp_path):
    spark = rocks
    beats = spark.createDataFrame(
        [("a", 0, "j1"), ("b", 0, "j2"), ("b", 100, "j2"), ("b", 200, "j2"), ("b", 400, "j3"), ("b", 450, "j3")], "owner string, t long, job_id string"
    ).select("owner", F.timestamp_seconds(F.col("t") + 1000).alias("ts"), "job_id")
    out = _run(st.stream_stale(_stream(spark, beats, str(tmp_path / "h"), 3, "ts")), "stale_out", tmp_path)
    assert ("a", "1000000", "j1") in rows(out)


def test_clips_share_state_by_group(spark):
    """Boxes of 1,500 clips, cut by time, with a silence in some and one row of no clip: the
    tracks of the batch run, from a state with fewer rows than clips."""
    box = "id % 2 as subject, 10 + 9 * (id % 5) as x, 10 as y, 50 as w, 50 as h, 'face' as type, id % 7 = 0 as scene_cut"
    d = spark.sql(f"select id % 1500 as clip_id, id div 1500 as frame, id div 1500 * 400 as t_ms, {box} from range(9000) where id % 11 <> 3")
    d = d.unionByName(d.where("clip_id = 5").withColumn("clip_id", F.lit(None).cast("long")))
    at = d.selectExpr("*", "timestamp_millis(t_ms + 86400000) as ts")
    end = at.where("clip_id = 7 and frame = 1").selectExpr("-1L as clip_id", *d.columns[1:], "ts + interval 1 day as ts")
    run = replay(spark, [{"in": at.where("frame < 3")}, {"in": at.where("frame >= 3")}, {"in": end}], lambda s: st.stream_tracks(s["in"], "200 milliseconds"))
    got = run.table.drop("batch").where("clip_id >= 0 or clip_id is null")
    assert rows(got.where("clip_id is not null")) == rows(framing.track_subjects(d.where("clip_id is not null")))
    assert rows(got.where("clip_id is null").drop("clip_id")) == rows(got.where("clip_id = 5").drop("clip_id")) != []
    assert max(run.kept) < 1_500
