"""The long-running behaviours as Structured Streaming transformations.

Each function takes and returns a streaming DataFrame (the windowed ones give the same
result on a batch one). State is keyed by source, clip, owner or job. It goes when the
watermark passes it, but for one row per job of ``stream_progress``.
``replay.py`` runs them over slices of tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clipspark.operators.framing import SIDE_BY_SIDE, TRACK_SCHEMA, Tracking, no_tracks, track_rows

STALE_S = 120
TRACK_EXPIRY_MS = 1_600


def stream_activity(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """One-second bins per source as sound arrives; later rows are dropped and counted as
    one per bin in the query's progress (``replay`` sums that up). ``frames``: source_id, ts, rms."""
    return (
        frames.withWatermark("ts", delay)
        .groupBy("source_id", F.window("ts", "1 second").alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"), F.max("rms").alias("peak"), F.avg((F.col("rms") >= 0.01).cast("double")).alias("speech"))
        .select("source_id", F.unix_seconds("w.start").alias("second"), "frames", "peak", "speech")
    )


def stream_runs(segments: DataFrame, gap_s: float = 1.2, delay: str = "10 minutes") -> DataFrame:
    """Stretches of speech: a new one starts after a silence longer than the gap, which
    is counted from the end of a segment. ``segments``: source_id, start_ts, end_ts."""
    length = F.unix_micros("end_ts") - F.unix_micros("start_ts") + int(gap_s * 1_000_000)
    width = F.concat((length + 1).cast("string"), F.lit(" microseconds"))
    return (
        segments.withWatermark("start_ts", delay)
        .groupBy("source_id", F.session_window("start_ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("segments"), F.max("end_ts").alias("run_end"))
        .select("source_id", F.unix_micros("w.start").alias("run_start_us"), F.unix_micros("run_end").alias("run_end_us"), "segments")
    )


def stream_context(segments: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Words per minute over the last 45 s, every 15 s. ``segments``: source_id, start_ts, text."""
    said = F.size(F.split(F.trim("text"), r"\s+"))
    return (
        segments.withWatermark("start_ts", delay)
        .groupBy("source_id", F.window("start_ts", "45 seconds", "15 seconds").alias("w"))
        .agg(F.sum(said).alias("words"))
        .select("source_id", F.unix_seconds("w.start").alias("window_start"), "words", F.round(F.col("words") / 0.75, 1).alias("wpm"))
    )


def stream_dedup(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Serve identical requests once. ``requests``: request_hash, ts, ..."""
    if requests.isStreaming:
        return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_hash"])
    return requests.dropDuplicates(["request_hash"])


def stream_handoff(requests: DataFrame, transcripts: DataFrame, patience: str = "1 hour") -> DataFrame:
    """Each parked request with the transcript that arrived for it within its patience,
    or alone once that has passed. ``requests``: source_id, requested_at;
    ``transcripts``: source_id, arrived_at."""
    r = requests.withWatermark("requested_at", "10 minutes").alias("r")
    t = transcripts.withWatermark("arrived_at", "10 minutes").alias("t")
    return r.join(
        t,
        F.expr(
            "r.source_id = t.source_id and t.arrived_at >= r.requested_at "
            f"and t.arrived_at <= r.requested_at + interval {patience}"
        ),
        "left_outer",
    ).select(F.col("r.source_id").alias("source_id"), "requested_at", "arrived_at", F.col("arrived_at").isNotNull().alias("resumed"))


def stream_progress(progress: DataFrame) -> DataFrame:
    """Latest percent, realtime factor and remaining seconds of each job (update mode).
    ``progress``: job_id, ts, done_s, total_s, elapsed_s. One state row per job, which stays."""
    last = F.max(F.struct("ts", "done_s", "total_s", "elapsed_s")).alias("z")
    rate = F.try_divide("z.done_s", "z.elapsed_s")
    return progress.groupBy("job_id").agg(last).select(
        "job_id",
        F.round(F.least(F.lit(100.0), F.try_divide("z.done_s", "z.total_s") * 100), 2).alias("percent"),
        F.round(rate, 3).alias("realtime_factor"),
        F.round(F.try_divide(F.greatest(F.lit(0.0), F.col("z.total_s") - F.col("z.done_s")), rate), 2).alias("eta_s"),
    )


class _InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark passes their time, and then hands all of
    them on in order of time, so that results don't depend on the borders of batches."""

    SPAN_MS: int
    """Rows are held by spans of this length, as each call on the state is a message to the JVM."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, found = None, {}
        for pdf in rows:
            texts = pdf.drop(columns="ts").to_json(orient="records", lines=True, double_precision=15).strip("\n").split("\n")
            for ms, text in zip(pdf["ms"].tolist(), texts):
                found.setdefault(int(ms) // self.SPAN_MS, []).append(text)
                first = int(ms) if first is None else min(first, int(ms))
        have = {k[0] for k in self.waiting.keys()}
        for span, texts in found.items():
            if span in have:
                texts = [self.waiting.getValue((span,))[0], *texts]
            self.waiting.updateValue((span,), (",".join(texts),))
        self._wake(first, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def _wake(self, ms: int, now: int) -> None:
        """Have a timer run out at ``ms`` or before; those up to ``now`` are spent."""
        if not any(now < t <= ms for t in self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due, after = timerValues.getCurrentWatermarkInMs(), [], None
        held = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        past = [span for span, _ in held if span * self.SPAN_MS <= now]
        for span, texts in held[: len(past) + 1]:
            rows = sorted(json.loads(f"[{texts}]"), key=lambda r: r["ms"])  # stable: rows of a time stay as they came
            ready = sum(r["ms"] <= now for r in rows)
            due += rows[:ready]
            if ready < len(rows):
                after = rows[ready]["ms"] if after is None else after
                if ready:
                    self.waiting.updateValue((span,), (",".join(map(json.dumps, rows[ready:])),))
                if span in past:
                    past.remove(span)
        if len(past) == len(held):
            self.waiting.clear()
        else:
            for span in past:
                self.waiting.removeKey((span,))
        yield from self.advance(key, due, now)
        later = [t for t in (after, self.end) if t is not None]
        if later:
            self._wake(min(later), now)

    def advance(self, key, rows: list[dict], now: int) -> Iterator[pd.DataFrame]:
        """Results of the rows, which come in order, given that time is ``now``. Sets ``end``:
        when the state of the key ends if nothing comes, or None without state."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Heartbeat(_InOrder):
    """Remembers an owner's last sign of life and its open job; speaks up when the next is
    later than the limit, or when the watermark passes the limit without one."""

    SPAN_MS = 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ms long, job string")

    def advance(self, key, rows: list[dict], now: int) -> Iterator[pd.DataFrame]:
        last, found = self.last.get(), []
        for ms, job in sorted((r["ms"], r["job_id"]) for r in rows):
            if last and ms - last[0] > STALE_S * 1000:
                found.append(last)
            last = (ms, job)
        if last and now - last[0] > STALE_S * 1000:
            found.append(last)
            last = None
        self.last.update(tuple(last)) if last else self.last.clear()
        self.end = last[0] + STALE_S * 1000 + 1 if last else None
        if found:
            yield pd.DataFrame({"owner": [key[0]] * len(found), "last_seen_ms": [f[0] for f in found], "orphaned_job": [f[1] for f in found]})


def stream_stale(heartbeats: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Owners silent for more than two minutes, with the job each leaves behind.

    ``heartbeats``: owner, ts, job_id. Needs the RocksDB state store."""
    rows = heartbeats.withWatermark("ts", delay).select("owner", "ts", F.unix_millis("ts").alias("ms"), "job_id")
    return rows.groupBy("owner").transformWithStateInPandas(
        statefulProcessor=_Heartbeat(), outputStructType="owner string, last_seen_ms long, orphaned_job string", outputMode="Append", timeMode="EventTime"
    )


#: Stands for a missing clip, which would turn a column of ids into floating numbers.
NO_CLIP = -(1 << 63)
_BOXES = ["clip_id", "frame", "t_ms", "subject", "x", "y", "w", "h", "type", "scene_cut"]


def _boxes(rules: Tracking) -> list[str]:
    return [*_BOXES, "appearance"] if rules.look_size else _BOXES


def _box_types(rules: Tracking) -> pa.Schema:
    known = {"type": pa.string(), "scene_cut": pa.bool_(), "appearance": pa.list_(pa.float64())} | {c: pa.float64() for c in (*"xywh", "subject")}
    return pa.schema([(c, known.get(c, pa.int64())) for c in ("ms", *_boxes(rules))])


def _packed(*tables: pa.Table) -> bytes:
    """Tables one after another, as ``_unpacked`` reads them."""
    sink = pa.BufferOutputStream()
    for table in tables:
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> list[pa.Table]:
    source, found = pa.BufferReader(bytes(data)), []
    while source.tell() < source.size():
        found.append(pa.ipc.open_stream(source).read_all())
    return found


class _Clips:
    """The clips of a group that are not over: by clip the time of its last frame (``ms``), its
    next free id and last time, and the live tracks of all, with the place of their clip."""

    def __init__(self, rules: Tracking):
        self.rules = rules
        self.clip, self.ms, self.next_id = (np.zeros(0, np.int64) for _ in range(3))
        self.last_t, self.tracks = np.zeros(0), no_tracks(rules.look_size)

    def packed(self) -> bytes:
        clips = pa.table({"clip": self.clip, "ms": self.ms, "next_id": self.next_id, "last_t": self.last_t})
        tracks = {f: pa.array(v, pa.string() if f == "kind" else None) for f, v in self.tracks.items() if f != "look"}
        return _packed(clips, pa.table(tracks), pa.table({"look": self.tracks["look"].ravel()}))

    def unpack(self, data: bytes) -> None:
        clips, tracks, look = _unpacked(data)
        self.clip, self.ms, self.next_id, self.last_t = (clips[c].to_numpy() for c in ("clip", "ms", "next_id", "last_t"))
        self.tracks = {f: tracks[f].to_numpy().astype(object if f == "kind" else tracks[f].type.to_pandas_dtype()) for f in tracks.column_names}
        self.tracks["look"] = look["look"].to_numpy().reshape(tracks.num_rows, self.rules.look_size)

    def _keep(self, rows: np.ndarray) -> None:
        """Only these clips, in this order."""
        place = np.full(len(self.clip), -1)
        place[rows] = np.arange(len(rows))
        at = place[self.tracks["clip"]]
        self.tracks = {f: (at if f == "clip" else v)[at >= 0] for f, v in self.tracks.items()}
        self.clip, self.ms, self.next_id, self.last_t = (v[rows] for v in (self.clip, self.ms, self.next_id, self.last_t))

    def advance(self, rows: pa.Table) -> pa.Table:
        """Track the rows, which hold all of their frames and come after those before."""
        clip, ms = rows["clip_id"].to_numpy(), rows["ms"].to_numpy()
        order = np.lexsort((ms, clip))
        rows, clip, ms = rows.take(pa.array(order)), clip[order], ms[order]
        other = np.append(True, clip[1:] != clip[:-1])
        head = other | np.append(True, np.diff(ms) > TRACK_EXPIRY_MS)
        of, first = clip[head], other[head]
        last, until = np.append(first[1:], True), ms[np.append(head[1:], True)]
        at = np.minimum(np.searchsorted(self.clip, of), max(len(self.clip) - 1, 0))
        known = np.zeros(len(of), bool)
        if len(self.clip):
            known = first & (self.clip[at] == of) & (ms[head] <= self.ms[at] + TRACK_EXPIRY_MS)
        next_id, last_t = np.ones(len(of), int), np.full(len(of), np.nan)
        next_id[known], last_t[known] = self.next_id[at[known]], self.last_t[at[known]]
        unit = np.full(len(self.clip), -1)
        unit[at[known]] = np.flatnonzero(known)
        mine = unit[self.tracks["clip"]]
        state = {f: (mine if f == "clip" else v)[mine >= 0] for f, v in self.tracks.items()}
        out, state, next_id, last_t = track_rows(rows, self.rules, np.cumsum(head) - 1, state, next_id, last_t)
        self._keep(np.flatnonzero(~np.isin(self.clip, of)))
        n, ends = len(self.clip), np.flatnonzero(last)
        place = np.full(len(of), -1)
        place[ends] = n + np.arange(len(ends))
        mine = place[state["clip"]]
        self.tracks = {f: np.concatenate([v, (mine if f == "clip" else state[f])[mine >= 0]]) for f, v in self.tracks.items()}
        self.clip, self.ms = np.append(self.clip, of[ends]), np.append(self.ms, until[ends])
        self.next_id, self.last_t = np.append(self.next_id, next_id[ends]), np.append(self.last_t, last_t[ends])
        self._keep(np.argsort(self.clip, kind="stable"))
        return out

    def end(self, now: int) -> int | None:
        """Forget clips that are silent for too long; when the next one will be."""
        self._keep(np.flatnonzero(self.ms + TRACK_EXPIRY_MS >= now))
        return int(self.ms.min()) + TRACK_EXPIRY_MS + 1 if len(self.ms) else None


class _Tracker(StatefulProcessor):
    """The clip tracker for a group of clips, which it takes side by side. Boxes are held, by
    spans of time, until the watermark passes them. A clip's state goes ``TRACK_EXPIRY_MS``
    after its last frame, when no track is live any more."""

    SPAN_MS = 200  # a frame: spans are seldom due in part

    def __init__(self, rules: Tracking):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.types = handle, _box_types(self.rules)
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")
        self.state = handle.getValueState("clips", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, found = None, {}
        for pdf in rows:
            table = pa.Table.from_pandas(pdf[self.types.names], self.types, preserve_index=False)
            ms = table["ms"].to_numpy()
            first = int(ms.min()) if first is None else min(first, int(ms.min()))
            span = ms // self.SPAN_MS
            order = np.argsort(span, kind="stable")
            table, span = table.take(pa.array(order)), span[order]
            edges = np.append(np.flatnonzero(np.append(True, np.diff(span) > 0)), len(span))
            for low, high in zip(edges, edges[1:]):
                found.setdefault(int(span[low]), []).append(_packed(table.slice(low, high - low)))
        have = {k[0] for k in self.waiting.keys()}
        for span, parts in found.items():
            if span in have:
                parts = [bytes(self.waiting.getValue((span,))[0]), *parts]
            self.waiting.updateValue((span,), (b"".join(parts),))
        self._wake(first, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def _wake(self, ms: int, now: int) -> None:
        """Have a timer run out at ``ms`` or before; those up to ``now`` are spent."""
        if not any(now < t <= ms for t in self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, clips = timerValues.getCurrentWatermarkInMs(), _Clips(self.rules)
        kept, due, size, after = self.state.get(), [], 0, None
        if kept:
            clips.unpack(kept[0])
        for span in sorted(k[0] for k in self.waiting.keys()):
            if span * self.SPAN_MS > now:
                after = span * self.SPAN_MS if after is None else after
                break
            rows = pa.concat_tables(_unpacked(self.waiting.getValue((span,))[0]))
            ready = rows["ms"].to_numpy() <= now
            if ready.all():
                self.waiting.removeKey((span,))
            else:
                rest = rows.filter(pa.array(~ready))
                after = int(rest["ms"].to_numpy().min())
                rows = rows.filter(pa.array(ready))
                if len(rows):
                    self.waiting.updateValue((span,), (_packed(rest),))
            if len(rows):
                due.append(rows)
                size += len(rows)
            if size >= SIDE_BY_SIDE:
                yield clips.advance(pa.concat_tables(due)).to_pandas()
                due, size = [], 0
        if due:
            yield clips.advance(pa.concat_tables(due)).to_pandas()
        later = [t for t in (after, clips.end(now)) if t is not None]
        if len(clips.clip):
            self.state.update((clips.packed(),))
        elif kept:
            self.state.clear()
        if later:
            self._wake(min(later), now)

    def close(self) -> None:
        pass


def stream_tracks(dets: DataFrame, delay: str = "2 seconds", rules: Tracking = Tracking(), groups: int = 256) -> DataFrame:
    """Subject tracking as boxes arrive: a frame is tracked, whole, once the watermark passes
    its time, so rows may come in any order within ``delay`` and a frame may be split over
    batches; later rows are dropped. ``dets``: the columns of ``track_subjects`` and ts, the
    time of the frame. A clip silent for longer than 1.6 s starts anew. Needs RocksDB.

    Clips are dealt over ``groups`` by their hash, and those of a group are tracked side by
    side. State is kept by group, so a query has to be restarted with as many."""
    clip = F.coalesce("clip_id", F.lit(NO_CLIP)).alias("clip_id")
    group = F.pmod(F.xxhash64("clip_id"), F.lit(groups)).alias("clip_group")
    rows = dets.withWatermark("ts", delay).select("ts", F.unix_millis("ts").alias("ms"), group, *[clip if c == "clip_id" else c for c in _boxes(rules)])
    found = rows.groupBy("clip_group").transformWithStateInPandas(statefulProcessor=_Tracker(rules), outputStructType=TRACK_SCHEMA, outputMode="Append", timeMode="EventTime")
    return found.withColumn("clip_id", F.nullif("clip_id", F.lit(NO_CLIP)))
