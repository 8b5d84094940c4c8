"""Loudness, motion and activity series, and what candidates look like on them.

Series are one row per second (``bin``); a candidate is placed on a series by listing
its seconds and joining on (source, bin), which spreads any source evenly. Whatever is
collected per candidate is bounded by the candidate's length in seconds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipspark.functions.exprs import clamp, first_match, pin
from clipspark.operators.beside import Met, beside, lists, longs, spread
from clipspark.operators.blocks import DAY_MS, with_key_totals

# Thresholds and weights of the series formulas.
SILENCE = 0.01
SCENE_CUT = 0.35
PROFILE_PERCENTS = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
ACTIVITY_WEIGHTS = {"delta": 0.35, "energy": 0.25, "motion": 0.30, "cut": 0.10}
EXCITED_MARGIN, QUIET, SUDDEN = 0.12, 0.10, 0.25
BLOCK_BINS = 86_400
CAND = ["source_id", "seq"]


def _square_mean(xs: Column) -> Column:
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.sqrt(total / F.size(xs))


def _sub_windows(samples: Column, width: int) -> Column:
    """RMS of non-overlapping windows; a short row is one window, a remainder is dropped."""
    n = F.floor(F.size(samples) / width).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _square_mean(F.slice(samples, i * width + 1, width)))
    return F.when(n > 0, parts).otherwise(F.array(_square_mean(samples)))


def rms_windows(pcm: DataFrame, width: int) -> DataFrame:
    return pcm.where(F.size("samples") > 0).select(
        "source_id", "frame_idx", F.posexplode(_sub_windows(F.col("samples"), width)).alias("win", "rms")
    )


def exact_percentiles(df: DataFrame, key: str, value: str, ps: Sequence[float], width: float) -> DataFrame:
    """Linear-interpolated percentiles per key. Values are counted, counts are summed
    per value range, and only one row per range is ordered per key."""
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", F.floor(F.col(value) / width))
    per_bin = counted.groupBy(key, "_bin").agg(F.sum("_n").alias("_m"))
    ahead = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_bin.select(
        key, "_bin", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_base"),
        F.sum("_m").over(Window.partitionBy(key)).alias("_total"),
    )
    local = Window.partitionBy(key, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(bases, [key, "_bin"]).withColumn("_from", F.col("_base") + F.coalesce(F.sum("_n").over(local), F.lit(0)))

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("_from") <= pos) & (pos < F.col("_from") + F.col("_n")), F.col(value)))

    aggs = []
    for i, p in enumerate(ps):
        where = F.lit(p) * (F.col("_total") - 1)
        aggs += [at(F.floor(where)).alias(f"_lo{i}"), at(F.ceil(where)).alias(f"_hi{i}")]
    ends = placed.groupBy(key).agg(F.max("_total").alias("_total"), *aggs)

    def mix(i: int, p: float) -> Column:
        where = F.lit(p) * (F.col("_total") - 1)
        part = where - F.floor(where)
        return F.col(f"_lo{i}") * (1.0 - part) + F.col(f"_hi{i}") * part

    return ends.select(key, *[mix(i, p).alias(f"p{int(round(p * 100))}") for i, p in enumerate(ps)])


def audio_profile(rms: DataFrame) -> DataFrame:
    raw = exact_percentiles(rms, "source_id", "rms", PROFILE_PERCENTS, 1e-4)
    return raw.select("source_id", *[F.round(c, 6).alias(c) for c in raw.columns if c != "source_id"])


def energy_percentile(features: DataFrame, profile: DataFrame, value: str = "rms_mean") -> DataFrame:
    """Where a loudness lies in its source's distribution, between the profile's knots."""
    knots = [F.lit(0.0)] + [F.col(f"p{int(round(p * 100))}") for p in PROFILE_PERCENTS]
    top = F.greatest(knots[-1] * 1.5, F.lit(1.0))
    ys = [0.0, *PROFILE_PERCENTS, 1.0]
    pairs = F.sort_array(F.array(*[F.struct(x.alias("x"), F.lit(y).alias("y")) for x, y in zip([*knots, top], ys)]))
    v = F.col(value)
    rows = pin(features.join(profile, "source_id"), _k=pairs)
    at = F.size(F.filter("_k", lambda k: k["x"] <= v))
    lo, hi = F.get("_k", F.col("_i") - 1), F.get("_k", F.col("_i"))
    inside = lo["y"] + (v - lo["x"]) / (hi["x"] - lo["x"]) * (hi["y"] - lo["y"])
    return (
        pin(rows, _i=at)
        .withColumn(
            "energy_percentile",
            F.round(clamp(F.when(F.col("_i") >= len(ys), F.lit(1.0)).when(F.col("_i") < 1, F.lit(0.0)).otherwise(inside), 0.0, 1.0), 4),
        )
        .select(*features.columns, "energy_percentile")
    )


def _on_bins(cands: DataFrame, series: DataFrame, bin_col: str = "bin") -> DataFrame:
    """Series rows of each candidate, ``start_bin`` included and ``end_bin`` not."""
    seconds = cands.select(*CAND, "start_bin", "end_bin", F.explode(F.sequence(F.col("start_bin"), F.col("end_bin") - 1)).alias(bin_col))
    # Spark would broadcast the listed seconds by their packed size, a small part of what they take
    return seconds.hint("merge").join(series, ["source_id", bin_col])


def audio_features(cands: DataFrame, pcm: DataFrame, width: int) -> DataFrame:
    """Loudness statistics of each candidate, over its loudness windows in order."""
    wins = pcm.select(
        "source_id", F.col("frame_idx").alias("bin"), _sub_windows(F.col("samples"), width).alias("w"),
        F.aggregate("samples", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))).alias("pk"),
    )
    rows = _on_bins(cands, wins).groupBy(*CAND).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("bin", "w"))), lambda r: r["w"])).alias("w"), F.max("pk").alias("pk")
    )
    n = F.size("w")
    third = F.greatest(F.lit(1), F.floor(n / 3)).cast("int")

    def mean(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.lit(1), F.size(xs))

    rows = pin(rows, _m=mean(F.col("w")), _t=third)
    std = F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / n)
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.get("w", i) - F.get("w", i - 1)))
    quiet = F.round(F.size(F.filter("w", lambda x: x < SILENCE)) / n, 4)
    return rows.select(
        *CAND,
        F.round("_m", 6).alias("rms_mean"),
        F.round(std, 6).alias("rms_std"),
        F.round("pk", 4).alias("peak"),
        quiet.alias("silence_ratio"),
        F.round(1.0 - quiet, 4).alias("speech_coverage"),
        F.when(n > 1, F.round(mean(steps), 6)).otherwise(0.0).alias("energy_change_rate"),
        F.round(mean(F.slice("w", F.lit(1), F.col("_t"))), 6).alias("beginning_rms"),
        F.round(mean(F.slice("w", F.col("_t") + 1, F.col("_t"))), 6).alias("middle_rms"),
        F.round(mean(F.slice("w", F.col("_t") * 2 + 1, F.greatest(F.lit(0), n - F.col("_t") * 2))), 6).alias("ending_rms"),
    )


def _with_previous(df: DataFrame, key: str, idx: str, columns: dict[str, str]) -> DataFrame:
    """Values of the row before, by joining on the consecutive index (no ordering)."""
    before = df.select(key, (F.col(idx) + 1).alias(idx), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(before, [key, idx], "left")


def _scaled(df: DataFrame, value: Column, total: str) -> Column:
    base = F.when(F.col(total) > 1e-5, F.col(total)).otherwise(F.lit(1.0))
    return F.round(clamp(value / base, 0.0, 1.0), 4)


def audio_timeline(pcm: DataFrame, width: int) -> DataFrame:
    """Per second: energy relative to the source's loudest second, its change relative
    to the source's largest change, and the share of audible windows."""
    w = F.col("w")
    rows = pcm.select(
        "source_id", F.col("frame_idx").alias("bin"), _square_mean(F.col("samples")).alias("raw"),
        _sub_windows(F.col("samples"), width).alias("w"),
    ).select(
        "source_id", "bin", "raw",
        F.round(F.size(F.filter(w, lambda x: x >= SILENCE)) / F.size(w), 4).alias("speech"),
        F.floor(F.col("bin") / BLOCK_BINS).alias("block"),
    )
    loud = with_key_totals(rows, ["source_id"], "block", {"top": ("max", F.col("raw"))})
    energy = loud.select("source_id", "bin", "block", "speech", _scaled(loud, F.col("raw"), "top").alias("energy"))
    moved = _with_previous(energy, "source_id", "bin", {"energy": "before"}).withColumn(
        "step", F.coalesce(F.abs(F.col("energy") - F.col("before")), F.lit(0.0))
    )
    steps = with_key_totals(moved, ["source_id"], "block", {"top": ("max", F.col("step"))})
    return steps.select("source_id", "bin", "energy", _scaled(steps, F.col("step"), "top").alias("delta"), "speech")


def frame_motion(gray: DataFrame) -> DataFrame:
    """Mean absolute pixel change of each frame against the one before it."""
    pairs = _with_previous(gray, "source_id", "frame_idx", {"pixels": "before"})
    gap = F.aggregate(
        F.zip_with("pixels", "before", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x
    ) / F.size("pixels")
    return pairs.select("source_id", "frame_idx", F.when(F.col("before").isNotNull(), gap).alias("mad"))


def visual_timeline(gray: DataFrame) -> DataFrame:
    mad = F.coalesce("mad", F.lit(0.0))
    return frame_motion(gray).select(
        "source_id", F.col("frame_idx").alias("bin"), F.round(F.least(F.lit(1.0), mad), 4).alias("motion"), (mad >= SCENE_CUT).alias("scene_change")
    )


def combined_activity(delta: Column, energy: Column, motion: Column, cut: Column) -> Column:
    w = ACTIVITY_WEIGHTS
    flash = F.when(cut, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.round(clamp(delta * w["delta"] + energy * w["energy"] + motion * w["motion"] + flash * w["cut"], 0.0, 1.0), 4)


def activity_profile(audio: DataFrame, visual: DataFrame) -> DataFrame:
    """Both series side by side, zero where one is missing, and their weighted sum."""
    both = audio.join(visual, ["source_id", "bin"], "full_outer")
    rows = both.select(
        "source_id", "bin",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("energy", "delta", "speech", "motion")],
        F.coalesce("scene_change", F.lit(False)).alias("scene_change"),
    )
    return rows.withColumn(
        "combined", combined_activity(F.col("delta"), F.col("energy"), F.col("motion"), F.col("scene_change"))
    )


def visual_features(gray: DataFrame, detections: DataFrame) -> DataFrame:
    """Mean motion and cuts per source, and the share of frames showing somebody.

    ``detections``: source_id, frame_idx, type (face or person)."""
    motion = frame_motion(gray).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("decoded"),
        F.round(F.coalesce(F.avg("mad"), F.lit(0.0)), 4).alias("motion_score"),
        F.sum(F.coalesce(F.col("mad") >= SCENE_CUT, F.lit(False)).cast("long")).alias("scene_change_count"),
    )
    seen = detections.groupBy("source_id", "frame_idx").agg(
        F.max((F.col("type") == "face").cast("long")).alias("face"), F.max((F.col("type") == "person").cast("long")).alias("person")
    )
    shown = gray.select("source_id", "frame_idx").join(seen, ["source_id", "frame_idx"], "left_outer").groupBy("source_id").agg(
        F.sum(F.coalesce("face", F.lit(0))).alias("f"), F.sum(F.coalesce("person", F.lit(0))).alias("p")
    )
    return motion.join(shown, "source_id").select(
        "source_id", "decoded", "motion_score", "scene_change_count",
        F.round(F.col("f") / F.col("decoded"), 4).alias("face_presence_ratio"),
        F.round(F.col("p") / F.col("decoded"), 4).alias("person_presence_ratio"),
    )


def candidate_curve(cands: DataFrame, activity: DataFrame) -> DataFrame:
    """Each candidate's slice of the activity, as an array by offset; an empty slice is
    one neutral point in the middle."""
    point = F.struct(
        (F.col("bin") - F.col("start_bin")).cast("double").alias("offset"), "energy", "delta", "speech", "motion", "scene_change", "combined"
    )
    have = _on_bins(cands, activity).groupBy(*CAND).agg(F.sort_array(F.collect_list(point)).alias("curve"))
    neutral = F.array(
        F.struct(
            (F.col("duration") / 2.0).alias("offset"), F.lit(0.5).alias("energy"), F.lit(0.5).alias("delta"), F.lit(0.5).alias("speech"),
            F.lit(0.0).alias("motion"), F.lit(False).alias("scene_change"), F.lit(0.5).alias("combined"),
        )
    )
    return (
        cands.withColumn("duration", (F.col("end_bin") - F.col("start_bin")).cast("double"))
        .join(have, CAND, "left")
        .select(*CAND, "duration", F.coalesce("curve", neutral).alias("curve"))
    )


def _top_offsets(score) -> Column:
    ranked = F.sort_array(F.transform("curve", lambda p: F.struct((-score(p)).alias("k"), p["offset"].alias("o"))))
    return F.array_join(F.transform(F.slice(ranked, 1, 3), lambda r: r["o"].cast("string")), ",")


def curve_peaks(curves: DataFrame) -> DataFrame:
    return curves.select(
        *CAND,
        F.size("curve").cast("long").alias("points"),
        _top_offsets(lambda p: p["delta"] + p["energy"]).alias("top_audio"),
        _top_offsets(lambda p: p["motion"]).alias("top_motion"),
        _top_offsets(lambda p: p["combined"]).alias("top_combined"),
    )


def burst_peaks(curves: DataFrame) -> DataFrame:
    """Two separated peaks of each candidate with the reason each was chosen."""
    ranked = F.sort_array(
        F.transform("curve", lambda p: F.struct((-p["combined"]).alias("a"), (-p["delta"]).alias("b"), p["offset"].alias("o"), p.alias("p")))
    )
    rows = pin(curves, r=F.transform(ranked, lambda x: x["p"]))
    rows = pin(rows, p1=F.get("r", F.lit(0)))
    rest = F.slice(F.col("r"), F.lit(2), F.greatest(F.lit(0), F.size("r") - 1))

    def apart(gap: float) -> Column:
        return F.get(F.filter(rest, lambda p: F.abs(p["offset"] - F.col("p1.offset")) >= gap), F.lit(0))

    target = F.when(F.col("p1.offset") + 4.0 < F.col("duration"), F.col("p1.offset") + 4.0).otherwise(
        F.greatest(F.lit(0.5), F.col("p1.offset") - 4.0)
    )
    near = F.get(
        F.sort_array(F.transform("curve", lambda p: F.struct(F.abs(p["offset"] - target).alias("d"), p["offset"].alias("o"), p.alias("p")))), F.lit(0)
    )["p"]
    rows = pin(rows, p2=F.coalesce(apart(3.0), apart(2.0), near))
    both = F.sort_array(
        F.array(
            F.struct(F.col("p1.offset").alias("o"), F.lit(1).alias("activity_rank"), F.col("p1").alias("p")),
            F.struct(F.col("p2.offset").alias("o"), F.lit(2).alias("activity_rank"), F.col("p2").alias("p")),
        )
    )
    flat = rows.select(*CAND, "duration", F.posexplode(both).alias("i", "b"))
    p = F.col("b.p")
    reason = first_match(
        [
            (p["scene_change"], "scene_change_proximity"),
            ((p["delta"] >= 0.6) & (p["delta"] >= p["motion"]), "audio_delta_peak"),
            ((p["motion"] >= 0.5) & (p["motion"] >= p["delta"]), "visual_motion_peak"),
            (p["energy"] >= 0.7, "audio_energy_peak"),
        ],
        "combined_activity_peak",
    )
    return flat.select(
        *CAND, (F.col("i") + 1).cast("long").alias("burst"), F.col("b.o").alias("center"),
        F.greatest(F.lit(0.0), F.col("b.o") - 1.0).alias("start_offset"), F.least(F.col("duration"), F.col("b.o") + 1.0).alias("end_offset"),
        reason.alias("reason"), F.col("b.activity_rank").cast("long").alias("activity_rank"),
    )


def reaction_signals(cands: DataFrame, activity: DataFrame) -> DataFrame:
    """Excitement, laughter-like bursts, dead air and chains of sudden changes."""
    point = F.struct("bin", "energy", "delta", "speech", "combined")
    rows = cands.select(*CAND, "start_bin").join(
        _on_bins(cands, activity).groupBy(*CAND).agg(F.sort_array(F.collect_list(point)).alias("a")), CAND, "left"
    )
    n = F.coalesce(F.size("a"), F.lit(0))
    rows = pin(rows, n=F.when(F.col("a").isNull(), 0).otherwise(n))
    rows = pin(rows, m=F.aggregate("a", F.lit(0.0), lambda s, p: s + p["energy"]) / F.greatest(F.lit(1), F.col("n")))
    m, size = F.col("m"), F.greatest(F.lit(1), F.col("n"))
    ok = F.col("n") >= 2
    excited = F.size(F.filter("a", lambda p: p["energy"] >= m + EXCITED_MARGIN)) / size
    laughs = F.size(F.filter("a", lambda p: (p["delta"] >= SUDDEN) & (p["energy"] >= m) & (p["speech"] > 0)))
    pairs = F.zip_with(F.slice("a", 1, F.greatest(F.lit(0), F.col("n") - 1)), F.slice("a", 2, F.greatest(F.lit(0), F.col("n") - 1)),
                       lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    rise = F.aggregate(pairs, F.lit(0.0), lambda s, p: F.greatest(s, p["y"]["energy"] - p["x"]["energy"]))
    dead = F.size(F.filter("a", lambda p: (p["energy"] <= QUIET) & (p["speech"] <= 0.05))) / size
    answer = F.exists(
        pairs, lambda p: (p["x"]["energy"] <= QUIET) & (p["x"]["speech"] <= 0.05) & (p["y"]["energy"] >= m + EXCITED_MARGIN)
    )
    chain = F.aggregate(
        "a", F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, p: F.struct(
            F.when(p["delta"] >= SUDDEN, s["run"] + 1).otherwise(0).alias("run"),
            F.greatest(s["best"], F.when(p["delta"] >= SUDDEN, s["run"] + 1).otherwise(0)).alias("best"),
        ),
        lambda s: s["best"],
    )
    peaks = F.slice(F.sort_array(F.transform("a", lambda p: F.struct((-p["combined"]).alias("k"), p["bin"].alias("b")))), 1, 3)
    return rows.select(
        *CAND, ok.alias("available"),
        F.when(ok, F.round(F.least(F.lit(1.0), laughs / F.greatest(F.lit(1.0), F.col("n") / 4.0)), 3)).alias("laughter_like"),
        F.when(ok, F.round(clamp(rise, 0.0, 1.0), 3)).alias("sudden_increase"),
        F.when(ok, F.round(excited, 3)).alias("excited_ratio"),
        F.when(ok, answer).alias("pause_then_reaction"),
        F.when(ok, F.round(F.least(F.lit(1.0), chain / 4.0), 3)).alias("rapid_chain"),
        F.when(ok, F.round(dead, 3)).alias("dead_air_ratio"),
        F.when(ok, F.array_join(F.transform(peaks, lambda x: (x["b"] - F.col("start_bin")).cast("string")), ",")).alias("peak_offsets"),
    )


def rounded(x: np.ndarray) -> np.ndarray:
    """Spark's ``round(x, 4)`` of values from 0 on: half up on the shortest decimal form,
    which is a tie just where ``x`` is the number nearest to it."""
    k = np.floor(x * 10_000)
    return (k + (x >= (2 * k + 1) / 20_000)) / 10_000


def _spoken(met: Met) -> dict[str, pa.Array]:
    """A list per figure of the transcript's curve, by candidate; a second is an element."""
    begin, close = (longs(met.cands, c) for c in ("start_ms", "end_ms"))
    edges = np.concatenate([[0], np.cumsum(np.maximum(0, -((begin - close) // 1000)))])
    real = (longs(met.segs, "end_ms") > longs(met.segs, "start_ms"))[met.seg]
    of, seg = met.cand[real], met.seg[real]
    s, e, c0 = longs(met.segs, "start_ms")[seg], longs(met.segs, "end_ms")[seg], begin[of]
    a, b = np.maximum(s, c0) - c0, np.minimum(e, close[of]) - c0
    rate = longs(met.segs, "chars")[seg] / ((e - s) / 1000.0)
    piece, second = spread(a // 1000, (b - 1) // 1000 - a // 1000 + 1)
    ms = np.minimum(b[piece], (second + 1) * 1000) - np.maximum(a[piece], second * 1000)
    at, n = edges[of[piece]] + second, int(edges[-1])
    speech = np.minimum(1.0, np.bincount(at, ms, n) / 1000.0)
    chars = np.bincount(at, rate[piece] * ms / 1000.0, n)
    some = np.flatnonzero(np.diff(edges))
    top = np.repeat(np.maximum.reduceat(chars, edges[some]), np.diff(edges)[some]) if len(some) else chars
    energy = np.divide(chars, top, out=np.zeros(n), where=top > 1e-9)
    figures = {"speech": speech, "energy": energy, "combined": np.minimum(1.0, 0.65 * speech + 0.35 * energy)}
    return {name: lists(edges, pa.array(rounded(v))) for name, v in figures.items()}


SPOKEN_FIELDS = "speech array<double>, energy array<double>, combined array<double>"


def transcript_curves(cands: DataFrame, segments: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """``transcript_curve`` with a row per candidate: a list per figure, an element per second."""
    said = segments.select("source_id", "segment_id", "start_ms", "end_ms", F.length("text").alias("chars"))
    return beside(cands.select(*CAND, "start_ms", "end_ms"), said, ("start_ms", "end_ms"), SPOKEN_FIELDS, _spoken, block_ms).drop("start_ms", "end_ms")


def transcript_curve(cands: DataFrame, segments: DataFrame, block_ms: int = DAY_MS) -> DataFrame:
    """Share of each second somebody speaks and how fast, from segment times alone.

    ``cands``: source_id, seq, start_ms, end_ms."""
    rows = transcript_curves(cands, segments, block_ms).select(*CAND, F.posexplode(F.arrays_zip("speech", "energy", "combined")).alias("bin", "p"))
    return rows.select(*CAND, F.col("bin").cast("long").alias("bin"), "p.speech", "p.energy", "p.combined")


def pcm_curve(cands: DataFrame, pcm: DataFrame, width: int) -> DataFrame:
    """Loudness relative to the candidate's own peak, audible share, and their mix; a
    candidate with fewer than two seconds of sound has none."""
    w = F.col("w")
    per_bin = pcm.select(
        "source_id", F.col("frame_idx").alias("bin"), _square_mean(F.col("samples")).alias("raw"), _sub_windows(F.col("samples"), width).alias("w")
    ).select("source_id", "bin", "raw", (F.size(F.filter(w, lambda x: x >= SILENCE)) / F.size(w)).alias("speech"))
    whole = Window.partitionBy(*CAND)
    order = whole.orderBy("bin")
    rows = (
        _on_bins(cands, per_bin)
        .withColumn("peak", F.max("raw").over(whole))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .where(F.col("n") >= 2)
        .withColumn("energy", F.when(F.col("peak") > 0, F.try_divide("raw", "peak")).otherwise(F.lit(0.0)))
        .withColumn("step", F.coalesce(F.abs(F.col("energy") - F.lag("energy").over(order)), F.lit(0.0)))
    )
    mix = 0.55 * F.col("energy") + 0.30 * F.col("speech") + 0.15 * F.least(F.lit(1.0), F.col("step") * 4.0)
    return rows.select(
        *CAND, (F.col("bin") - F.col("start_bin")).alias("bin"), F.round("speech", 4).alias("speech"), F.round("energy", 4).alias("energy"),
        F.round(F.least(F.lit(1.0), mix), 4).alias("combined"),
    )


def by_second(combined: str) -> Column:
    """Points of a curve that has an element for each second."""
    return F.transform(combined, lambda v, i: F.struct(i.cast("long").alias("bin"), v.alias("combined")))


def settled(rows: DataFrame, ladder: Sequence[tuple[str, str]], duration: Column) -> DataFrame:
    """``rows`` with ``curve_source`` and the curve ``c`` (bin, combined, norm) in order of bin,
    without the ladder's columns, each a list of points (bin, combined) or null."""
    flat = F.transform(F.sequence(F.lit(0).cast("long"), duration - 1), lambda i: F.struct(i.alias("bin"), F.lit(0.5).alias("combined")))
    usable = [F.size(points) >= (2 if i < len(ladder) - 1 else 1) for i, (_, points) in enumerate(ladder)]
    name = first_match([(u, n) for u, (n, _) in zip(usable, ladder)], "flat")
    chosen = first_match([(u, F.col(points)) for u, (_, points) in zip(usable, ladder)], flat)
    kept = rows.columns
    rows = pin(rows, curve_source=name, _c=chosen)
    level = F.transform("_c", lambda p: p["combined"])
    rows = pin(rows, _lo=F.array_min(level), _span=F.array_max(level) - F.array_min(level))
    norm = lambda v: F.when(F.col("_span") < 1e-9, F.lit(0.5)).otherwise(F.round(F.try_divide(v - F.col("_lo"), F.col("_span")), 4))
    c = F.sort_array(F.transform("_c", lambda p: F.struct(p["bin"].alias("bin"), p["combined"].alias("combined"), norm(p["combined"]).alias("norm"))))
    return pin(rows, c=c).select(*[k for k in kept if k not in {points for _, points in ladder}], "curve_source", "c")


def signal_curves(cands: DataFrame, ladder: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``signal_curve`` with a row per candidate, the curve as ``settled`` gives it. A ladder
    entry may have a row per candidate too, with the lists of ``transcript_curves``."""
    rows, names = cands.select(*CAND, "duration"), []
    for i, (name, df) in enumerate(ladder):
        if "bin" in df.columns:
            point = F.struct(F.col("bin").cast("long").alias("bin"), "combined")
            rows = rows.join(df.groupBy(*CAND).agg(F.collect_list(point).alias(f"_p{i}")), CAND, "left")
        else:
            one = rows.join(df.select(*CAND, F.col("combined").alias(f"_l{i}")), CAND, "left")
            rows = one.withColumn(f"_p{i}", by_second(f"_l{i}")).drop(f"_l{i}")
        names.append((name, f"_p{i}"))
    return settled(rows, names, F.col("duration")).drop("duration")


def signal_curve(cands: DataFrame, ladder: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Per candidate the first curve of the ladder that it has (at least two points, or
    for the last rung any), else a flat one; normalised to [0, 1], flat being 0.5.

    Ladder entries: (name, rows of source_id, seq, bin, combined)."""
    return signal_curves(cands, ladder).select(*CAND, "curve_source", F.inline("c")).select(*CAND, "bin", "curve_source", "combined", "norm")


def curve_spans(rows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """``span_stats`` of rows that hold the curve beside the span: source_id, seq, span,
    start_offset, end_offset, ``c`` (list of bin, norm; or null)."""
    last = F.array_max(F.transform("c", lambda p: p["bin"]))
    lo = F.least(F.greatest(F.floor("start_offset"), F.lit(0)), last)
    rows = pin(rows, _lo=lo, _hi=F.least(F.greatest(F.ceil("end_offset") - 1, lo), last))
    rows = pin(rows, _s=F.filter("c", lambda p: (p["bin"] >= F.col("_lo")) & (p["bin"] <= F.col("_hi"))))
    norms = F.filter(F.transform("_s", lambda p: p["norm"]), lambda v: v.isNotNull())
    # the curve has four decimals: sum whole numbers, so the mean does not depend on order
    total = F.aggregate(norms, F.lit(0).cast("long"), lambda s, v: s + F.round(v * 10_000).cast("long"))
    low = F.size(F.filter(norms, lambda v: v < threshold))
    peak = F.array_max(F.transform("_s", lambda p: F.struct(p["norm"], (-p["bin"]).alias("b"))))
    return rows.select(
        *CAND, "span",
        F.round(F.when(F.size("_s") > 0, total / (10_000.0 * F.size("_s"))).otherwise(F.lit(0.5)), 6).alias("mean"),
        F.coalesce(F.array_max(norms), F.lit(0.5)).alias("peak"),
        F.round(F.when(F.size(norms) > 0, low / F.size(norms)).otherwise(F.lit(0.0)), 6).alias("low_ratio"),
        F.coalesce(-peak["b"], F.lit(0)).cast("long").alias("peak_bin"),
    )


def _as_lists(curve: DataFrame) -> DataFrame:
    return curve.groupBy(*CAND).agg(F.sort_array(F.collect_list(F.struct("bin", "norm"))).alias("c"))


def span_stats(curve: DataFrame, spans: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Mean, peak and share of low bins of each span of a curve (ends clipped to it)."""
    return curve_spans(spans.select(*CAND, "span", "start_offset", "end_offset").join(_as_lists(curve), CAND, "left"), threshold)


def payoff_block(curve: DataFrame, advisory: DataFrame, threshold: float = 0.35) -> DataFrame:
    """The unbroken stretch of strong bins around each curve's peak, reconciled with an
    advised span: their union where they meet, the advice where they do not.

    ``advisory``: source_id, seq, a0, a1 (null when there is none), duration."""
    rows = _as_lists(curve).join(advisory, CAND, "left")
    return payoff_ends(rows, threshold).select(*CAND, "s0", "s1", "start_offset", "end_offset")


def payoff_ends(rows: DataFrame, threshold: float) -> DataFrame:
    """``payoff_block`` of rows that hold the curve, ``c``, beside the advice, as new columns."""
    kept = rows.columns
    rows = pin(rows, top=F.array_max(F.transform("c", lambda p: p["norm"])))
    rows = pin(
        rows,
        cut=F.greatest(F.lit(threshold), 0.5 * F.col("top")),
        at=F.get(F.filter("c", lambda p: p["norm"] == F.col("top")), F.lit(0))["bin"],
    )
    weak = F.filter("c", lambda p: p["norm"] < F.col("cut"))
    before = F.array_max(F.transform(F.filter(weak, lambda p: p["bin"] < F.col("at")), lambda p: p["bin"]))
    after = F.array_min(F.transform(F.filter(weak, lambda p: p["bin"] > F.col("at")), lambda p: p["bin"]))
    ends = pin(
        rows,
        s0=F.coalesce(before + 1, F.get("c", F.lit(0))["bin"]).cast("double"),
        s1=F.coalesce(after, F.element_at("c", -1)["bin"] + 1).cast("double"),
    )
    none = F.col("a0").isNull() | F.col("a1").isNull()
    meets = (F.least("s1", "a1") > F.greatest("s0", "a0")) & (F.col("s1") > F.col("s0"))
    start = F.when(none, F.col("s0")).when(meets, F.greatest(F.lit(0.0), F.least("s0", "a0"))).otherwise(F.greatest(F.lit(0.0), F.col("a0")))
    end = F.when(none, F.col("s1")).when(meets, F.least("duration", F.greatest("s1", "a1"))).otherwise(F.least("duration", F.col("a1")))
    return ends.select(*kept, "s0", "s1", start.alias("start_offset"), end.alias("end_offset"))


def interpret_regions(regions: DataFrame, tolerance: float = 0.5, strict: bool = True) -> DataFrame:
    """Decide whether an advised region speaks in candidate offsets or source times.

    ``regions``: keys, r0, r1 (text or null), supplied flag, start_s, end_s."""
    a, b = F.col("r0").try_cast("double"), F.col("r1").try_cast("double")
    rows = regions.withColumn("_a", a).withColumn("_b", b).withColumn("_d", F.col("end_s") - F.col("start_s"))
    a, b, d, s, e, t = F.col("_a"), F.col("_b"), F.col("_d"), F.col("start_s"), F.col("end_s"), F.lit(tolerance)
    as_offset = a.between(-t, d + t) & b.between(-t, d + t)
    as_time = a.between(s - t, e + t) & b.between(s - t, e + t)
    kind = first_match(
        [
            (~F.col("supplied"), "missing"),
            (a.isNull() | b.isNull() | (b <= a), "malformed"),
            (as_offset & as_time & (s > t) & F.lit(strict), "ambiguous"),
            (as_offset, "offset"),
            (as_time, "absolute_converted"),
        ],
        "out_of_range",
    )
    rows = rows.withColumn("interpretation", kind)
    o = F.col("interpretation") == "offset"
    c = F.col("interpretation") == "absolute_converted"

    def region(x: Column) -> Column:
        return F.round(
            F.when(o, F.least(F.greatest(x, F.lit(0.0)), d)).when(c, F.least(F.greatest(x - s, F.lit(0.0)), d)), 3
        )

    return rows.withColumn("region_start", region(a)).withColumn("region_end", region(b)).withColumn("accepted", o | c).drop("_a", "_b", "_d")


def frame_plan(cands: DataFrame, limit: int = 12) -> DataFrame:
    """Offsets (ms) to sample: four across the clip, four around each of two bursts,
    none within 100 ms of an earlier choice.

    ``cands``: source_id, seq, duration_ms, burst_1_ms, burst_2_ms."""
    d = F.greatest(F.lit(500), F.col("duration_ms"))
    wanted = [(F.floor(d * f / 100), "global") for f in (10, 35, 65, 90)]
    for i in (1, 2):
        wanted += [(F.col(f"burst_{i}_ms") + off, f"burst_{i}") for off in (-750, -250, 250, 750)]
    held = [
        F.struct(F.least(F.greatest(x, F.lit(50)), F.greatest(F.lit(50), d - 50)).cast("long").alias("ms"), F.lit(kind).alias("kind"))
        for x, kind in wanted
    ]
    picked = F.aggregate(
        F.array(*held),
        F.expr("cast(array() as array<struct<ms:bigint,kind:string>>)"),
        lambda acc, x: F.when(
            (F.size(acc) < limit) & ~F.exists(acc, lambda y: F.abs(y["ms"] - x["ms"]) < 100), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    return cands.select(*CAND, F.posexplode(F.sort_array(picked)).alias("i", "f")).select(
        *CAND, F.col("i").cast("long").alias("sample"), F.col("f.ms").alias("offset_ms"), F.col("f.kind").alias("kind")
    )


# Where a clip is sampled when nothing else is known, in thousandths.
EVEN_PLACES = (50, 180, 310, 440, 560, 690, 820, 950)


def frame_plan_scenes(cands: DataFrame, limit: int = 12) -> DataFrame:
    """Offsets (ms) to sample: eight across the clip, then scene cuts at least half a
    second from every offset chosen before them.

    ``cands``: source_id, seq, duration_ms, cuts_ms (array, in the order to try)."""
    d = F.greatest(F.lit(500), F.col("duration_ms"))
    chosen = lambda ms, kind: F.struct(ms.cast("long").alias("ms"), F.lit(kind).alias("kind"))
    even = F.array(*[chosen(F.round(d * f / 1000), "uniform") for f in EVEN_PLACES])
    picked = F.aggregate(
        F.coalesce("cuts_ms", F.array().cast("array<bigint>")), even,
        lambda acc, x: F.when((F.size(acc) < limit) & F.forall(acc, lambda y: F.abs(y["ms"] - x) >= 500), F.concat(acc, F.array(chosen(x, "scene_change")))).otherwise(acc),
    )
    return cands.select(*CAND, F.posexplode(F.sort_array(picked)).alias("i", "f")).select(
        *CAND, F.col("i").cast("long").alias("sample"), F.col("f.ms").alias("offset_ms"), F.col("f.kind").alias("kind")
    )
