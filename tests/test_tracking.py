"""The tracker: looks, scene cuts, and random clips against one written plainly."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from catalog import streams
from clipspark.operators import framing
from clipspark.operators.framing import Tracking
from clipspark.sources import derived
from clipspark.streaming import pipelines as st
from clipspark.streaming.replay import replay
from tests.conftest import rows

SCHEMA = "clip_id long, frame long, t_ms long, subject long, x long, y long, w long, h long, type string, scene_cut boolean, appearance array<double>"
SIZE = 8
A, B = [0.0, 1.0] * 4, [0.0, 0.0, 1.0, 1.0] * 2  # uncorrelated


def clear(patch, w, h):
    if patch is None or len(patch) != SIZE or None in patch or min(w, h) < 6:
        return None
    m, d = statistics.fmean(patch), statistics.pstdev(patch)
    return None if d < 1e-3 else [(v - m) / d for v in patch]


def plain(clip, rules):
    """{(frame, subject): (track, hits)} of one clip, a pair at a time."""
    out, tracks, fresh, before = {}, [], 1, None
    for t_ms, frame in sorted({(r["t_ms"], r["frame"]) for r in clip}):
        here = sorted((r for r in clip if (r["t_ms"], r["frame"]) == (t_ms, frame)), key=lambda r: r["subject"] or 0)
        t = t_ms / 1000
        dt = 0.2 if before is None else max(1e-3, t - before)
        cut, before = any(r["scene_cut"] for r in here) and rules.cut_resets, t
        boxes = [r for r in here if r["w"] is not None]
        face = [clear(r["appearance"], r["w"], r["h"]) if rules.look_size else None for r in boxes]
        pairs = []
        for k, tr in enumerate(tracks):
            for j, r in enumerate(boxes):
                gap = t - tr["seen"]
                ahead = gap if tr["hits"] >= 2 else 0
                to = [tr[c] + tr[s] / 2 + max(-600, min(600, tr[v])) * ahead for c, s, v in (("x", "w", "vx"), ("y", "h", "vy"))]
                far = math.hypot(to[0] - r["x"] - r["w"] / 2, to[1] - r["y"] - r["h"] / 2)
                side = [max(0, min(tr[c] + tr[s], r[c] + r[s]) - max(tr[c], r[c])) for c, s in ("xw", "yh")]
                both = side[0] * side[1]
                union = tr["w"] * tr["h"] + r["w"] * r["h"] - both
                iou = both / union if union > 0 else 0
                reach = min(520, max(0.6 * max(tr["w"], r["w"], 1), 0 if cut else 600 * max(dt, gap), 28))
                if max(tr["w"], r["w"]) / max(1, min(tr["w"], r["w"])) > 3 or (iou < 0.15 and far > reach):
                    continue
                price = 0.5 * (1 - iou) + 0.5 * min(1, far / max(reach, 1))
                if tr["face"] is not None and face[j] is not None:
                    like = max(-1, min(1, sum(a * b for a, b in zip(tr["face"], face[j])) / SIZE))
                    if gap > 1.5 * dt and iou < 0.15 and like < 0.15:
                        continue
                    price = 0.75 * price + 0.25 * (1 - (like + 1) / 2)
                price += 0.25 * (tr["type"] != r["type"]) + 0.02 * min(1, gap / 1.6)
                pairs.append((tr["hits"] < 3, price, k, j))
        met = {}
        for _, _, k, j in sorted(pairs):
            if k not in met.values() and j not in met:
                met[j] = k
        lost = [tr for k, tr in enumerate(tracks) if k not in met.values()]
        for j, r in enumerate(boxes):
            if j in met:
                tr = tracks[met[j]]
                since = t - tr["seen"]
                if since > 1e-3:
                    for v, c, s in (("vx", "x", "w"), ("vy", "y", "h")):
                        tr[v] = 0.5 * tr[v] + 0.5 * (r[c] + r[s] / 2 - tr[c] - tr[s] / 2) / since
                if face[j] is not None:
                    tr["face"] = face[j] if tr["face"] is None else [0.7 * a + 0.3 * b for a, b in zip(tr["face"], face[j])]
                tr["hits"] += 1
            else:
                tr = {"id": fresh, "hits": 1, "vx": 0.0, "vy": 0.0, "face": face[j]}
                tracks.append(tr)
                fresh += 1
            tr |= {c: r[c] for c in ("x", "y", "w", "h", "type")} | {"seen": t}
            out[frame, r["subject"]] = (tr["id"], tr["hits"])
        tracks = [tr for tr in tracks if t - tr["seen"] <= 1.6 and not (cut and any(tr is x for x in lost))]
    return out


def clip_rows(seed):
    """A clip of wandering, vanishing, tiny, flat and odd boxes."""
    rnd = random.Random(seed)
    at = [[rnd.randrange(900), rnd.randrange(400)] for _ in range(4)]
    faces = [[rnd.random() for _ in range(SIZE)] for _ in range(3)]
    found = []
    for frame in range(40):
        cut, some = rnd.random() < 0.08, False
        for s in range(4):
            at[s] = [max(0, at[s][0] + rnd.randrange(-60, 61)), max(0, at[s][1] + rnd.randrange(-30, 31))]
            if rnd.random() < 0.35:
                continue
            some, size = True, rnd.choice([5, 40, 60, 90])
            patch = rnd.choice([None, [1.0] * SIZE, [1.0, None] * 4, [0.5] * 3] + [[v + 0.1 * rnd.random() for v in faces[s % 3]]] * 8)
            found.append((seed, frame, frame * 200, s, *at[s], size, size, rnd.choice(["face", "face", "person"]), cut, patch))
        if not some:
            found.append((seed, frame, frame * 200, None, None, None, None, None, None, cut, None))
    return found


@pytest.mark.parametrize("rules", [Tracking(), Tracking(look_size=SIZE), Tracking(look_size=SIZE, cut_resets=False)])
def test_random_clips_against_a_plain_tracker(spark, rules):
    every = [clip_rows(seed) for seed in range(12)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    d = spark.createDataFrame([r for clip in every for r in clip], SCHEMA)
    got = {(r.clip_id, r.frame, r.x, r.y, r.w): (r.track_id, r.hits) for r in framing.track_subjects(d, rules).collect()}
    want = {}
    for clip in every:
        dicts = [dict(zip(names, r)) for r in clip]
        box = {(r["frame"], r["subject"]): (r["clip_id"], r["frame"], r["x"], r["y"], r["w"]) for r in dicts}
        want |= {box[k]: v for k, v in plain(dicts, rules).items()}
    assert got == want and len(want) > 1_000


def _two_faces(spark, later, gap=(10, 14), shift=100, cut=None):
    """A face, a silence of frames, then a face ``shift`` pixels further with the look ``later``."""
    first = [(1, i, i * 200, 1, 300, 260, 90, 90, "face", False, A) for i in range(gap[0])]
    empty = [(1, i, i * 200, None, None, None, None, None, None, i == cut, None) for i in range(*gap)]
    then = [(1, i, i * 200, 1, 300 + shift, 260, 90, 90, "face", False, later) for i in range(gap[1], gap[1] + 10)]
    return spark.createDataFrame(first + empty + then, SCHEMA)


@pytest.mark.parametrize("later, n", [(A, 1), (B, 2), (None, 1), ([1.0] * SIZE, 1), ([3.0], 1)])
def test_another_look_after_a_gap_is_another_subject(spark, later, n):
    tracked = framing.track_subjects(_two_faces(spark, later), Tracking(look_size=SIZE))
    assert tracked.select("track_id").distinct().count() == n
    assert framing.track_subjects(_two_faces(spark, later)).select("track_id").distinct().count() == 1


def test_another_look_without_a_gap_goes_on(spark):
    tracked = framing.track_subjects(_two_faces(spark, B, gap=(10, 10), shift=4), Tracking(look_size=SIZE))
    assert tracked.select("track_id").distinct().count() == 1


@pytest.mark.parametrize("resets, n", [(True, 2), (False, 1)])
def test_a_cut_ends_the_wait_unless_told_otherwise(spark, resets, n):
    d = _two_faces(spark, A, shift=0, cut=12)
    assert framing.track_subjects(d, Tracking(cut_resets=resets)).select("track_id").distinct().count() == n


def test_an_empty_table_has_no_tracks(spark):
    assert framing.track_subjects(spark.createDataFrame([], SCHEMA), Tracking(look_size=SIZE)).count() == 0


def test_streamed_looks_equal_the_batch_ones(spark, sf_dir):
    rules = Tracking(look_size=derived.LOOK_SIZE)
    d = derived.looks(spark, sf_dir).where(F.col("clip_id") < 3_000_000)
    run = replay(spark, streams.split_frames(d), lambda s: st.stream_tracks(s["in"], rules=rules))
    assert rows(run.table.drop("batch").where("clip_id >= 0")) == rows(framing.track_subjects(d, rules))
