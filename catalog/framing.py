"""Queries on boxes, tracks and crop paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.operators import framing as fr
from clipspark.sources import derived

DET = """fr0 as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events),
 frames as (select user_id * 1000000 + n // 225 as clip_id, n % 225 as frame, n % 225 * 200 as t_ms, event_type, event_type = 'error' and n % 225 % 10 = 9 as scene_cut from fr0),
 dets as (select clip_id, frame, t_ms, scene_cut, 1 as subject, 200 + frame * 8 % 400 as x, 260 as y, 90 as w, 90 as h, 'face' as type from frames where frame % 7 not in (5, 6)
   union all select clip_id, frame, t_ms, scene_cut, 2, 900, 300, 80, 80, 'face' from frames where event_type in ('view', 'click')
   union all select clip_id, frame, t_ms, scene_cut, 3, 520, 200, 150, 150, 'person' from frames where event_type = 'purchase')
"""
IOU = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _dets(spark, sf_dir):
    return derived.detections(spark, sf_dir).where(F.col("subject").isNotNull())


def _frames(spark, sf_dir):
    return derived.detections(spark, sf_dir).select("clip_id", "frame", "t_ms", "scene_cut").distinct()


@register(
    "v1_box_overlap",
    f"""with {DET}, near_pairs as (select a.clip_id, a.frame, 0 as step, a.subject as sa, b.subject as sb, a.x as ax, a.y as ay, a.w as aw, a.h as ah, b.x as bx, b.y as by_, b.w as bw, b.h as bh
       from dets a join dets b on a.clip_id = b.clip_id and a.frame = b.frame where a.subject < b.subject
       union all select a.clip_id, a.frame, 1, a.subject, b.subject, a.x, a.y, a.w, a.h, b.x, b.y, b.w, b.h from dets a join (select *, frame - 1 as before from dets) b on a.clip_id = b.clip_id and a.frame = b.before),
     met as (select *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) as i from near_pairs)
     select clip_id, frame, cast(step as bigint) as step, cast(sa as bigint) as a, cast(sb as bigint) as b, rnd6(i * 1.0e0 / (aw * ah + bw * bh - i)) as iou from met""",
)
def v1(spark, sf_dir):
    return fr.box_overlap(_dets(spark, sf_dir))


@register("v2_track_subjects")
def v2(spark, sf_dir):
    return fr.track_subjects(derived.detections(spark, sf_dir))


@register("v2_track_looks")
def v2_looks(spark, sf_dir):
    return fr.track_subjects(derived.looks(spark, sf_dir), fr.Tracking(look_size=derived.LOOK_SIZE))


@register("v2_track_through_cuts")
def v2_through_cuts(spark, sf_dir):
    return fr.track_subjects(derived.detections(spark, sf_dir), fr.Tracking(cut_resets=False))


OBS = DET + """, obs as (select clip_id, t_ms, subject as track_id, x, y, w, h, type, (frame % 10) / 10.0e0 as speaking, 0.5e0 + (frame % 5) / 10.0e0 as conf, row_number() over (partition by clip_id, subject order by t_ms) as hits from dets),
 cl as (select clip_id, count(*) as n, (max(t_ms) - min(t_ms)) / greatest(1, count(*) - 1) as step from frames group by 1),
 rw as (select o.*, n, step, coalesce(t_ms - lag(t_ms) over (partition by clip_id, track_id order by t_ms) > 600 + step, false) as f from obs o join cl using (clip_id)),
 ru as (select *, sum(cast(f as int)) over (partition by clip_id, track_id order by t_ms) as run from rw),
 lg as (select clip_id, track_id, max(len) as longest_ms from (select clip_id, track_id, run, max(t_ms) - min(t_ms) + any_value(step) as len from ru group by 1, 2, 3) group by 1, 2),
 st as (select clip_id, track_id, any_value(type) as type, min(t_ms) as first_ms, max(t_ms) as last_ms, count(*) as frames_seen, max(hits) as hits, any_value(n) as n, any_value(step) as step,
   cast(round_even(avg(x), 0) as bigint) as mean_x, cast(round_even(avg(y), 0) as bigint) as mean_y, cast(round_even(avg(w), 0) as bigint) as mean_w, cast(round_even(avg(h), 0) as bigint) as mean_h,
   rnd2(avg(x + w / 2.0e0)) as mean_center_x, rnd2(avg(y + h / 2.0e0)) as mean_center_y, rnd2(var_pop(x + w / 2.0e0)) as position_variance, rnd4(avg(conf)) as mean_confidence, rnd4(avg(speaking)) as mean_speaking from rw group by 1, 2),
 s2 as (select *, rnd3(case when step > 0 then frames_seen * step else frames_seen * 1000.0e0 end) as visible_ms, rnd4(frames_seen / n) as visibility_ratio, mean_w * mean_h as mean_area,
   case when step > 0 then rnd4(frames_seen / greatest(1.0e0, (last_ms - first_ms) / step + 1)) else 1.0e0 end as continuity from st join lg using (clip_id, track_id)),
 s3 as (select *, hits >= 4 and (longest_ms >= 2000 or (visible_ms >= 1000 and visibility_ratio >= 0.20e0)) as persistent from s2)
"""


def _obs(spark, sf_dir):
    d = _dets(spark, sf_dir)
    from pyspark.sql import Window

    hits = F.row_number().over(Window.partitionBy("clip_id", "subject").orderBy("t_ms")).cast("long")
    return d.select(
        "clip_id", "t_ms", F.col("subject").alias("track_id"), "x", "y", "w", "h", "type",
        ((F.col("frame") % 10) / 10.0).alias("speaking"), (0.5 + (F.col("frame") % 5) / 10.0).alias("conf"), hits.alias("hits"),
    )


@register(
    "v3_track_summary",
    f"""with {OBS} select clip_id, cast(track_id as bigint) as track_id, type, first_ms, last_ms, frames_seen, visible_ms, visibility_ratio, mean_x, mean_y, mean_w, mean_h, mean_area, mean_center_x, mean_center_y, position_variance,
      mean_confidence, mean_speaking, continuity, rnd3(longest_ms) as longest_ms, persistent, case when not persistent then 'too brief to be a subject' when longest_ms >= 2000 then 'continuously present' else 'present for much of the clip' end as reason,
      persistent and mean_area / 921600.0e0 >= 0.0012e0 as significant, rnd6(0.45e0 * visibility_ratio + 0.25e0 * least(1.0e0, mean_area / 40000.0e0) + 0.20e0 * mean_speaking + 0.10e0 * continuity) as importance from s3""",
)
def v3(spark, sf_dir):
    return fr.track_summary(_obs(spark, sf_dir), _frames(spark, sf_dir))


@register(
    "v4_fragmentation",
    f"""with {DET}, o as (select clip_id, t_ms, case when subject = 1 then frame // 6 else subject * 1000 end as track_id from dets),
     t as (select clip_id, track_id, count(*) >= 3 as kept, max(t_ms) - min(t_ms) + 200 as life, count(*) as n from o group by 1, 2),
     g as (select clip_id, coalesce(list(life order by life) filter (where kept), []) as l, count(*) as raw, cast(sum(n) as bigint) as detections from t group by 1),
     s as (select clip_id, len(l) as identities, raw, detections, case when len(l) > 0 then rnd2(detections / len(l)) else 0.0e0 end as detections_per_identity,
       case when len(l) > 0 then rnd3(cast(list_sum(l) as bigint) / 1000.0e0 / len(l)) else 0.0e0 end as mean_life_s, coalesce(l[len(l) // 2 + 1] / 1000.0e0, 0.0e0) as median_life_s, coalesce(l[len(l)] / 1000.0e0, 0.0e0) as longest_life_s,
       len(list_filter(l, lambda x: x < 500)) as under_half_s, len(list_filter(l, lambda x: x < 1000)) as under_one_s, case when len(l) > 0 then rnd3(raw / len(l)) else cast(raw as double) end as fragmentation_ratio from g)
     select *, case when detections >= 10 and identities = 0 then 'no stable identity' when identities > 0 and median_life_s < 1 and raw >= 4 * identities then 'identity is fragmenting' end as warning from s""",
)
def v4(spark, sf_dir):
    from pyspark.sql import Window

    d = _dets(spark, sf_dir)
    track = F.when(F.col("subject") == 1, F.floor(F.col("frame") / 6)).otherwise(F.col("subject") * 1000)
    o = d.select("clip_id", "t_ms", track.alias("track_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("clip_id", "track_id"))
    return fr.fragmentation(o.withColumn("confirmed", n >= 3))


PATH = DET + """, q as (select clip_id, t_ms, (frame * 37) % 900 + 100.0e0 as x, 360.0e0 + frame % 3 as y, scene_cut, row_number() over (partition by clip_id order by t_ms) as i from frames)"""
AXIS = """case when q.scene_cut then {g} else s.c{a} + (s.v{a} + greatest(-420.0e0 * {dt}, least(420.0e0 * {dt}, greatest(-160.0e0, least(160.0e0, (case when abs({g} - s.c{a}) <= 25.6e0 then 0.0e0 when {g} - s.c{a} > 0 then {g} - s.c{a} - 25.6e0 else {g} - s.c{a} + 25.6e0 end) * 0.22e0 / {dt})) - s.v{a}))) * {dt} end"""
SPEED = """case when q.scene_cut then 0.0e0 else s.v{a} + greatest(-420.0e0 * {dt}, least(420.0e0 * {dt}, greatest(-160.0e0, least(160.0e0, (case when abs({g} - s.c{a}) <= 25.6e0 then 0.0e0 when {g} - s.c{a} > 0 then {g} - s.c{a} - 25.6e0 else {g} - s.c{a} + 25.6e0 end) * 0.22e0 / {dt})) - s.v{a})) end"""
DT = "greatest(0.001e0, (q.t_ms - s.t_ms) / 1000.0e0)"


def _ax(template: str, a: str) -> str:
    return template.format(a=a, g=f"q.{a}", dt=DT)


SMOOTH = "with recursive " + PATH + f""", mv as (select clip_id, i, t_ms, x as cx, y as cy, 0.0e0 as vx, 0.0e0 as vy from q where i = 1
   union all select q.clip_id, q.i, q.t_ms, {_ax(AXIS, 'x')}, {_ax(AXIS, 'y')}, {_ax(SPEED, 'x')}, {_ax(SPEED, 'y')} from mv s join q on q.clip_id = s.clip_id and q.i = s.i + 1),
 ev as (select *, cast(floor(least(greatest(round_even(cx - 202, 0), 0), 876) / 2) * 2 as bigint) as ex, cast(0 as bigint) as ey from mv),
 px as (select clip_id, i, t_ms, cx, cy, ex as crop_x, ey as crop_y from ev where i = 1 union all
   select e.clip_id, e.i, e.t_ms, e.cx, e.cy, case when abs(e.ex - p.crop_x) < 2 then p.crop_x else e.ex end, 0 from px p join ev e on e.clip_id = p.clip_id and e.i = p.i + 1)
"""


@register("v7_smooth_crop", SMOOTH + "select clip_id, t_ms, rnd2(cx) as center_x, rnd2(cy) as center_y, crop_x, crop_y from px")
def v7(spark, sf_dir):
    n = F.col("frame")
    targets = _frames(spark, sf_dir).select("clip_id", "t_ms", (n * 37 % 900 + 100.0).alias("x"), (360.0 + n % 3).alias("y"), "scene_cut")
    return fr.smooth_crop(targets)


RAW = DET + """, raw as (select clip_id, frame as seq, case when frame % 11 = 5 then 'nan'::double else case when frame % 13 = 6 then (frame - 3) / 5.0e0 else frame / 5.0e0 end end as t_s,
   case when frame % 17 = 3 then 'inf'::double else cast((frame * 53) % 1100 - 50 as double) end as cx, cast(frame % 2 as double) as cy from frames),
 ok as (select *, row_number() over (partition by clip_id order by seq) as i, cast(cx as bigint) as x, cast(cy as bigint) as y from raw where not isnan(t_s) and not isinf(cx)),
 tm as (select clip_id, i, t_s as t, t_s <= -1 as fixed from ok where i = 1 union all
   select o.clip_id, o.i, case when o.t_s <= t.t then t.t + 0.001e0 else o.t_s end, o.t_s <= t.t from tm t join ok o on o.clip_id = t.clip_id and o.i = t.i + 1),
 cl as (select o.*, t, fixed, least(greatest(x, 0), 876) as kx, 0 as ky from ok o join tm using (clip_id, i)),
 pts as (select *, kx // 2 * 2 as crop_x, cast(0 as bigint) as crop_y from cl)
"""


def _raw(spark, sf_dir):
    n = F.col("frame")
    t = F.when(n % 11 == 5, F.lit(float("nan"))).when(n % 13 == 6, (n - 3) / 5.0).otherwise(n / 5.0)
    x = F.when(n % 17 == 3, F.lit(float("inf"))).otherwise((n * 53 % 1100 - 50).cast("double"))
    pts = _frames(spark, sf_dir).select("clip_id", n.alias("seq"), t.alias("t_s"), x.alias("crop_x"), (n % 2).cast("double").alias("crop_y"))
    return fr.sanitize_trajectory(pts, 404, 720, 1280, 720)


def _typed(sql: str) -> str:
    return sql.replace("'nan'::double", "cast('nan' as double)").replace("'inf'::double", "cast('inf' as double)")


@register("v8_sanitize_trajectory", _typed(f"with recursive {RAW} select clip_id, seq, rnd4(t) as t_s, crop_x, crop_y from pts"))
def v8(spark, sf_dir):
    return _raw(spark, sf_dir)[0]


@register(
    "v8_trajectory_report",
    _typed(f"""with recursive {RAW}, g as (select clip_id, count(*) as points_out, count(*) filter (where fixed) as times_fixed, count(*) filter (where kx <> x or ky <> y) as clamped, count(*) filter (where crop_x <> kx or crop_y <> ky) as evened,
       min(crop_x) as min_x, max(crop_x) as max_x from pts group by 1), h as (select clip_id, count(*) as points_in, count(*) filter (where isnan(t_s) or isinf(cx)) as dropped from raw group by 1)
     select h.*, points_out, times_fixed, clamped, evened, min_x, max_x, points_out is not null as valid from h left join g using (clip_id)"""),
)
def v8_report(spark, sf_dir):
    return _raw(spark, sf_dir)[1]


@register(
    "v10_trajectory_stats",
    f"""with {DET}, p as (select clip_id, t_ms, (frame * frame) % 300 // 2 * 2 as crop_x, frame % 4 as crop_y, scene_cut from frames),
     d as (select *, abs(crop_x - lag(crop_x) over w) as dx, greatest(0.001e0, (t_ms - lag(t_ms) over w) / 1000.0e0) as dt from p window w as (partition by clip_id order by t_ms))
     select clip_id, rnd3(coalesce(avg(dx / dt), 0)) as mean_velocity, rnd3(coalesce(max(dx / dt), 0)) as max_velocity, rnd3(coalesce(max(dx / dt) filter (where not scene_cut), 0)) as peak_velocity_between_cuts,
       count(*) filter (where dx is not null and scene_cut) as cut_jumps, cast(coalesce(sum(dx), 0) as bigint) as travel_px, rnd4(count(*) filter (where dx = 0) / greatest(1, count(*) - 1)) as stationary_ratio,
       min(crop_x) as crop_x_min, max(crop_x) as crop_x_max, max(crop_x) - min(crop_x) as crop_x_range, min(crop_y) as crop_y_min, max(crop_y) as crop_y_max from d group by 1""",
)
def v10(spark, sf_dir):
    n = F.col("frame")
    p = _frames(spark, sf_dir).select(
        "clip_id", "t_ms", (F.floor(n * n % 300 / 2) * 2).alias("crop_x"), (n % 4).alias("crop_y"), "scene_cut"
    )
    return fr.trajectory_stats(p)


TARGET = DET + """, w as (select *, x + w / 2.0e0 as cx, y + h / 2.0e0 as cy, w * h * greatest(0.5e0, 1.0e0 - 0.4e0 * (abs(x + w / 2.0e0 - 640) / 640)) as k from dets),
 g as (select clip_id, frame, count(*) filter (where type = 'face') as nf, arg_max(cx, {'k': k, 's': -subject}) filter (where type = 'face') as fx, arg_max(cy, {'k': k, 's': -subject}) filter (where type = 'face') as fy,
   arg_max(cx, {'k': k, 's': -subject}) as ax, arg_max(cy, {'k': k, 's': -subject}) as ay, arg_max(type, {'k': k, 's': -subject}) as aty, max(cx) filter (where type = 'face') - min(cx) filter (where type = 'face') + max(w) filter (where type = 'face') as span,
   avg(cx) filter (where type = 'face') as mx, avg(cy) filter (where type = 'face') as my from w group by 1, 2),
 tg as (select f.clip_id, f.frame, case when ax is null then 640.0e0 when nf = 2 and span <= 343.4e0 then mx else coalesce(fx, ax) end as target_x, case when ax is null then 360.0e0 when nf = 2 and span <= 343.4e0 then my else coalesce(fy, ay) end as target_y,
   case when ax is null then 'center_fallback' when nf = 2 and span <= 343.4e0 then 'dual_faces' when nf > 0 then 'face' else aty end as subject_type from frames f left join g using (clip_id, frame))
"""


@register("v17_frame_target", f"with {TARGET} select * from tg")
def v17(spark, sf_dir):
    return fr.frame_target(_dets(spark, sf_dir), _frames(spark, sf_dir))


@register(
    "v16_reframe_diagnostics",
    f"""with {TARGET}, s as (select clip_id, count(*) as frames, rnd4(1.0e0 - count(*) filter (where subject_type = 'center_fallback') / count(*)) as tracked_fraction, rnd4(count(*) filter (where subject_type = 'center_fallback') / count(*)) as fallback_fraction,
       rnd2(max(target_x) - min(target_x)) as center_range from tg group by 1), d as (select clip_id, count(*) as detections, count(distinct frame) as frames_with_detections, 0.9e0 as confidence_min, 0.9e0 as confidence_max from dets group by 1)
     select s.*, detections, frames_with_detections, confidence_min, confidence_max, case when tracked_fraction = 0 then 'center' when tracked_fraction < 0.5 then 'partial' else 'tracked' end as mode from s left join d using (clip_id)""",
)
def v16(spark, sf_dir):
    d = _dets(spark, sf_dir)
    return fr.crop_diagnostics(fr.frame_target(d, _frames(spark, sf_dir)), d)
