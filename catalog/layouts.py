"""Queries on leading subjects, layouts and evidence packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import framing as cf
from catalog import register
from clipspark.operators import context as cx
from clipspark.operators import framing as fr
from clipspark.operators import layouts as ly
from clipspark.sources import derived

WEIGHT = cf.DET + """, ob as (select *, row_number() over (partition by clip_id, subject order by t_ms) as hits, (frame * subject * 3 % 10) / 10.0e0 as speaking from dets),
 wt as (select clip_id, t_ms, scene_cut, subject as id, rnd9((case when type = 'face' then 1.0e0 else 0.75e0 end) * (0.42e0 * speaking + 0.28e0 * (w * h / max(w * h) over (partition by clip_id, t_ms)) + 0.15e0 * (1.0e0 - least(1.0e0, abs(x + w / 2.0e0 - 640) / 640)) + 0.15e0 * least(1.0e0, hits / 5.0e0))) as wgt from ob),
 fq as (select clip_id, t_ms, bool_or(scene_cut) as cut, arg_max(id, {'w': wgt, 'n': -id}) as best, max(wgt) as bw, row_number() over (partition by clip_id order by t_ms) as i from wt group by 1, 2)
"""


def _scored(spark, sf_dir):
    from pyspark.sql import Window

    d = cf._dets(spark, sf_dir)
    hits = F.row_number().over(Window.partitionBy("clip_id", "subject").orderBy("t_ms"))
    return d.select(
        "clip_id", "t_ms", "scene_cut", F.col("subject").alias("track_id"), "x", "y", "w", "h", "type", hits.alias("hits"),
        ((F.col("frame") * F.col("subject") * 3 % 10) / 10.0).alias("speaking"),
    )


LEAD = "with recursive " + WEIGHT + """, go as (select clip_id, i, t_ms, cast(best as bigint) as active, cast(null as bigint) as pending, cast(0 as bigint) as since, cast(-1000000 as bigint) as last, false as sw from fq where i = 1
     union all select clip_id, i, t_ms, case when k in (1, 3, 6) then best else act end, case when k = 5 then best when k = 7 then pend else null end, case when k = 5 then t_ms else snc end, case when k in (1, 3, 6) then t_ms else lst end, k in (1, 3, 6)
      from (select f.clip_id, f.i, f.t_ms, cast(f.best as bigint) as best, g.active as act, g.pending as pend, g.since as snc, g.last as lst,
          case when w.wgt is null then 1 when f.best = g.active then 2 when f.cut then 3 when not f.bw > w.wgt * 1.25e0 then 4 when g.pending is null or g.pending <> f.best then 5
            when f.t_ms - g.since >= 800 and f.t_ms - g.last >= 1500 then 6 else 7 end as k
        from go g join fq f on f.clip_id = g.clip_id and f.i = g.i + 1 left join wt w on w.clip_id = f.clip_id and w.t_ms = f.t_ms and w.id = g.active))
"""


@register(
    "v5_active_subject",
    LEAD + "select clip_id, t_ms, active as active_track, sw as switched from go",
)
def v5(spark, sf_dir):
    return ly.active_subject(_scored(spark, sf_dir))


@register(
    "v6_framing_targets",
    LEAD + """, bx as (select o.*, w.wgt, x + w.w0 / 2.0e0 as cx, y + o.h / 2.0e0 as cy from ob o join (select *, 0 as z from wt) w0 on w0.clip_id = o.clip_id and w0.t_ms = o.t_ms and w0.id = o.subject, lateral (select w0.wgt as wgt, o.w as w0) w),
     tg as (select b.*, case when w + 2 * (w * 0.55e0) <= 404 and x + w + w * 0.55e0 - 202 <= x - w * 0.55e0 + 202 then least(greatest(cx, x + w + w * 0.55e0 - 202), x - w * 0.55e0 + 202) else cx end as tx,
        360.0e0 as ty, g.active = b.subject as mine from bx b join go g on g.clip_id = b.clip_id and g.t_ms = b.t_ms),
     pf as (select clip_id, t_ms, max(tx) filter (where mine) as ox, max(ty) filter (where mine) as oy, max(type) filter (where mine) as oty, list({'cx': cx, 'cy': cy, 'w': w, 'g': wgt} order by cx) filter (where type = 'face') as f from tg group by 1, 2),
     lv as (select *, len(f) = 2 and (f[2].cx + f[2].w / 2.0e0) - (f[1].cx - f[1].w / 2.0e0) <= 404 * 0.88e0 and abs(f[1].g - f[2].g) <= 0.35e0 * greatest(f[1].g, f[2].g) as dual from pf),
     lx as (select clip_id, t_ms, case when dual then (f[1].cx + f[2].cx) / 2 else ox end as x, case when dual then 'dual_subject' else oty end as mode from lv),
     fx as (select fr.clip_id, fr.t_ms, case when frame % 4 = 1 then 100.0e0 + frame end as dom, lx.x, lx.mode, last_value(lx.x ignore nulls) over w as px, last_value(case when lx.x is not null then fr.t_ms end ignore nulls) over w as pt, row_number() over w as i
       from frames fr left join lx on lx.clip_id = fr.clip_id and lx.t_ms = fr.t_ms window w as (partition by fr.clip_id order by fr.t_ms)),
     ow as (select *, case when x is not null then x when pt is not null and t_ms - pt <= 1200 then px when dom is not null then dom end as ox from fx)
     select clip_id, t_ms, rnd4(coalesce(last_value(ox ignore nulls) over (partition by clip_id order by t_ms), 640.0e0)) as target_x, 360.0e0 as target_y,
       case when x is not null then mode when pt is not null and t_ms - pt <= 1200 then 'previous_stable' when dom is not null then 'dominant_region' when i = 1 then 'center_crop' else 'previous_stable' end as mode from ow""",
)
def v6(spark, sf_dir):
    n = F.col("frame")
    frames = cf._frames(spark, sf_dir).select("clip_id", "t_ms", F.when(n % 4 == 1, 100.0 + n).alias("dominant_x"))
    return ly.framing_targets(frames, _scored(spark, sf_dir))


@register("v9_simplify_trajectory")
def v9(spark, sf_dir):
    n = F.col("frame")
    pts = cf._frames(spark, sf_dir).select("clip_id", "t_ms", (F.floor(n * n % 300 / 2) * 2).alias("crop_x"), (n % 4).alias("crop_y"))
    return ly.simplify_trajectory(pts)


@register(
    "v11_fits_single_crop",
    f"""with {cf.DET}, u as (select clip_id, frame, min(x) as l, max(x + w) as r, min(y) as t, max(y + h) as b, min(h - frame % 50) as small, min(y + (h - frame % 50) / 2.0e0) as hi, max(y + (h - frame % 50) / 2.0e0) as lo, max(y + h - frame % 50) as b2 from dets group by 1, 2),
     c as (select *, case when r - l + 2.0e0 * 0.06e0 * 404 > 404 then 'subjects wider than a safe vertical crop' when small * (1920 / 720.0e0) / 1920 < 0.055e0 then 'a subject would be too small to read'
       when hi < 0.06e0 * 720 or lo > 0.76e0 * 720 then 'a subject would fall into the caption or platform-UI band' else 'subjects fit one safe vertical crop' end as reason from u)
     select clip_id, frame, reason, reason = 'subjects fit one safe vertical crop' as fits from c""",
)
def v11(spark, sf_dir):
    boxes = cf._dets(spark, sf_dir).withColumn("h", F.col("h") - F.col("frame") % 50)
    return ly.fits_single_crop(boxes, ["clip_id", "frame"])


WIN = f"""{cf.OBS}, im as (select clip_id, track_id, mean_x, mean_y, mean_w, mean_h, rnd6(0.45e0 * visibility_ratio + 0.25e0 * least(1.0e0, mean_area / 40000.0e0) + 0.20e0 * mean_speaking + 0.10e0 * continuity) as importance
    from s3 where persistent and mean_area / 921600.0e0 >= 0.0012e0),
  ends as (select clip_id, max(t_ms) + 200 as dur from frames group by 1), wins as (select clip_id, dur, unnest(range(0, greatest(1, cast(ceil(dur / 750.0) as bigint)))) as win from ends),
  own as (select w.clip_id, win, f.t_ms, f.scene_cut from wins w join frames f on f.clip_id = w.clip_id and f.t_ms // 750 = win),
  ins as (select * from own union all select w.clip_id, w.win, f.t_ms, f.scene_cut from wins w join frames f on f.clip_id = w.clip_id and f.t_ms < win * 750 and f.t_ms > (win - 1) * 750 where not exists (select 1 from own o where o.clip_id = w.clip_id and o.win = w.win)),
  seen as (select i.clip_id, win, o.* exclude (clip_id) from ins i join obs o on o.clip_id = i.clip_id and o.t_ms = i.t_ms),
  pf as (select clip_id, win, t_ms, avg(conf) as c, count(*) as b from seen group by all),
  facts as (select i.clip_id, i.win, count(*) as frame_count, rnd4(count(b) / count(*)) as coverage, rnd4(coalesce(avg(c), 0.0e0)) as tracking, bool_or(scene_cut) as scene_cut, rnd3(coalesce(sum(b), 0) / count(*)) as face_count
    from ins i left join pf using (clip_id, win, t_ms) group by 1, 2),
  mv as (select *, sqrt(pow(x + w / 2.0e0 - lag(x + w / 2.0e0) over k, 2) + pow(y + h / 2.0e0 - lag(y + h / 2.0e0) over k, 2)) as d from seen window k as (partition by clip_id, win, track_id order by t_ms)),
  shown as (select clip_id, win, track_id, count(*) as n, sum(d) as path, count(d) as steps, arg_max([x, y, w, h], t_ms) as box from mv group by all),
  act as (select clip_id, win, sum(path) / sum(steps) as activity from shown group by all having sum(steps) > 0),
  held as (select distinct f.clip_id, f.win, o.track_id from facts f join obs o on o.clip_id = f.clip_id and o.t_ms < f.win * 750 and f.win * 750 - o.t_ms <= 1200 where not exists (select 1 from shown s where s.clip_id = f.clip_id and s.win = f.win and s.track_id = o.track_id)),
  now as (select s.clip_id, s.win, track_id, rnd4(n / frame_count) as vis, box from shown s join facts using (clip_id, win) union all select clip_id, win, track_id, 0.45e0, null from held),
  pl as (select n.*, [mean_x, mean_y, mean_w, mean_h] as mean_box, row_number() over (partition by n.clip_id, win order by vis * 0.5e0 + importance desc, n.track_id) as rn from now n join im using (clip_id, track_id) where vis > 0),
  ld as (select clip_id, win, count(*) as subjects, max(track_id) filter (where rn = 1) as dominant, max(vis) filter (where rn = 1) as dv, max(track_id) filter (where rn = 2) as secondary, max(vis) filter (where rn = 2) as sv from pl group by all),
  bx as (select clip_id, win, coalesce(box, mean_box) as b from pl where rn <= 2),
  un as (select clip_id, win, min(b[1]) as l, max(b[1] + b[3]) as r, min(b[4]) as small, min(b[2] + b[4] / 2.0e0) as hi, max(b[2] + b[4] / 2.0e0) as lo from bx group by all),
  ft as (select *, case when r - l + 2.0e0 * 0.06e0 * 404 > 404 then 'subjects wider than a safe vertical crop' when small * (1920 / 720.0e0) / 1920 < 0.055e0 then 'a subject would be too small to read'
     when hi < 0.06e0 * 720 or lo > 0.76e0 * 720 then 'a subject would fall into the caption or platform-UI band' else 'subjects fit one safe vertical crop' end as why from un),
  ro as (select w.clip_id, w.win, dur, f.* exclude (clip_id, win), coalesce(subjects, 0) as subjects, dominant, secondary, dv, sv, why, activity, secondary is not null and dv >= 0.45e0 and sv >= 0.45e0 as pair
    from wins w left join facts f using (clip_id, win) left join ld using (clip_id, win) left join ft using (clip_id, win) left join act using (clip_id, win)),
  wru as (select *, case when frame_count is null then 1 when coverage < 0.35e0 then 2 when tracking < 0.45e0 then 3 when subjects >= 3 then 4 when pair and why = 'subjects fit one safe vertical crop' then 5 when pair then 6 when dv >= 0.65e0 then 7 else 8 end as rule from ro)"""


def _windows(spark, sf_dir):
    obs = cf._obs(spark, sf_dir)
    return ly.layout_windows(cf._frames(spark, sf_dir), obs, fr.track_summary(obs, cf._frames(spark, sf_dir)))


@register(
    "v12_layout_windows",
    f"""with {WIN} select clip_id, win as "window", win * 750 as start_ms, least((win + 1) * 750, dur) as end_ms, coalesce(frame_count, 0) as frame_count, coalesce(coverage, 0.0e0) as coverage, coalesce(tracking, 0.0e0) as tracking, coalesce(scene_cut, false) as scene_cut,
      coalesce(face_count, 0.0e0) as face_count, subjects, cast(dominant as bigint) as dominant, cast(secondary as bigint) as secondary, coalesce(dv, 0.0e0) as dominant_visibility, coalesce(sv, 0.0e0) as secondary_visibility, round(coalesce(activity, 0.0e0) / 1280.0e0, 5) as activity,
      case when rule = 6 then 'dual_stack' when rule in (5, 7) then 'single_crop' else 'full_frame_context' end as layout, [0.5e0, 0.6e0, 0.6e0, 0.75e0, 0.8e0, 0.82e0, 0.85e0, 0.55e0][rule] as confidence,
      case rule when 1 then 'no frames were analyzed in this window' when 2 then 'detection coverage too low to crop safely' when 3 then 'tracking confidence too low to crop safely' when 4 then 'group scene: ' || subjects || ' significant subjects'
        when 5 then 'two subjects share one safe crop (' || why || ')' when 6 then 'two persistent subjects cannot fit one safe crop (' || why || ')' when 7 then 'one dominant persistent subject' else 'no dominant subject with enough evidence to crop' end as reason from wru""",
)
def v12(spark, sf_dir):
    return _windows(spark, sf_dir)


@register("v13_smooth_layout")
def v13(spark, sf_dir):
    return ly.smooth_layout(_windows(spark, sf_dir))


SEGS = """segs as (select clip_id, frame // 20 as k, min(t_ms) as start_ms, max(t_ms) + 200 as end_ms, ['single_crop', 'dual_stack', 'full_frame_context'][1 + (clip_id + frame // 20) % 3] as layout from frames group by clip_id, frame // 20)"""


def _segs(spark, sf_dir):
    k = F.floor(F.col("frame") / 20)
    names = F.array(*[F.lit(x) for x in (ly.SINGLE, ly.DUAL, ly.FULL)])
    s = cf._frames(spark, sf_dir).groupBy("clip_id", k.alias("k")).agg(F.min("t_ms").alias("start_ms"), (F.max("t_ms") + 200).alias("end_ms"))
    return s.withColumn("layout", F.get(names, ((F.col("clip_id") + F.col("k")) % 3).cast("int")))


def _dual(spark, sf_dir):
    """Frames, boxes and track summaries, and a plan with two-subject stretches."""
    obs, frames = cf._obs(spark, sf_dir), cf._frames(spark, sf_dir)
    plan = _segs(spark, sf_dir).withColumn("subjects", F.when(F.col("layout") == ly.DUAL, "1,2").otherwise(""))
    return frames, obs, plan, fr.track_summary(obs, frames)


@register(
    "v15_viewport_targets",
    f"""with {cf.OBS}, {SEGS}, pr as (select s.clip_id, s.start_ms, s.end_ms, t.track_id, row_number() over (partition by s.clip_id, s.start_ms order by mean_center_x, t.track_id) - 1 as side from segs s join s3 t on t.clip_id = s.clip_id and t.track_id in (1, 2) where layout = 'dual_stack'),
     wn as (select f.clip_id, f.t_ms, side, track_id from frames f join pr on pr.clip_id = f.clip_id and start_ms <= t_ms and t_ms < end_ms),
     tb as (select clip_id, t_ms, track_id, case when w + 2 * (w * 0.55e0) <= 810 and x + w + w * 0.55e0 - 405.0e0 <= x - w * 0.55e0 + 405.0e0 then least(greatest(x + w / 2.0e0, x + w + w * 0.55e0 - 405.0e0), x - w * 0.55e0 + 405.0e0) else x + w / 2.0e0 end as tx,
       least(greatest(greatest(least(y + h / 2.0e0 + 720 * (0.5e0 - 0.38e0), y - 0.45e0 * h + 360.0e0), y + h - 360.0e0), 360.0e0), 360.0e0) as ty from obs),
     rw2 as (select f.clip_id, f.t_ms, f.scene_cut, s.side from frames f, (values (0), (1)) s(side) where f.clip_id in (select clip_id from wn)),
     lv as (select r.*, tx, ty from rw2 r left join (select * from wn join tb using (clip_id, t_ms, track_id)) l using (clip_id, t_ms, side))
     select clip_id, side::int as side, t_ms, coalesce(last_value(tx ignore nulls) over k, 640.0e0) as x, coalesce(last_value(ty ignore nulls) over k, 360.0e0) as y, scene_cut from lv window k as (partition by clip_id, side order by t_ms rows between unbounded preceding and current row)""",
)
def v15_targets(spark, sf_dir):
    return ly.viewport_targets(*_dual(spark, sf_dir))


@register("v15_dual_viewports")
def v15(spark, sf_dir):
    return ly.dual_viewports(*_dual(spark, sf_dir))


@register(
    "v14_layout_summary",
    f"""with {cf.OBS}, {SEGS}, im as (select clip_id, track_id, persistent, persistent and mean_area / 921600.0e0 >= 0.0012e0 as significant, frames_seen, rnd6(0.45e0 * visibility_ratio + 0.25e0 * least(1.0e0, mean_area / 40000.0e0) + 0.20e0 * mean_speaking + 0.10e0 * continuity) as importance from s3),
     s as (select clip_id, count(*) - 1 as switches, cast(coalesce(sum(end_ms - start_ms) filter (where layout = 'single_crop'), 0) as bigint) as single_crop_ms, cast(coalesce(sum(end_ms - start_ms) filter (where layout = 'dual_stack'), 0) as bigint) as dual_stack_ms,
       cast(coalesce(sum(end_ms - start_ms) filter (where layout = 'full_frame_context'), 0) as bigint) as full_frame_context_ms from segs group by 1),
     t as (select clip_id, count(*) as tracks, count(*) filter (where persistent) as persistent, count(*) filter (where significant) as significant, cast(sum(frames_seen) as bigint) as detections, cast(arg_max(track_id, {{'i': importance, 'n': -track_id}}) as bigint) as dominant_track from im group by 1)
     select *, case when persistent > 0 then rnd2(detections / persistent) else 0.0e0 end as detections_per_identity, case when detections >= 10 and persistent = 0 then 'no persistent subject' end as warning from s left join t using (clip_id)""",
)
def v14(spark, sf_dir):
    return ly.layout_summary(_segs(spark, sf_dir), fr.track_summary(cf._obs(spark, sf_dir), cf._frames(spark, sf_dir)))


BRANCH = f"""{cf.DET}, {SEGS}, fx as (select clip_id, start_ms, end_ms, case when layout = 'dual_stack' and clip_id % 4 <> 0 then 'full_frame_context' else layout end as layout,
   case when layout = 'dual_stack' and clip_id % 4 <> 0 then 'dual viewports unavailable; fell back to full frame' end as reason from segs)"""


def _branches(spark, sf_dir):
    segs = _segs(spark, sf_dir)
    return ly.render_branches(segs, segs.where(F.col("clip_id") % 4 == 0).select("clip_id"))


@register("v18_render_segments", f"with {BRANCH} select * from fx")
def v18_segments(spark, sf_dir):
    return _branches(spark, sf_dir)[0]


@register(
    "v18_render_branches",
    f"""with {BRANCH}, u as (select clip_id, layout, row_number() over (partition by clip_id order by sum(end_ms - start_ms) desc, layout) as rn from fx group by 1, 2)
     select clip_id, max(layout) filter (where rn = 1) as base_layout, coalesce(string_agg(layout, ',' order by layout) filter (where rn > 1), '') as overlays from u group by 1""",
)
def v18(spark, sf_dir):
    return _branches(spark, sf_dir)[1]


@register(
    "c18_evidence_packages",
    """with clips as (select source_id, start_ms // 45000 as candidate_seq, min(start_ms) as start_ms, min(start_ms) + 60000 as end_ms, string_agg(text, ' ' order by segment_id) as text from segments group by 1, 2),
     t as (select c.source_id, c.candidate_seq, coalesce(string_agg(s.text, ' ' order by segment_id) filter (where s.end_ms <= c.start_ms and c.start_ms - s.start_ms <= 45000), '') as previous_context,
       coalesce(string_agg(s.text, ' ' order by segment_id) filter (where s.end_ms > c.start_ms and s.start_ms >= c.end_ms and s.end_ms - c.end_ms <= 45000), '') as next_context from clips c join segments s using (source_id) group by 1, 2),
     ch as (select source_id, start_ms // 240000 as chapter, min(start_ms) as h0, min(start_ms) + 100000 as h1 from segments group by 1, 2),
     p as (select c.source_id, c.candidate_seq, chapter, greatest(0, least(c.end_ms, h1) - greatest(c.start_ms, h0)) as ov, abs((h0 + h1) - (c.start_ms + c.end_ms)) as dist from clips c join ch using (source_id)),
     hm as (select source_id, candidate_seq, case when max(ov) > 0 then arg_max(chapter, {'a': ov, 'b': -chapter}) else arg_min(chapter, {'a': dist, 'b': chapter}) end as chapter from p group by 1, 2)
     select c.source_id, c.candidate_seq, previous_context, next_context, chapter, length(c.text) as text_length, candidate_seq % 6 < 4 as insufficient_visual_evidence,
       sha256('package_v1_1:' || c.source_id || ':' || c.candidate_seq || ':' || c.start_ms || ':' || c.end_ms || ':' || c.text || ':' || previous_context || ':' || next_context || ':' || chapter || ':' || candidate_seq % 6)[:16] as package_hash
     from clips c join t using (source_id, candidate_seq) join hm using (source_id, candidate_seq)""",
)
def c18(spark, sf_dir):
    clips = derived.clips(spark, sf_dir)
    key = clips.select("source_id", "candidate_seq")
    packed = cx.evidence_packages(
        clips, derived.segments(spark, sf_dir), derived.coarse_chapters(spark, sf_dir),
        key.withColumn("text_length", F.lit(None).cast("long")), key.withColumn("decoded", F.col("candidate_seq") % 6),
    )
    return packed.select(
        "source_id", "candidate_seq", "previous_context", "next_context", "chapter", F.length("text").cast("long").alias("text_length"),
        "insufficient_visual_evidence", "package_hash",
    )
