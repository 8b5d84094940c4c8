"""Queries on loudness, motion and activity series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.operators import signals as sig
from clipspark.sources import derived

WIDTH = 3
ACT = """act0 as (select user_id as source_id, row_number() over w - 1 as bin, rnd4(value / max(value) over (partition by user_id)) as energy, (event_id % 100) / 100.0e0 as speech,
   rnd4((event_id % 37) / 37.0e0) as motion, event_type = 'error' as scene_change from events window w as (partition by user_id order by ts, event_id)),
 act1 as (select *, rnd4(coalesce(abs(energy - lag(energy) over (partition by source_id order by bin)), 0.0e0)) as delta from act0),
 activity as (select *, rnd4(greatest(0.0e0, least(1.0e0, delta * 0.35e0 + energy * 0.25e0 + motion * 0.30e0 + (case when scene_change then 1.0e0 else 0.0e0 end) * 0.10e0))) as combined from act1),
 spans as (select source_id, seq, seq * 20 as start_bin, seq * 20 + 40 as end_bin from (select source_id, unnest(range(0, max(bin) // 20 + 2)) as seq from activity group by 1))
"""
PCM = """pcm as (select cast(label as bigint) as source_id, row_number() over (partition by label order by vec_id) - 1 as frame_idx, list_transform(embedding, lambda x: cast(x as double)) as samples from embeddings),
 wins as (select source_id, frame_idx, i as win, sqrt(list_reduce(list_transform(samples[i * 3 + 1:i * 3 + 3], lambda x: x * x), lambda a, b: a + b, 0.0e0) / 3) as rms from (select *, unnest(range(0, len(samples) // 3)) as i from pcm)),
 per_frame as (select p.source_id, p.frame_idx as bin, sqrt(list_reduce(list_transform(samples, lambda x: x * x), lambda a, b: a + b, 0.0e0) / len(samples)) as raw, (select count(*) filter (where rms >= 0.01e0) / count(*) from wins w where w.source_id = p.source_id and w.frame_idx = p.frame_idx) as speech from pcm p),
 pspans as (select source_id, seq, seq * 5 as start_bin, seq * 5 + 12 as end_bin from (select source_id, unnest(range(0, max(frame_idx) // 5 + 2)) as seq from pcm group by 1))
"""


def _act(spark, sf_dir):
    a = derived.activity(spark, sf_dir)
    return a, derived.spans(a)


def _pcm(spark, sf_dir):
    p = derived.pcm(spark, sf_dir)
    return p, derived.spans(p.withColumnRenamed("frame_idx", "bin"), 5, 12)


@register("a1_rms_windows", f"with {PCM} select source_id, frame_idx, win, rnd6(rms) as rms from wins")
def a1(spark, sf_dir):
    out = sig.rms_windows(derived.pcm(spark, sf_dir), WIDTH)
    return out.select("source_id", "frame_idx", F.col("win").cast("long").alias("win"), F.round("rms", 6).alias("rms"))


PROFILE = PCM + ", prof as (select source_id, quantile_cont(rms, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) as q from wins group by 1)"


@register(
    "a2_audio_profile",
    f"with {PROFILE} select source_id, rnd6(q[1]) as p10, rnd6(q[2]) as p25, rnd6(q[3]) as p50, rnd6(q[4]) as p75, rnd6(q[5]) as p90, rnd6(q[6]) as p95, rnd6(q[7]) as p99 from prof",
)
def a2(spark, sf_dir):
    return sig.audio_profile(sig.rms_windows(derived.pcm(spark, sf_dir), WIDTH))


FEATS = PCM + """, fw as (select c.source_id, c.seq, w.rms, row_number() over (partition by c.source_id, c.seq order by frame_idx, win) - 1 as i, count(*) over (partition by c.source_id, c.seq) as n
   from pspans c join wins w on w.source_id = c.source_id and w.frame_idx >= c.start_bin and w.frame_idx < c.end_bin),
 fl as (select *, lag(rms) over (partition by source_id, seq order by i) as pr, greatest(1, n // 3) as t from fw),
 pk as (select c.source_id, c.seq, max(list_max(list_transform(samples, lambda x: abs(x)))) as pk from pspans c join pcm p on p.source_id = c.source_id and p.frame_idx >= c.start_bin and p.frame_idx < c.end_bin group by 1, 2),
 feats as (select source_id, seq, rnd6(avg(rms)) as rms_mean, rnd6(stddev_pop(rms)) as rms_std, rnd4(any_value(pk)) as peak, rnd4(count(*) filter (where rms < 0.01e0) / count(*)) as silence_ratio,
   rnd4(1.0e0 - rnd4(count(*) filter (where rms < 0.01e0) / count(*))) as speech_coverage, case when count(*) > 1 then rnd6(avg(abs(rms - pr))) else 0.0e0 end as energy_change_rate,
   rnd6(avg(rms) filter (where i < t)) as beginning_rms, rnd6(coalesce(avg(rms) filter (where i >= t and i < 2 * t), 0)) as middle_rms, rnd6(coalesce(avg(rms) filter (where i >= 2 * t), 0)) as ending_rms
  from fl join pk using (source_id, seq) group by 1, 2)
"""


@register(
    "a3_energy_percentile",
    f"with {FEATS}" + """, prof as (select source_id, list_transform(quantile_cont(rms, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]), lambda x: rnd6(x)) as q from wins group by 1),
     kn as (select source_id, [0.0e0] || q || [greatest(q[7] * 1.5e0, 1.0e0)] as xs, [0.0e0, 0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 0.95e0, 0.99e0, 1.0e0] as ys from prof),
     pos0 as (select f.source_id, seq, rms_mean, xs, ys, len(list_filter(xs, lambda x: x <= rms_mean)) as i from feats f join kn using (source_id))
     select source_id, seq, rms_mean, rnd4(case when i >= 9 then 1.0e0 else ys[i] + (rms_mean - xs[i]) / (xs[i + 1] - xs[i]) * (ys[i + 1] - ys[i]) end) as energy_percentile from pos0""",
)
def a3(spark, sf_dir):
    p, c = _pcm(spark, sf_dir)
    feats = sig.audio_features(c, p, WIDTH).select("source_id", "seq", "rms_mean")
    return sig.energy_percentile(feats, sig.audio_profile(sig.rms_windows(p, WIDTH)))


@register("a4_audio_features", f"with {FEATS} select * from feats")
def a4(spark, sf_dir):
    p, c = _pcm(spark, sf_dir)
    return sig.audio_features(c, p, WIDTH)


AUDIO = PCM + """, e as (select source_id, bin, rnd4(least(1.0e0, raw / case when max(raw) over (partition by source_id) > 1e-5 then max(raw) over (partition by source_id) else 1 end)) as energy, rnd4(speech) as speech from per_frame),
 d as (select *, coalesce(abs(energy - lag(energy) over (partition by source_id order by bin)), 0.0e0) as st from e),
 audio as (select source_id, bin, energy, rnd4(least(1.0e0, st / case when max(st) over (partition by source_id) > 1e-5 then max(st) over (partition by source_id) else 1 end)) as delta, speech from d),
 mads as (select source_id, frame_idx, case when pv is not null then list_reduce(list_transform(range(1, len(samples) + 1), lambda i: abs(samples[i] - pv[i])), lambda a, b: a + b, 0.0e0) / len(samples) end as mad
   from (select *, lag(samples) over (partition by source_id order by frame_idx) as pv from pcm)),
 visual as (select source_id, frame_idx as bin, rnd4(least(1.0e0, coalesce(mad, 0.0e0))) as motion, coalesce(mad, 0) >= 0.35e0 as scene_change from mads)
"""


@register("a5_audio_timeline", f"with {AUDIO} select * from audio")
def a5(spark, sf_dir):
    return sig.audio_timeline(derived.pcm(spark, sf_dir), WIDTH)


@register("a6_visual_timeline", f"with {AUDIO} select * from visual")
def a6(spark, sf_dir):
    return sig.visual_timeline(derived.gray(spark, sf_dir))


@register(
    "a7_activity_profile",
    f"with {AUDIO}" + """, v2 as (select source_id, bin + 3 as bin, motion, scene_change from visual), j as (select source_id, bin, coalesce(energy, 0.0e0) as energy, coalesce(delta, 0.0e0) as delta, coalesce(speech, 0.0e0) as speech, coalesce(motion, 0.0e0) as motion, coalesce(scene_change, false) as scene_change
      from audio full join v2 using (source_id, bin))
     select *, rnd4(greatest(0.0e0, least(1.0e0, delta * 0.35e0 + energy * 0.25e0 + motion * 0.30e0 + (case when scene_change then 1.0e0 else 0.0e0 end) * 0.10e0))) as combined from j""",
)
def a7(spark, sf_dir):
    visual = sig.visual_timeline(derived.gray(spark, sf_dir)).withColumn("bin", F.col("bin") + 3)
    return sig.activity_profile(sig.audio_timeline(derived.pcm(spark, sf_dir), WIDTH), visual)


@register(
    "a8_visual_features",
    f"with {AUDIO}" + """ select source_id, count(*) as decoded, rnd4(coalesce(avg(mad), 0)) as motion_score, count(*) filter (where mad >= 0.35e0) as scene_change_count,
      rnd4(count(*) filter (where frame_idx % 3 = 0) / count(*)) as face_presence_ratio, rnd4(count(*) filter (where frame_idx % 4 = 1) / count(*)) as person_presence_ratio from mads group by 1""",
)
def a8(spark, sf_dir):
    g = derived.gray(spark, sf_dir)
    i = F.col("frame_idx")
    kinds = F.array_compact(F.array(F.when(i % 3 == 0, F.lit("face")), F.when(i % 4 == 1, F.lit("person"))))
    return sig.visual_features(g, g.select("source_id", "frame_idx", F.explode(kinds).alias("type")))


CURVE = ACT + """, cur as (select c.source_id, c.seq, c.start_bin, cast(a.bin - c.start_bin as double) as o, a.* exclude (source_id) from spans c join activity a on a.source_id = c.source_id and a.bin >= c.start_bin and a.bin < c.end_bin),
 curve as (select source_id, seq, start_bin, o, energy, delta, speech, motion, scene_change, combined from cur
   union all select source_id, seq, start_bin, 20.0e0, 0.5e0, 0.5e0, 0.5e0, 0.0e0, false, 0.5e0 from spans s where not exists (select 1 from cur where cur.source_id = s.source_id and cur.seq = s.seq))
"""


@register(
    "a9_candidate_curve",
    f"with {CURVE}" + """ , k as (select *, row_number() over (partition by source_id, seq order by delta + energy desc, o) as ra, row_number() over (partition by source_id, seq order by motion desc, o) as rm,
       row_number() over (partition by source_id, seq order by combined desc, o) as rc from curve)
     select source_id, seq, count(*) as points, string_agg(cast(o as varchar), ',' order by ra) filter (where ra <= 3) as top_audio, string_agg(cast(o as varchar), ',' order by rm) filter (where rm <= 3) as top_motion,
       string_agg(cast(o as varchar), ',' order by rc) filter (where rc <= 3) as top_combined from k group by 1, 2""",
)
def a9(spark, sf_dir):
    a, c = _act(spark, sf_dir)
    return sig.curve_peaks(sig.candidate_curve(c, a))


BURSTS = CURVE + """, rk as (select *, row_number() over (partition by source_id, seq order by combined desc, delta desc, o) as r from curve),
 p1 as (select * from rk where r = 1), far as (select k.*, case when abs(k.o - p1.o) >= 3 then 0 when abs(k.o - p1.o) >= 2 then 1 else 2 end as tier,
    case when p1.o + 4 < 40 then p1.o + 4 else greatest(0.5e0, p1.o - 4) end as goal from rk k join p1 using (source_id, seq)),
 p2 as (select * from (select *, row_number() over (partition by source_id, seq order by case when r = 1 then 2 else tier end, case when r > 1 and tier < 2 then r else 0 end, abs(o - goal), o) as pick from far) where pick = 1),
 two as (select source_id, seq, o, energy, delta, motion, scene_change, 1 as activity_rank from p1 union all select source_id, seq, o, energy, delta, motion, scene_change, 2 from p2)
"""


@register(
    "a10_burst_peaks",
    f"with {BURSTS}" + """ select source_id, seq, row_number() over (partition by source_id, seq order by o, activity_rank) as burst, o as center, greatest(0.0e0, o - 1) as start_offset, least(40.0e0, o + 1) as end_offset,
      case when scene_change then 'scene_change_proximity' when delta >= 0.6e0 and delta >= motion then 'audio_delta_peak' when motion >= 0.5e0 and motion >= delta then 'visual_motion_peak'
        when energy >= 0.7e0 then 'audio_energy_peak' else 'combined_activity_peak' end as reason, cast(activity_rank as bigint) as activity_rank from two""",
)
def a10(spark, sf_dir):
    a, c = _act(spark, sf_dir)
    return sig.burst_peaks(sig.candidate_curve(c, a))


@register(
    "a11_reaction_signals",
    f"with {CURVE}" + """, x as (select *, avg(energy) over (partition by source_id, seq) as m, count(*) over (partition by source_id, seq) as n, lead(energy) over w as ne, lag(energy) over w as pe,
        row_number() over w - row_number() over (partition by source_id, seq, delta >= 0.25e0 order by bin) as isl, row_number() over (partition by source_id, seq order by combined desc, bin) as rk from cur window w as (partition by source_id, seq order by bin)),
      ch as (select source_id, seq, max(c) as longest from (select source_id, seq, isl, count(*) as c from x where delta >= 0.25e0 group by 1, 2, 3) group by 1, 2),
      s as (select source_id, seq, any_value(n) as n, count(*) filter (where delta >= 0.25e0 and energy >= m and speech > 0) as la, coalesce(max(energy - pe), 0) as up, count(*) filter (where energy >= m + 0.12e0) as ex,
        bool_or(energy <= 0.1e0 and speech <= 0.05e0 and coalesce(ne >= m + 0.12e0, false)) as pr, count(*) filter (where energy <= 0.1e0 and speech <= 0.05e0) as da, string_agg(bin - start_bin, ',' order by rk) filter (where rk <= 3) as po from x group by 1, 2)
     select p.source_id, p.seq, coalesce(n, 0) >= 2 as available, case when n >= 2 then rnd3(least(1.0e0, la / greatest(1.0e0, n / 4.0e0))) end as laughter_like, case when n >= 2 then rnd3(greatest(0.0e0, least(1.0e0, up))) end as sudden_increase,
       case when n >= 2 then rnd3(ex / n) end as excited_ratio, case when n >= 2 then pr end as pause_then_reaction, case when n >= 2 then rnd3(least(1.0e0, coalesce(longest, 0) / 4.0e0)) end as rapid_chain,
       case when n >= 2 then rnd3(da / n) end as dead_air_ratio, case when n >= 2 then po end as peak_offsets
     from spans p left join s using (source_id, seq) left join ch using (source_id, seq)""",
)
def a11(spark, sf_dir):
    a, c = _act(spark, sf_dir)
    return sig.reaction_signals(c, a)


CLIPS = "clips as (select source_id, start_ms // 45000 as seq, min(start_ms) as start_ms, min(start_ms) + 60000 as end_ms from segments group by 1, 2)"
TCURVE = CLIPS + """, pc as (select c.source_id, c.seq, b as bin, least(least(g.end_ms, c.end_ms) - c.start_ms, (b + 1) * 1000) - greatest(greatest(g.start_ms, c.start_ms) - c.start_ms, b * 1000) as ms, length(g.text) / ((g.end_ms - g.start_ms) / 1000.0e0) as rate
   from clips c join segments g on g.source_id = c.source_id and g.start_ms < c.end_ms and g.end_ms > c.start_ms, (select unnest(range(0, 60)) as b)
   where b * 1000 < least(g.end_ms, c.end_ms) - c.start_ms and (b + 1) * 1000 > greatest(g.start_ms, c.start_ms) - c.start_ms),
 sm as (select source_id, seq, bin, least(1.0e0, sum(ms) / 1000.0e0) as speech, sum(rate * ms / 1000.0e0) as chars from pc group by 1, 2, 3),
 al as (select source_id, seq, unnest(range(0, 60)) as bin from clips),
 tn as (select source_id, seq, bin, coalesce(speech, 0.0e0) as speech, coalesce(chars, 0.0e0) as chars, max(coalesce(chars, 0)) over (partition by source_id, seq) as top from al left join sm using (source_id, seq, bin)),
 tcurve as (select source_id, seq, bin, rnd4(speech) as speech, rnd4(case when top > 1e-9 then chars / top else 0.0e0 end) as energy, rnd4(least(1.0e0, 0.65e0 * speech + 0.35e0 * (case when top > 1e-9 then chars / top else 0.0e0 end))) as combined from tn)
"""


def _tcurve(spark, sf_dir):
    cands = derived.clips(spark, sf_dir).withColumnRenamed("candidate_seq", "seq")
    return sig.transcript_curve(cands, derived.segments(spark, sf_dir))


@register("a12_transcript_curve", f"with {TCURVE} select * from tcurve")
def a12(spark, sf_dir):
    return _tcurve(spark, sf_dir)


PCURVE = """pj as (select c.source_id, c.seq, f.bin - c.start_bin as bin, raw, speech, max(raw) over (partition by c.source_id, c.seq) as peak, count(*) over (partition by c.source_id, c.seq) as n
   from {spans} c join per_frame f on f.source_id = c.source_id and f.bin >= c.start_bin and f.bin < c.end_bin),
 pe as (select *, raw / peak as energy from pj where n >= 2), pd as (select *, coalesce(abs(energy - lag(energy) over (partition by source_id, seq order by bin)), 0) as st from pe),
 pcurve as (select source_id, seq, bin, rnd4(speech) as speech, rnd4(energy) as energy, rnd4(least(1.0e0, 0.55e0 * energy + 0.30e0 * speech + 0.15e0 * least(1.0e0, st * 4.0e0))) as combined from pd)
"""


@register("a13_pcm_curve", f"with {PCM}, {PCURVE.replace('{spans}', 'pspans')} select * from pcurve")
def a13(spark, sf_dir):
    p, c = _pcm(spark, sf_dir)
    return sig.pcm_curve(c, p, WIDTH)


LADDER = f"""{CURVE}, {PCM}, {PCURVE.replace('{spans}', 'spans')}, {TCURVE},
 lad as (select source_id, seq, cast(o as bigint) as bin, combined, 0 as p, 'activity' as curve_source from cur where source_id % 3 <> 0 union all select source_id, seq, bin, combined, 1, 'pcm' from pcurve
   union all select source_id, seq, bin, combined, 2, 'transcript' from tcurve semi join spans using (source_id, seq) union all select source_id, seq, unnest(range(0, 40)), 0.5e0, 3, 'flat' from spans),
 us as (select *, count(*) over (partition by source_id, seq, p) as n from lad), ub as (select *, min(p) over (partition by source_id, seq) as best from us where n >= 2 or p >= 2),
 lh as (select *, min(combined) over (partition by source_id, seq) as lo, max(combined) over (partition by source_id, seq) as hi from ub where p = best),
 signal as (select source_id, seq, bin, curve_source, combined, case when hi - lo < 1e-9 then 0.5e0 else rnd4((combined - lo) / (hi - lo)) end as norm from lh)
"""


def _ladder(spark, sf_dir):
    """Candidates and the rungs of their curve. Transcripts of other candidates are not looked at."""
    a, c = _act(spark, sf_dir)
    seen = sig._on_bins(c, a).where(F.col("source_id") % 3 != 0).select(
        "source_id", "seq", (F.col("bin") - F.col("start_bin")).alias("bin"), "combined"
    )
    clips = derived.clips(spark, sf_dir).withColumnRenamed("candidate_seq", "seq").join(c.select("source_id", "seq"), ["source_id", "seq"], "left_semi")
    said = derived.segments(spark, sf_dir).join(c.select("source_id").distinct(), "source_id", "left_semi")
    spoken = sig.transcript_curves(clips, said)
    return c.withColumn("duration", F.col("end_bin") - F.col("start_bin")), [("activity", seen), ("pcm", sig.pcm_curve(c, derived.pcm(spark, sf_dir), WIDTH)), ("transcript", spoken)]


def _signal(spark, sf_dir):
    return sig.signal_curve(*_ladder(spark, sf_dir))


@register("a14_signal_curve", f"with {LADDER} select * from signal")
def a14(spark, sf_dir):
    return _signal(spark, sf_dir)


@register(
    "a15_span_stats",
    f"with {LADDER}" + """, sp as (select source_id, seq, k as span, k * 7 + 0.5e0 as s0, k * 7 + 11.5e0 as s1 from spans, (select unnest(range(0, 4)) as k)), l as (select source_id, seq, max(bin) as last from signal group by 1, 2),
     r as (select source_id, seq, span, least(greatest(cast(floor(s0) as bigint), 0), last) as lo, least(greatest(cast(ceil(s1) as bigint) - 1, least(greatest(cast(floor(s0) as bigint), 0), last)), last) as hi from sp join l using (source_id, seq))
     select r.source_id, r.seq, span, rnd6(sum(cast(round(norm * 10000) as bigint))::double / (10000.0e0 * count(*))) as mean, max(norm) as peak, rnd6(count(*) filter (where norm < 0.35e0) / count(*)) as low_ratio, arg_max(bin, {'a': norm, 'b': -bin}) as peak_bin
     from r join signal g on g.source_id = r.source_id and g.seq = r.seq and g.bin between lo and hi group by 1, 2, 3""",
)
def a15(spark, sf_dir):
    k = F.col("span")
    spans = sig.signal_curves(*_ladder(spark, sf_dir)).select("source_id", "seq", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("span"))
    return sig.curve_spans(spans.select("source_id", "seq", "c", "span", (k * 7 + 0.5).alias("start_offset"), (k * 7 + 11.5).alias("end_offset")))


@register(
    "a16_payoff_block",
    f"with {LADDER}" + """, t as (select source_id, seq, max(norm) as top, min(bin) as b0, max(bin) as b1 from signal group by 1, 2), pk as (select t.*, greatest(0.35e0, 0.5e0 * top) as cut, (select min(bin) from signal g where g.source_id = t.source_id and g.seq = t.seq and norm = top) as pk_at from t),
     e as (select pk.source_id, pk.seq, cast(coalesce(max(bin) filter (where norm < cut and bin < pk_at) + 1, any_value(b0)) as double) as s0, cast(coalesce(min(bin) filter (where norm < cut and bin > pk_at), any_value(b1) + 1) as double) as s1 from pk join signal g on g.source_id = pk.source_id and g.seq = pk.seq group by 1, 2),
     a as (select *, case when (source_id + seq) % 3 <> 0 then ((source_id * 7 + seq * 3) % 30)::double end as a0, case when (source_id + seq) % 3 <> 0 then ((source_id * 7 + seq * 3) % 30 + 12)::double end as a1 from e)
     select source_id, seq, s0, s1, case when a0 is null then s0 when least(s1, a1) > greatest(s0, a0) then least(s0, a0) else a0 end as start_offset,
       case when a0 is null then s1 when least(s1, a1) > greatest(s0, a0) then least(40.0e0, greatest(s1, a1)) else least(40.0e0, a1) end as end_offset from a""",
)
def a16(spark, sf_dir):
    _, c = _act(spark, sf_dir)
    at = ((F.col("source_id") * 7 + F.col("seq") * 3) % 30).cast("double")
    has = (F.col("source_id") + F.col("seq")) % 3 != 0
    advice = c.select("source_id", "seq", F.when(has, at).alias("a0"), F.when(has, at + 12.0).alias("a1"), F.lit(40.0).alias("duration"))
    return sig.payoff_block(_signal(spark, sf_dir), advice)


@register(
    "a17_interpret_regions",
    """with r as (select doc_id, doc_id % 9 <> 0 as supplied, (doc_id % 120) / 2.0e0 as start_s, (doc_id % 120) / 2.0e0 + 40 as end_s, case when doc_id % 9 = 0 or doc_id % 10 = 0 then null when doc_id % 13 = 0 then 'soon' else cast((doc_id * 7) % 90 as varchar) end as r0,
       case when doc_id % 9 = 0 then null else cast((doc_id * 7) % 90 + doc_id % 12 - 1 as varchar) end as r1 from documents),
     n as (select *, try_cast(r0 as double) as a, try_cast(r1 as double) as b from r),
     k as (select *, a between -0.5e0 and 40.5e0 and b between -0.5e0 and 40.5e0 as ok0, a between start_s - 0.5e0 and end_s + 0.5e0 and b between start_s - 0.5e0 and end_s + 0.5e0 as ok1 from n),
     i as (select *, case when not supplied then 'missing' when a is null or b is null or b <= a then 'malformed' when ok0 and ok1 and start_s > 0.5e0 then 'ambiguous' when ok0 then 'offset' when ok1 then 'absolute_converted' else 'out_of_range' end as interpretation from k)
     select doc_id, interpretation, interpretation in ('offset', 'absolute_converted') as accepted,
       rnd3(case interpretation when 'offset' then least(greatest(a, 0.0e0), 40.0e0) when 'absolute_converted' then least(greatest(a - start_s, 0.0e0), 40.0e0) end) as region_start,
       rnd3(case interpretation when 'offset' then least(greatest(b, 0.0e0), 40.0e0) when 'absolute_converted' then least(greatest(b - start_s, 0.0e0), 40.0e0) end) as region_end from i""",
)
def a17(spark, sf_dir):
    i = F.col("doc_id")
    at = i * 7 % 90
    regions = derived.table(spark, sf_dir, "documents").select(
        "doc_id", (i % 9 != 0).alias("supplied"), ((i % 120) / 2.0).alias("start_s"), ((i % 120) / 2.0 + 40).alias("end_s"),
        F.when((i % 9 == 0) | (i % 10 == 0), F.lit(None)).when(i % 13 == 0, "soon").otherwise(at.cast("string")).alias("r0"),
        F.when(i % 9 != 0, (at + i % 12 - 1).cast("string")).alias("r1"),
    )
    return sig.interpret_regions(regions).select("doc_id", "interpretation", "accepted", "region_start", "region_end")


@register(
    "a19_frame_plan",
    """with c as (select doc_id as source_id, cast(0 as bigint) as seq, greatest(500, doc_id * 131 % 60000) as d, doc_id * 37 % 60000 as b1, doc_id * 53 % 60000 as b2 from documents),
     w as (select source_id, seq, list_transform([{'x': d * 10 // 100, 'k': 'global'}, {'x': d * 35 // 100, 'k': 'global'}, {'x': d * 65 // 100, 'k': 'global'}, {'x': d * 90 // 100, 'k': 'global'}, {'x': b1 - 750, 'k': 'burst_1'}, {'x': b1 - 250, 'k': 'burst_1'}, {'x': b1 + 250, 'k': 'burst_1'}, {'x': b1 + 750, 'k': 'burst_1'},
        {'x': b2 - 750, 'k': 'burst_2'}, {'x': b2 - 250, 'k': 'burst_2'}, {'x': b2 + 250, 'k': 'burst_2'}, {'x': b2 + 750, 'k': 'burst_2'}], lambda s: [{'ms': least(greatest(s.x, 50), greatest(50, d - 50)), 'kind': s.k}]) as l from c),
     p as (select source_id, seq, list_reduce(l, lambda acc, x: case when len(acc) < 12 and len(list_filter(acc, lambda y: abs(y.ms - x[1].ms) < 100)) = 0 then acc || x else acc end) as picked from w),
     f as (select source_id, seq, unnest(picked) as f from p)
     select source_id, seq, row_number() over (partition by source_id, seq order by f.ms) - 1 as sample, f.ms as offset_ms, f.kind as kind from f""",
)
def a19(spark, sf_dir):
    i = F.col("doc_id")
    cands = derived.table(spark, sf_dir, "documents").select(
        i.alias("source_id"), F.lit(0).cast("long").alias("seq"), (i * 131 % 60000).alias("duration_ms"),
        (i * 37 % 60000).alias("burst_1_ms"), (i * 53 % 60000).alias("burst_2_ms"),
    )
    return sig.frame_plan(cands)


@register(
    "a19_frame_plan_scenes",
    """with c as (select doc_id as source_id, cast(0 as bigint) as seq, greatest(500, doc_id * 131 % 60000) as d, list_transform(range(1, 1 + doc_id % 9), lambda k: doc_id * 37 * k * k % greatest(500, doc_id * 131 % 60000)) as cuts from documents),
     w as (select source_id, seq, list_concat([list_transform([50, 180, 310, 440, 560, 690, 820, 950], lambda f: {'ms': cast(round(d * f / 1000.0) as bigint), 'kind': 'uniform'})], list_transform(cuts, lambda x: [{'ms': cast(x as bigint), 'kind': 'scene_change'}])) as l from c),
     p as (select source_id, seq, list_reduce(l, lambda acc, x: case when len(acc) < 12 and len(list_filter(acc, lambda y: abs(y.ms - x[1].ms) < 500)) = 0 then acc || x else acc end) as picked from w),
     f as (select source_id, seq, unnest(picked) as f from p)
     select source_id, seq, row_number() over (partition by source_id, seq order by f.ms, f.kind) - 1 as sample, f.ms as offset_ms, f.kind as kind from f""",
)
def a19_scenes(spark, sf_dir):
    i = F.col("doc_id")
    d = F.greatest(F.lit(500), i * 131 % 60000)
    cuts = F.when(i % 9 > 0, F.transform(F.sequence(F.lit(1).cast("long"), i % 9), lambda k: i * 37 * k * k % d))
    cands = derived.table(spark, sf_dir, "documents").select(i.alias("source_id"), F.lit(0).cast("long").alias("seq"), (i * 131 % 60000).alias("duration_ms"), cuts.alias("cuts_ms"))
    return sig.frame_plan_scenes(cands)
