"""Queries on chapters, captions, context joins and boundary refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.operators import context as cx
from clipspark.operators import segmentation as sg
from clipspark.sources import derived

V = """
clips as (select source_id, start_ms // 45000 as candidate_seq, min(start_ms) as start_ms, min(start_ms) + 60000 as end_ms,
  string_agg(text, ' ' order by segment_id) as text from segments group by 1, 2)
"""
LINE = "segment_id || ':' || start_ms || '-' || end_ms || ':' || text"


@register(
    "g1_transcript_hash",
    f"""with b as (select source_id, count(*) as n, max(end_ms) as duration_ms,
        sha256(string_agg({LINE}, '|' order by segment_id)) as h from segments group by 1)
      select source_id, sha256(lang || '|' || duration_ms || '|' || n || '|' || h)[:16] as transcript_hash
      from b join documents on doc_id = source_id""",
)
def g1(spark, sf_dir):
    return sg.transcript_hash(derived.sources(spark, sf_dir), derived.segments(spark, sf_dir))


@register(
    "g2_candidate_set_id",
    f"""with b as (select source_id, count(*) as n, max(end_ms) as duration_ms,
        sha256(string_agg({LINE}, '|' order by segment_id)) as h from segments group by 1)
      select source_id, 'cset_' || sha256(sha256(lang || '|' || duration_ms || '|' || n || '|' || h)[:16] || '|30.000|60.000|90.000|15.000|1.0.0')[:16] as candidate_set_id
      from b join documents on doc_id = source_id""",
)
def g2(spark, sf_dir):
    return sg.candidate_set_id(g1(spark, sf_dir)).select("source_id", "candidate_set_id")


CHAPTERS = """with recursive scene as (select source_id, start_ms + 300 as t_ms from segments where segment_id % 40 = 0),
flag as (select n.*, n.n as cnt, lead(start_ms) over w as nxt_s, exists(select 1 from scene c where c.source_id = n.source_id and abs(c.t_ms - n.end_ms) <= 2000) as cut
  from numbered n window w as (partition by source_id order by idx)),
ptr as (select i.source_id, i.idx, i.n, i.start_ms, coalesce(min(j.idx), i.n - 1) as last
  from flag i left join flag j on j.source_id = i.source_id and j.idx >= i.idx and j.idx < i.n - 1 and
    (j.end_ms - i.start_ms >= 420000 or (j.end_ms - i.start_ms >= 240000 and (greatest(0, j.nxt_s - j.end_ms) >= 600 or j.cut)))
  group by i.source_id, i.idx, i.n, i.start_ms),
hop as (select source_id, idx, last, n from ptr where idx = 0 union all
  select p.source_id, p.idx, p.last, p.n from hop h join ptr p on p.source_id = h.source_id and p.idx = h.last + 1),
ch as (select h.source_id, h.idx, h.last, a.start_ms, b.end_ms, b.segment_id as last_segment, a.segment_id as first_segment,
   case when h.last = h.n - 1 then 'transcript_gap' when b.end_ms - a.start_ms >= 420000 then 'max_duration' when b.cut then 'scene_change' else 'transcript_gap' end as src,
   row_number() over w as chapter, count(*) over (partition by h.source_id) as total,
   lead(b.end_ms - a.start_ms) over w as next_len, lead(b.end_ms) over w as next_end, lead(b.segment_id) over w as next_last
  from hop h join flag a on a.source_id = h.source_id and a.idx = h.idx join flag b on b.source_id = h.source_id and b.idx = h.last
  window w as (partition by h.source_id order by h.idx)),
chapters as (select source_id, chapter, printf('chapter_%03d', chapter) as chapter_id, start_ms,
   case when chapter = total - 1 and next_len < 150000 then next_end else end_ms end as end_ms, first_segment,
   case when chapter = total - 1 and next_len < 150000 then next_last else last_segment end as last_segment,
   case when chapter = total - 1 and next_len < 150000 then 'tail_merge' else src end as boundary_source
  from ch where not (total >= 2 and chapter = total and end_ms - start_ms < 150000))
"""


def _chapters(spark, sf_dir):
    return sg.chapter_plan(derived.segments(spark, sf_dir), derived.scenes(spark, sf_dir))


@register("g4_chapter_plan", CHAPTERS + "select * from chapters")
def g4(spark, sf_dir):
    return _chapters(spark, sf_dir)


DIGEST = (
    CHAPTERS
    + f""", dig as (select c.source_id, chapter, count(*) as segments,
   string_agg('[' || ((s.start_ms + 50) // 100) // 10 || '.' || ((s.start_ms + 50) // 100) % 10 || 's] ' || text, chr(10) order by segment_id) as full_text,
   sha256(any_value(c.start_ms) || '|' || any_value(c.end_ms) || '|' || count(*) || '|' || string_agg(segment_id || ':' || s.start_ms || '-' || s.end_ms || ':' || text, '|' order by segment_id))[:16] as chapter_hash
  from chapters c join segments s on s.source_id = c.source_id and s.segment_id between c.first_segment and c.last_segment group by 1, 2)
"""
)


@register(
    "g5_chapter_digest",
    DIGEST
    + """select source_id, chapter, segments, case when length(full_text) > 12000 then full_text[:12000] || chr(10) || '[... chapter transcript truncated ...]' else full_text end as shown,
      chapter_hash from dig""",
)
def g5(spark, sf_dir):
    return sg.chapter_digest(_chapters(spark, sf_dir), derived.segments(spark, sf_dir))


@register(
    "g5_plan_hash",
    DIGEST
    + """, part as (select source_id, chapter // 1000 as p, sha256(string_agg(chapter_hash, '|' order by chapter))[:16] as h from dig group by 1, 2)
      select source_id, sha256(string_agg(h, '|' order by p))[:16] as plan_hash from part group by 1""",
)
def g5_plan(spark, sf_dir):
    return sg.plan_hash(g5(spark, sf_dir))


CARDS = """with recursive w0 as (select source_id, segment_id * 100000 + i as pos, start_ms + i * 400 as s, start_ms + i * 400 + 340 as e, word
   from (select source_id, segment_id, start_ms, unnest(range(len(ws))) as i, unnest(ws) as word from (select *, regexp_split_to_array(text, '\\s+') as ws from segments))),
w1 as (select *, row_number() over w - 1 as idx, count(*) over (partition by source_id) as n, lead(s) over w as ns,
   suffix(word, '.') or suffix(word, '!') or suffix(word, '?') as stop,
   suffix(word, ',') or suffix(word, ':') or suffix(word, ';') or suffix(word, '—') or suffix(word, '-') as comma
  from w0 window w as (partition by source_id order by pos)),
ptr as (select i.source_id, i.idx, i.n, min(j.idx) as last from w1 i join w1 j on j.source_id = i.source_id and j.idx between i.idx and i.idx + 3
   where j.idx = j.n - 1 or j.stop or j.ns - j.e >= 350 or (j.comma and j.idx > i.idx) or j.idx = i.idx + 3
     or (select sum(length(k.word)) from w1 k where k.source_id = i.source_id and k.idx between i.idx and j.idx) + (j.idx - i.idx) >= 32
   group by all),
hop as (select source_id, idx, last, n from ptr where idx = 0 union all
  select p.source_id, p.idx, p.last, p.n from hop h join ptr p on p.source_id = h.source_id and p.idx = h.last + 1),
cards as (select h.source_id, row_number() over w as card, a.s as start_ms, greatest(b.e, a.s + 400) as e0, lead(a.s) over w as ns, h.idx, h.last
  from hop h join w1 a on a.source_id = h.source_id and a.idx = h.idx join w1 b on b.source_id = h.source_id and b.idx = h.last
  window w as (partition by h.source_id order by h.idx)),
card as (select c.source_id, c.card, c.start_ms, case when c.ns - c.e0 > 0 and c.ns - c.e0 < 200 then c.ns else c.e0 end as end_ms, c.idx, c.last,
   string_agg(w.word, ' ' order by w.idx) as text from cards c join w1 w on w.source_id = c.source_id and w.idx between c.idx and c.last group by all)
"""


def _cards(spark, sf_dir):
    lines, spread = derived.lines(spark, sf_dir)
    return sg.caption_cards(lines, spread=spread)


@register("g6_caption_events", CARDS + "select source_id, card, start_ms, end_ms, text from card")
def g6(spark, sf_dir):
    return _cards(spark, sf_dir).drop("words")


@register(
    "g7_caption_word_spans",
    CARDS
    + """, f as (select c.source_id, c.card, w.idx - c.idx as word_idx, w.word, case when w.idx = c.idx then c.start_ms else w.s end as begin_ms,
      case when w.idx < c.last then lead(w.s) over (partition by c.source_id, c.card order by w.idx) else c.end_ms end as u
      from card c join w1 w on w.source_id = c.source_id and w.idx between c.idx and c.last)
     select source_id, card, word_idx, word, begin_ms, case when u <= begin_ms then begin_ms + 100 else u end as until_ms from f""",
)
def g7(spark, sf_dir):
    return sg.caption_word_spans(_cards(spark, sf_dir))


@register(
    "g8_candidate_stats",
    """select source_id, count(*) as candidates, min(duration_ms) / 1000.0e0 as min_s,
       rnd2(cast(sum(duration_ms) as double) / (1000.0e0 * count(*))) as mean_s, max(duration_ms) / 1000.0e0 as max_s from candidates group by 1""",
)
def g8(spark, sf_dir):
    return sg.candidate_stats(sg.candidate_windows(derived.segments(spark, sf_dir)))


@register(
    "j1_surrounding_context",
    "with " + V + """, t as (select c.source_id, c.candidate_seq,
       string_agg(s.text, ' ' order by segment_id) filter (where s.end_ms <= c.start_ms and c.start_ms - s.start_ms <= 45000) as p,
       string_agg(s.text, ' ' order by segment_id) filter (where s.end_ms > c.start_ms and s.start_ms >= c.end_ms and s.end_ms - c.end_ms <= 45000) as n,
       c.start_ms - max(s.end_ms) filter (where s.end_ms <= c.start_ms) as silence_before_ms,
       min(s.start_ms) filter (where s.start_ms >= c.end_ms) - c.end_ms as silence_after_ms
      from clips c join segments s using (source_id) group by c.source_id, c.candidate_seq, c.start_ms, c.end_ms)
    select source_id, candidate_seq, coalesce(p, '') as previous_context, coalesce(n, '') as next_context,
      rnd1(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) / greatest(0.1e0, (end_ms - start_ms) / 60000.0e0)) as speech_rate_wpm,
      silence_before_ms, silence_after_ms from t join clips using (source_id, candidate_seq)""",
)
def j1(spark, sf_dir):
    return cx.surrounding_context(derived.clips(spark, sf_dir), derived.segments(spark, sf_dir))


@register(
    "j2_context_windows",
    "with " + V + """, l as (select source_id, max(end_ms) as d from segments group by 1),
    w as (select source_id, candidate_seq, text, least(start_ms, greatest(d, end_ms)) as c0, end_ms as c1, greatest(0, start_ms - 75000) as b0,
      least(greatest(d, end_ms), end_ms + 25000) as a1 from clips join l using (source_id))
    select w.source_id, candidate_seq, b0 as before_start_ms, c0 as start_ms, c1 as end_ms, a1 as after_end_ms,
      coalesce(string_agg(s.text, ' ' order by s.start_ms, segment_id) filter (where s.start_ms < c0 and s.end_ms > b0), '') as before_text,
      trim(w.text) as candidate_text,
      coalesce(string_agg(s.text, ' ' order by s.start_ms, segment_id) filter (where s.start_ms < a1 and s.end_ms > c1), '') as after_text
    from w join segments s using (source_id) group by all""",
)
def j2(spark, sf_dir):
    return cx.context_windows(
        derived.clips(spark, sf_dir), derived.segments(spark, sf_dir), derived.sources(spark, sf_dir)
    )


@register(
    "j3_assign_chapter",
    "with " + V + """, ch as (select source_id, start_ms // 240000 as chapter, min(start_ms) as h0, min(start_ms) + 100000 as h1 from segments group by 1, 2),
    p as (select c.source_id, c.candidate_seq, chapter, greatest(0, least(c.end_ms, h1) - greatest(c.start_ms, h0)) as ov, abs((h0 + h1) - (c.start_ms + c.end_ms)) as dist
      from clips c join ch using (source_id))
    select source_id, candidate_seq, case when max(ov) > 0 then arg_max(chapter, {'a': ov, 'b': -chapter}) else arg_min(chapter, {'a': dist, 'b': chapter}) end as chapter,
      max(ov) as shared_ms from p group by 1, 2""",
)
def j3(spark, sf_dir):
    return cx.assign_chapter(derived.clips(spark, sf_dir), derived.coarse_chapters(spark, sf_dir))


MOMENTS = "with " + V + """, moments as (select source_id, candidate_seq as moment_id, start_ms + (source_id % 70) * 1000 as t_ms from clips where candidate_seq % 3 = 0),
covering as (select m.source_id, m.moment_id, m.t_ms, c.candidate_seq,
    case when c.candidate_seq is not null then row_number() over (partition by m.source_id, m.moment_id order by abs(c.start_ms + c.end_ms - 2 * m.t_ms), c.candidate_seq) end as place
  from moments m left join clips c on c.source_id = m.source_id and m.t_ms between c.start_ms and c.end_ms),
preds as (select *, row_number() over (partition by source_id, scorer order by score desc, candidate_seq) as rank,
    case when scorer = 'contextual' then case when source_id % 5 = 0 then 'rejected_weak' else 'ranked' end end as status
  from (select source_id, candidate_seq, 'heuristic' as scorer, cast((candidate_seq * 37 + source_id) % 101 as double) as score from clips union all
    select source_id, candidate_seq, 'multimodal', cast((candidate_seq * 53 + source_id * 3) % 101 as double) from clips where candidate_seq % 2 = 0 union all
    select source_id, candidate_seq, 'contextual', cast((candidate_seq * 71 + source_id * 7) % 101 as double) from clips where candidate_seq % 4 = 0)),
wide as (select source_id, candidate_seq, max(rank) filter (where scorer = 'heuristic') as heuristic_rank, max(rank) filter (where scorer = 'multimodal') as multimodal_rank,
    max(rank) filter (where scorer = 'contextual') as contextual_rank, max(score) filter (where scorer = 'heuristic') as heuristic_score,
    max(score) filter (where scorer = 'multimodal') as multimodal_score, max(score) filter (where scorer = 'contextual') as contextual_score,
    max(status) filter (where scorer = 'contextual') as status from preds group by 1, 2)
"""


@register("j4_covering_candidates", MOMENTS + "select *, candidate_seq is not null as covered from covering")
def j4(spark, sf_dir):
    return cx.covering_candidates(derived.clips(spark, sf_dir), derived.moments(spark, sf_dir))


SCORERS = ("heuristic", "multimodal", "contextual")


def _shortlist(preds):
    return preds.where((F.col("scorer") == "heuristic") & (F.col("rank") <= 5))


@register(
    "j5_inspect_moments",
    MOMENTS
    + """, s as (select source_id, moment_id, t_ms, max(candidate_seq) filter (where place = 1) as candidate_seq,
        coalesce(string_agg(candidate_seq, ',' order by place), '') as covering from covering group by 1, 2, 3),
      x as (select *, printf('%02d:%02d:%02d', t_ms // 1000 // 3600, t_ms // 1000 % 3600 // 60, t_ms // 1000 % 60) as label from s left join wide using (source_id, candidate_seq))
    select source_id, moment_id, candidate_seq, covering, case when candidate_seq is not null then heuristic_rank <= 5 end as in_shortlist,
      heuristic_rank, multimodal_rank, contextual_rank, heuristic_score, multimodal_score, contextual_score,
      case when candidate_seq is null then 'NOT COVERED: no candidate window contains ' || label
        when status <> 'ranked' then 'Candidate ' || candidate_seq || ' was rejected (' || status || ')'
        when contextual_rank is not null then 'Candidate ' || candidate_seq || ' is ranked #' || contextual_rank
        else 'Candidate ' || candidate_seq || ' covers ' || label || ' but has no final prediction' end as message from x""",
)
def j5(spark, sf_dir):
    preds = derived.clip_predictions(spark, sf_dir)
    return cx.inspect_moments(
        derived.moments(spark, sf_dir), derived.clips(spark, sf_dir), preds, _shortlist(preds), SCORERS, "contextual"
    )


@register(
    "j6_refine_boundaries",
    "with " + V + """, l as (select source_id, max(end_ms) as d from segments group by 1),
    n as (select count(g.segment_id) as k, c.source_id, c.candidate_seq, c.start_ms as s, c.end_ms as e, d,
      arg_min(g.start_ms, segment_id) filter (where g.start_ms <= c.start_ms and c.start_ms <= g.end_ms) as hs,
      min(g.start_ms) filter (where g.start_ms >= c.start_ms) as nx,
      arg_min(g.end_ms, segment_id) filter (where g.start_ms <= c.end_ms and c.end_ms <= g.end_ms) as he,
      max(g.end_ms) filter (where g.end_ms <= c.end_ms) as pv, max(g.end_ms) filter (where g.end_ms < c.end_ms) as pr
      from (select source_id + o as source_id, candidate_seq, start_ms + (candidate_seq % 5) * 900 - 1800 as start_ms, end_ms from clips, (values (0), (1000000)) v(o) where o = 0 or source_id % 50 = 0) c
      left join segments g using (source_id) left join l using (source_id) group by all),
    a as (select *, case when hs is not null and s - hs <= 5000 then greatest(0, hs - 500) when hs is not null then greatest(0, s - 5000)
       when nx - s > 1000 then greatest(s, nx - 500) when nx - s > 0 then greatest(0, nx - 500) else s end as ns from n),
    b as (select *, case when he is not null and he - e <= 5000 then least(d, he + 500) when he is not null and pr - ns >= 15000 then least(d, pr + 500)
       when he is not null then least(d, e + 5000) when e - pv > 1000 then least(e, pv + 500) else e end as ne,
      case when hs is not null and s - hs <= 5000 then printf('snapped start earlier by %.2fs to phrase start (%.2fs)', (s - hs) / 1000.0, hs / 1000.0)
       when hs is not null then 'shifted start earlier by max 5.0s towards phrase start'
       when nx - s > 1000 then printf('trimmed %.2fs leading silence to %.2fs', (nx - s) / 1000.0, ns / 1000.0)
       when nx - s > 0 then printf('aligned start to phrase onset (%.2fs)', nx / 1000.0) end as r1 from a)
    select source_id, candidate_seq, greatest(0, least(ns, d - 1000)) as refined_start_ms,
      greatest(greatest(0, least(ns, d - 1000)) + 1000, least(ne, d)) as refined_end_ms,
      case when k = 0 then 'No transcript segments available' else coalesce(nullif(concat_ws('; ', r1, case when he is not null and he - e <= 5000 then printf('extended end by %.2fs to complete phrase (%.2fs)', (he - e) / 1000.0, he / 1000.0)
       when he is not null and pr - ns >= 15000 then printf('trimmed cutoff phrase at end to previous phrase completion (%.2fs)', pr / 1000.0)
       when he is not null then 'extended end by max 5.0s towards phrase end'
       when e - pv > 1000 then printf('trimmed %.2fs trailing silence to %.2fs', (e - pv) / 1000.0, ne / 1000.0) end), ''), 'boundaries preserved') end as reason from b""",
)
def j6(spark, sf_dir):
    spans = derived.clips(spark, sf_dir).withColumn(
        "start_ms", F.col("start_ms") + (F.col("candidate_seq") % 5) * 900 - 1800
    )
    # and spans of sources that have neither segments nor a length
    spans = spans.unionByName(spans.where(F.col("source_id") % 50 == 0).withColumn("source_id", F.col("source_id") + 1_000_000))
    return cx.refine_boundaries(spans, derived.segments(spark, sf_dir), derived.sources(spark, sf_dir))


@register(
    "j7_speech_units",
    "with " + V + """, u as (select c.source_id, candidate_seq, segment_id, greatest(g.start_ms, c.start_ms) - c.start_ms as s, least(g.end_ms, c.end_ms) - c.start_ms as e, trim(g.text) as text
      from clips c join segments g on g.source_id = c.source_id and g.start_ms < c.end_ms and c.start_ms < g.end_ms),
    g as (select *, coalesce(lead(s) over w - e, 0) as gap, coalesce(s - lag(e) over w > 1200, false) as fresh from u where e - s >= 150
      window w as (partition by source_id, candidate_seq order by s, segment_id))
    select source_id, candidate_seq, row_number() over w - 1 as unit, s as start_ms, e as end_ms, text,
      regexp_matches(text, '[.!?…]+["''»)\\]]*\\s*$') or gap >= 1200 as terminal, greatest(0, gap) as gap_after_ms,
      cast(sum(cast(fresh as int)) over w as bigint) as run_index from g window w as (partition by source_id, candidate_seq order by s, segment_id)""",
)
def j7(spark, sf_dir):
    return cx.speech_units(derived.clips(spark, sf_dir), derived.segments(spark, sf_dir))


@register(
    "j8_burst_transcript",
    "with " + V + """, b as (select source_id, candidate_seq, k as burst, start_ms + 5000 + k * 20000 + (candidate_seq % 10) * 1000 as b0,
       start_ms + 7000 + k * 20000 + (candidate_seq % 10) * 1000 as b1 from clips, (select unnest([0, 1]) as k)),
    t as (select b.source_id, candidate_seq, burst, g.text, min(segment_id) as first from b join segments g on g.source_id = b.source_id
        and g.end_ms >= greatest(0, b0 - 750) and g.start_ms <= b1 + 750 group by all)
    select source_id, candidate_seq, cast(burst as bigint) as burst, coalesce(string_agg(text, ' ' order by first), '') as text from b left join t using (source_id, candidate_seq, burst) group by 1, 2, 3""",
)
def j8(spark, sf_dir):
    at = F.col("start_ms") + 5000 + F.col("burst") * 20000 + (F.col("candidate_seq") % 10) * 1000
    bursts = (
        derived.clips(spark, sf_dir)
        .withColumn("burst", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
        .select("source_id", "candidate_seq", "burst", at.alias("start_ms"), (at + 2000).alias("end_ms"))
    )
    return cx.burst_transcript(bursts, derived.segments(spark, sf_dir))


@register(
    "j9_retrieval_provenance",
    MOMENTS
    + """select source_id, candidate_seq, heuristic_rank, contextual_rank, heuristic_score, contextual_score, multimodal_rank as input_rank,
      multimodal_score as input_score, heuristic_rank <= 5 as in_retrieval_shortlist from wide where multimodal_rank is not null""",
)
def j9(spark, sf_dir):
    preds = derived.clip_predictions(spark, sf_dir)
    return cx.retrieval_provenance(
        preds, derived.clips(spark, sf_dir), _shortlist(preds), "multimodal", ("heuristic", "contextual")
    )


REQUESTS = """with requests as (select event_id, event_type as stage, user_id || ':' || props as request_hash from events),
cache as (select request_hash from requests where stage in ('purchase', 'view'))
"""


def _requests(spark, sf_dir):
    req = derived.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("stage"), F.concat_ws(":", F.col("user_id").cast("string"), "props").alias("request_hash")
    )
    return req, req.where(F.col("stage").isin("purchase", "view"))


@register("j10_pending_requests", REQUESTS + "select * from requests anti join cache using (request_hash)")
def j10(spark, sf_dir):
    return cx.pending_requests(*_requests(spark, sf_dir))


@register(
    "j10_cache_usage",
    REQUESTS + """select stage, count(*) as requests, count(*) filter (where hit) as cache_hits, count(*) filter (where hit is null) as cache_misses
      from requests left join (select distinct request_hash, true as hit from cache) using (request_hash) group by 1""",
)
def j10_usage(spark, sf_dir):
    return cx.cache_usage(*_requests(spark, sf_dir))


@register(
    "j11_pending_transcripts",
    """select user_id as source_id, event_id, epoch_us(ts) as requested_at from events where event_type = 'signup'
       and user_id not in (select user_id from events where event_type = 'purchase' and user_id % 3 <> 0)""",
)
def j11(spark, sf_dir):
    ev = derived.table(spark, sf_dir, "events").withColumnRenamed("user_id", "source_id")
    req = ev.where(F.col("event_type") == "signup").select("source_id", "event_id", F.unix_micros(F.to_timestamp("ts")).alias("requested_at"))
    found = ev.where((F.col("event_type") == "purchase") & (F.col("source_id") % 3 != 0))  # every third source has none
    return cx.pending_transcripts(req, found)


@register(
    "j12_verify_replicas",
    """with l as (select case when p_partkey % 23 = 0 then '' else 'k' || p_partkey end as key, p_partkey as id, p_size + 1 as bytes, case when p_partkey % 5 <> 0 then sha256(p_name) end as sha from part),
    r as (select 'k' || p_partkey as key, case when p_partkey % 11 = 0 then p_size + 2 else p_size + 1 end as bytes, sha256(case when p_partkey % 13 = 0 then 'x' else p_name end) as sha from part where p_partkey % 9 <> 0),
    j as (select l.key, id, l.bytes, l.sha, r.bytes as rb, r.sha as rs, r.key is not null as there from l left join r using (key))
    select key, coalesce(key <> '' and there and rb = bytes and (sha is null or sha = rs), false) as verified,
      case when key = '' then 'no remote key recorded' when not there then 'remote object missing' when rb <> bytes then 'remote size ' || rb || ' != local ' || bytes
        when sha <> rs then 'remote sha256 differs' else key end as reason,
      coalesce(rb = bytes and sha = rs, false) as skip_publish from j""",
)
def j12(spark, sf_dir):
    part = derived.table(spark, sf_dir, "part")
    p = F.col("p_partkey")
    key = F.concat(F.lit("k"), p.cast("string"))
    local = part.select(
        F.when(p % 23 == 0, "").otherwise(key).alias("key"),
        (F.col("p_size") + 1).alias("bytes"),
        F.when(p % 5 != 0, F.sha2("p_name", 256)).alias("sha"),
    )
    remote = part.where(p % 9 != 0).select(
        key.alias("key"),
        F.when(p % 11 == 0, F.col("p_size") + 2).otherwise(F.col("p_size") + 1).alias("bytes"),
        F.sha2(F.when(p % 13 == 0, "x").otherwise(F.col("p_name")), 256).alias("sha"),
    )
    return cx.verify_replicas(local, remote)
