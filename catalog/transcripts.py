"""Transcript queries: windows, lexical scores, suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.operators import lexical, ranking, segmentation
from clipspark.plans.discover import discover
from clipspark.sources import derived
from oracle import views


def _windows(spark, sf_dir):
    return segmentation.candidate_windows(derived.segments(spark, sf_dir))


@register(
    "g3_candidate_windows",
    "select source_id, candidate_seq, candidate_id, start_ms, end_ms, duration_ms, n_segments, text from candidates",
)
def candidate_windows(spark, sf_dir):
    return _windows(spark, sf_dir).withColumn("n_segments", F.size("segment_ids").cast("long")).drop("segment_ids")


@register(
    "c1_score_heuristic",
    """select source_id, candidate_seq, score, hook_score, standalone_score, emotion_score, information_score,
       shareability_score, reason from heuristic""",
)
def score_heuristic(spark, sf_dir):
    return lexical.score_heuristic(_windows(spark, sf_dir)).select(
        "source_id", "candidate_seq", "score", "hook_score", "standalone_score", "emotion_score",
        "information_score", "shareability_score", "reason",
    )


@register(
    "r1_rank_predictions",
    """select source_id, candidate_seq, score,
       row_number() over (partition by source_id order by score desc, candidate_seq) as rank from heuristic""",
)
def rank_predictions(spark, sf_dir):
    scored = lexical.score_heuristic(_windows(spark, sf_dir)).select("source_id", "candidate_seq", "score")
    return ranking.rank_predictions(scored)


@register(
    "r2_overlap_pairs",
    """select a.source_id, a.candidate_seq as a_seq, b.candidate_seq as b_seq,
       least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as overlap_ms,
       (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) / least(a.duration_ms, b.duration_ms) as overlap_ratio,
       (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))
         / (a.duration_ms + b.duration_ms - (least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))) as iou
       from candidates a join candidates b on a.source_id = b.source_id and a.candidate_seq < b.candidate_seq
        and a.start_ms < b.end_ms and b.start_ms < a.end_ms""",
)
def overlap_pairs(spark, sf_dir):
    return ranking.overlap_pairs(_windows(spark, sf_dir))


DISCOVER_SQL = """
with recursive ranked as (
  select *, row_number() over (partition by source_id order by score desc, candidate_seq) as pos from heuristic
), step as (
  select source_id, cast(0 as bigint) as pos,
         cast([] as struct(seq bigint, s bigint, e bigint, score double)[]) as picks
  from (select distinct source_id from heuristic)
  union all
  select r.source_id, r.pos,
    case when len(s.picks) < 5 and len(list_filter(s.picks, lambda p:
           least(p.e, r.end_ms) - greatest(p.s, r.start_ms) > 0
           and (least(p.e, r.end_ms) - greatest(p.s, r.start_ms)) / least(p.e - p.s, r.end_ms - r.start_ms) >= 0.6e0)) = 0
         then list_append(s.picks, {'seq': r.candidate_seq, 's': r.start_ms, 'e': r.end_ms, 'score': r.score})
         else s.picks end
  from step s join ranked r on r.source_id = s.source_id and r.pos = s.pos + 1
), best as (
  select source_id, arg_max(picks, pos) as picks from step group by source_id
), flat as (
  select source_id, unnest(range(1, len(picks) + 1)) as rank, unnest(picks) as p from best
), stop as (select source_id, max(end_ms) as source_end_ms from segments group by source_id)
"""


@register(
    "r3_nms_top_k",
    DISCOVER_SQL + "select source_id, rank, p.seq as candidate_seq, p.s as start_ms, p.e as end_ms, p.score as score from flat",
)
def nms_top_k(spark, sf_dir):
    return ranking.nms_top_k(lexical.score_heuristic(_windows(spark, sf_dir)))


@register(
    "discover",
    DISCOVER_SQL
    + """select source_id, rank, p.seq as candidate_seq, p.s as start_ms, p.e as end_ms, p.score as score,
      greatest(0, p.s - 2000) as padded_start_ms, least(source_end_ms, p.e + 2000) as padded_end_ms
      from flat join stop using (source_id)""",
)
def discover_query(spark, sf_dir):
    return discover(derived.segments(spark, sf_dir))
