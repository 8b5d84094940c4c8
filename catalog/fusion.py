"""Shortlist, tournament and final ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import register
from catalog import scoring as cs
from clipspark.operators import tournament as tn
from clipspark.operators.stages import materialise
from clipspark.plans import rerank as rr
from clipspark.sources import derived

SET, ID = tn.SET, tn.ID

SHORT = """short as (select * from (select *, row_number() over (partition by candidate_set_id order by best_rank, sum_rank, candidate_id) as place
  from (select *, least(coalesce(a_rank, 21), coalesce(b_rank, 21)) as best_rank, coalesce(a_rank, 21) + coalesce(b_rank, 21) as sum_rank
    from (select candidate_set_id, candidate_id, max(rank) filter (where scorer = 'A') as a_rank, max(rank) filter (where scorer = 'B') as b_rank
      from predictions where rank <= 20 group by 1, 2))) where place <= 32)
"""


def _shortlist(spark, sf_dir):
    return tn.shortlist_union(derived.predictions(spark, sf_dir), "A", "B")


@register(
    "r4_shortlist_union",
    f"with {SHORT} select *, concat_ws(',', case when a_rank is not null then 'A' end, case when b_rank is not null then 'B' end) as retrieval_sources from short",
)
def r4(spark, sf_dir):
    return _shortlist(spark, sf_dir)


@register(
    "r5_shortlist_interleave",
    """with t as (select candidate_set_id, candidate_id, min(case when scorer = 'B' then 2 * rank else 2 * rank + 1 end) as turn from predictions where rank <= 12 group by 1, 2)
    select * from (select candidate_set_id, candidate_id, row_number() over (partition by candidate_set_id order by turn) as place from t) where place <= 20""",
)
def r5(spark, sf_dir):
    return tn.shortlist_interleave(derived.predictions(spark, sf_dir), "A", "B")


NAMED = """named as (select candidate_set_id, candidate_id, rank, score, case when scorer = 'A' then case when cast(candidate_set_id[4:] as int) % 3 = 0 then 'heuristic_v1' else 'zeta' end
   else case when cast(candidate_set_id[4:] as int) % 4 = 0 then 'multimodal_v1_1' when cast(candidate_set_id[4:] as int) % 4 = 1 then 'alpha' else 'highlights' end end as scorer from predictions),
resolved as (select * from (select *, dense_rank() over (partition by candidate_set_id order by case scorer when 'multimodal_v1_1' then 0 when 'heuristic_v1' then 4 when 'highlights' then 9 else 5 end, scorer) as d from named) where d = 1)
"""


def _named(spark, sf_dir):
    s = F.substring(SET, 4, 10).cast("int")
    a = F.when(s % 3 == 0, "heuristic_v1").otherwise("zeta")
    b = F.when(s % 4 == 0, "multimodal_v1_1").when(s % 4 == 1, "alpha").otherwise("highlights")
    return derived.predictions(spark, sf_dir).select(
        SET, ID, "rank", "score", F.when(F.col("scorer") == "A", a).otherwise(b).alias("scorer")
    )


@register("r6_resolve_ranking", f"with {NAMED} select candidate_set_id, candidate_id, rank, score, scorer from resolved")
def r6(spark, sf_dir):
    return tn.resolve_ranking(_named(spark, sf_dir)).select(SET, ID, "rank", "score", "scorer")


@register(
    "r7_select_top_n",
    f"""with {NAMED} select candidate_set_id, candidate_id, scorer, rank, printf('%s_r%02d_%d', candidate_set_id[:12], rank, candidate_id) as clip_id,
      case when candidate_id % 3 <> 0 then candidate_id * 1000 else candidate_id * 1000 + 7 end as start_ms, case when candidate_id % 3 <> 0 then candidate_id * 1000 + 500 else candidate_id * 1000 + 507 end as end_ms
     from (select *, row_number() over (partition by candidate_set_id order by rank, candidate_id) as rn from resolved) where rn <= 10""",
)
def r7(spark, sf_dir):
    i = F.col(ID)
    cands = cs._cands(spark, sf_dir)
    windows = cands.where(i % 3 != 0).select(SET, ID, (i * 1000).alias("start_ms"), (i * 1000 + 500).alias("end_ms"))
    highlights = cands.select(SET, ID, (i * 1000 + 7).alias("start_ms"), (i * 1000 + 507).alias("end_ms"))
    return tn.select_top_n(tn.resolve_ranking(_named(spark, sf_dir)), windows, highlights, 10)


CLASS = "case editorial_class when 'STRONG' then 4 when 'GOOD' then 3 when 'MAYBE' then 2 when 'WEAK' then 1 else 0 end"
SEEDED = (
    cs.TABLE.rstrip()
    + ", "
    + cs.CRITIC_SQL.rstrip()
    + f""", {SHORT},
  judged as (select r.candidate_set_id, r.candidate_id, cls as editorial_class, scroll_stop, rec.confidence, rnd6((pen + c.penalty) / 100.0e0) as penalty, c.hard_reject,
     cls <> 'FATAL_REJECT' and not c.hard_reject as alive from short r join rec using (candidate_set_id, candidate_id) join cr c using (candidate_set_id, candidate_id)),
  seeded as (select *, row_number() over (partition by candidate_set_id order by {CLASS} desc, scroll_stop desc, candidate_id) - 1 as seed, count(*) over (partition by candidate_set_id) as n from judged where alive),
  dealt0 as (select *, case when n <= 7 then 0 else seed % cast(ceil(n / 7.0) as bigint) end as b0 from seeded),
  dealt1 as (select *, count(*) over (partition by candidate_set_id, b0) as m from dealt0),
  dealt2 as (select *, bool_or(m >= 2) over (partition by candidate_set_id) as paired from dealt1),
  dealt as (select * exclude (n, b0, m, paired), case when paired then b0 else 0 end as batch from dealt2 where m >= 2 or not paired),
  named_order as (select candidate_set_id, batch, candidate_id, min((candidate_id * 7) % 31) as pos from dealt where candidate_id % 4 <> 0 group by 1, 2, 3),
  borda as (select candidate_set_id, candidate_id, batch, row_number() over w - 1 as position,
      case when count(*) over (partition by candidate_set_id, batch) <= 1 then 1.0e0 else rnd4((count(*) over (partition by candidate_set_id, batch) - row_number() over w) / (count(*) over (partition by candidate_set_id, batch) - 1)) end as listwise_points
     from dealt left join named_order using (candidate_set_id, batch, candidate_id) window w as (partition by candidate_set_id, batch order by pos is null, pos, seed)),
  pairs as (select x.candidate_set_id, least(x.candidate_id, y.candidate_id) as a, greatest(x.candidate_id, y.candidate_id) as b from seeded x join seeded y on x.candidate_set_id = y.candidate_set_id and y.seed - x.seed in (1, 2)),
  jud as (select *, ['A', 'B', 'TIE'][1 + (31 * a + 17 * b) % 3] as winner from pairs),
  flat as (select candidate_set_id, a as me, b as foe, winner = 'A' as win, winner = 'B' as loss from jud union all select candidate_set_id, b, a, winner = 'B', winner = 'A' from jud),
  st as (select candidate_set_id, me as candidate_id, count(*) filter (where win) as wins, count(*) filter (where loss) as losses, count(*) filter (where not win and not loss) as ties,
     count(*) filter (where win) * 1.0e0 + count(*) filter (where not win and not loss) * 0.5e0 as points from flat group by 1, 2),
  pts as (select s.*, coalesce(wins, 0) as wins, coalesce(losses, 0) as losses, coalesce(ties, 0) as ties, coalesce(points, 0.0e0) as points, coalesce(bo.listwise_points, 0.0e0) as listwise_points
     from seeded s left join st using (candidate_set_id, candidate_id) left join borda bo using (candidate_set_id, candidate_id)),
  hh as (select p.candidate_set_id, p.candidate_id, coalesce(sum(case when q.points = p.points then case when f.win then 1.0e0 when f.loss then 0.0e0 else 0.5e0 end end), 0.0e0) as head_to_head
     from pts p left join flat f on f.candidate_set_id = p.candidate_set_id and f.me = p.candidate_id left join pts q on q.candidate_set_id = p.candidate_set_id and q.candidate_id = f.foe group by 1, 2),
  fin as (select p.*, h.head_to_head, rnd6(points + penalty) as adjusted_points from pts p join hh h using (candidate_set_id, candidate_id)),
  ordered as (select *, row_number() over (partition by candidate_set_id order by adjusted_points desc, points desc, head_to_head desc, listwise_points desc, {CLASS} desc, scroll_stop desc, seed) as final_rank from fin)
"""
)


def _survivors(spark, sf_dir):
    return rr.split_survivors(_shortlist(spark, sf_dir), cs.recovered(spark, sf_dir), cs.critic(spark, sf_dir))


def _seeded(spark, sf_dir):
    return tn.seed_order(_survivors(spark, sf_dir)[0])


def _orderings(batches):
    """What the model said: some ids left out, one unknown, one repeated."""
    i = F.col(ID)
    said = batches.where(i % 4 != 0).select(SET, "batch", ID, (i * 7 % 31).alias("pos"))
    unknown = batches.select(SET, "batch", F.lit(-1).cast("long").alias(ID), F.lit(0).cast("long").alias("pos")).distinct()
    return said.unionByName(unknown).unionByName(said.withColumn("pos", F.col("pos") + 100))


def _judgments(seeded):
    """Stored comparisons of every survivor with the next two in seed order."""
    order = Window.partitionBy(SET).orderBy("seed")
    foes = F.array(F.lead(ID, 1).over(order), F.lead(ID, 2).over(order))
    pairs = seeded.withColumn("foes", foes).select(SET, F.col(ID).alias("me"), F.explode("foes").alias("foe")).where(F.col("foe").isNotNull())
    ab = pairs.select(SET, F.least("me", "foe").alias("a"), F.greatest("me", "foe").alias("b"))
    names = F.array(F.lit("A"), F.lit("B"), F.lit("TIE"))
    return ab.withColumn("winner", F.get(names, ((31 * F.col("a") + 17 * F.col("b")) % 3).cast("int")))


@register("r8_seed_order", SEEDED + "select candidate_set_id, candidate_id, editorial_class, scroll_stop, penalty, seed from seeded")
def r8(spark, sf_dir):
    return _seeded(spark, sf_dir).select(SET, ID, "editorial_class", "scroll_stop", "penalty", "seed")


@register("r9_deal_batches", SEEDED + "select candidate_set_id, candidate_id, seed, batch from dealt")
def r9(spark, sf_dir):
    return tn.deal_batches(_seeded(spark, sf_dir)).select(SET, ID, "seed", "batch")


@register("r10_borda_points", SEEDED + "select * from borda")
def r10(spark, sf_dir):
    batches = tn.deal_batches(_seeded(spark, sf_dir))
    return tn.borda_points(batches, _orderings(batches))


def _ready(spark, sf_dir):
    seeded = _seeded(spark, sf_dir)
    batches = tn.deal_batches(seeded)
    return _with_points(seeded, batches)


def _with_points(seeded, batches):
    points = tn.borda_points(batches, _orderings(batches)).select(SET, ID, "listwise_points")
    joined = seeded.join(points, [SET, ID], "left")
    return materialise(joined.withColumn("listwise_points", F.coalesce("listwise_points", F.lit(0.0))))


@register("r11_swiss_rounds")
def r11(spark, sf_dir):
    ready = _ready(spark, sf_dir)
    return tn.swiss_rounds(ready, _judgments(ready))


@register(
    "r12_final_pairs",
    SEEDED + """, lead4 as (select * from (select *, row_number() over (partition by candidate_set_id order by rnd6(points + penalty) desc, listwise_points desc, seed) as rn from pts) where rn <= 4)
      select x.candidate_set_id, x.candidate_id as a, y.candidate_id as b from lead4 x join lead4 y on x.candidate_set_id = y.candidate_set_id and x.candidate_id < y.candidate_id
      where not exists (select 1 from jud j where j.candidate_set_id = x.candidate_set_id and j.a = x.candidate_id and j.b = y.candidate_id)""",
)
def r12(spark, sf_dir):
    ready = _ready(spark, sf_dir)
    judged = _judgments(ready)
    table = ready.join(tn.standings(judged), [SET, ID], "left").withColumn(
        "standing", F.round(F.coalesce("points", F.lit(0.0)) + F.col("penalty"), 6)
    )
    return tn.final_pairs(table, judged)


@register("r13_standings", SEEDED + "select * from st")
def r13(spark, sf_dir):
    return tn.standings(_judgments(_seeded(spark, sf_dir)))


@register(
    "r14_head_to_head",
    SEEDED + "select h.* from hh h semi join st using (candidate_set_id, candidate_id)",
)
def r14(spark, sf_dir):
    judged = _judgments(_seeded(spark, sf_dir))
    return tn.head_to_head(judged, tn.standings(judged))


@register(
    "r15_final_order",
    SEEDED + "select candidate_set_id, candidate_id, final_rank, adjusted_points, points, wins, losses, ties, head_to_head, listwise_points from ordered",
)
def r15(spark, sf_dir):
    ready = _ready(spark, sf_dir)
    return tn.final_order(ready, _judgments(ready)).select(
        SET, ID, "final_rank", "adjusted_points", "points", "wins", "losses", "ties", "head_to_head", "listwise_points"
    )


@register(
    "r16_emit_ranking",
    SEEDED + """, dead as (select *, row_number() over (partition by candidate_set_id order by scroll_stop desc, confidence desc, candidate_id) as i, count(*) over (partition by candidate_set_id) as dn from judged where not alive),
      alive_n as (select candidate_set_id, count(*) as an from ordered group by 1),
      em as (select candidate_set_id, candidate_id, final_rank as rank, 'ranked' as status, case when an <= 1 then 100.0e0 else rnd2(100.0e0 - 55.0e0 * ((final_rank - 1) / (an - 1))) end as display_score from ordered join alive_n using (candidate_set_id)
        union all select candidate_set_id, candidate_id, coalesce(an, 0) + i, case when hard_reject then 'rejected_critic' else 'rejected_editorial' end, case when dn <= 1 then 35.0e0 else rnd2(35.0e0 - 30.0e0 * ((i - 1) / (dn - 1))) end
        from dead left join alive_n using (candidate_set_id))
      select em.*, p.rank as previous_rank, p.rank - em.rank as rank_delta from em left join (select * from predictions where scorer = 'B') p using (candidate_set_id, candidate_id)""",
)
def r16(spark, sf_dir):
    survivors, rejected = _survivors(spark, sf_dir)
    seeded = tn.seed_order(survivors)
    ready = _with_points(seeded, tn.deal_batches(seeded))
    previous = derived.predictions(spark, sf_dir).where(F.col("scorer") == "B")
    return tn.emit_ranking(tn.final_order(ready, _judgments(ready)), rejected, previous)


@register("rerank")
def rerank(spark, sf_dir):
    seeded = _seeded(spark, sf_dir)
    previous = derived.predictions(spark, sf_dir).where(F.col("scorer") == "B")
    return rr.rerank(
        _shortlist(spark, sf_dir), cs.recovered(spark, sf_dir), cs.critic(spark, sf_dir),
        _orderings(tn.deal_batches(seeded)), _judgments(seeded), previous,
    )
