"""Evaluation queries over derived predictions and the given labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.operators import evaluation as ev
from clipspark.sources import derived

TOP = """
with top as (
  select p.candidate_set_id, p.scorer, p.candidate_id, p.rank, coalesce(o.human_score, 0) as rel, o.human_score, o.publishable
  from predictions p left join pool o using (candidate_set_id, candidate_id)
), ks as (select unnest([5, 10]) as k),
ideal as (
  select candidate_set_id, k, sum(case when human_score > 0 then (pow(2, human_score) - 1) / log2(pos + 1) else 0 end) as idcg
  from (select *, row_number() over (partition by candidate_set_id order by human_score desc) as pos from pool where human_score is not null)
  join ks on pos <= k group by all
), at_k as (
  select candidate_set_id, scorer, cast(k as bigint) as k,
    sum(case when rel > 0 then (pow(2, rel) - 1) / log2(rank + 1) else 0 end) as dcg,
    count(*) filter (where rel >= 3) as relevant, count(*) filter (where rel >= 4) as perfect,
    count(*) filter (where rel <= 2) as bad, count(*) filter (where publishable) as pub, avg(human_score) as mean
  from top join ks on rank <= k group by all
), m as (
  select a.candidate_set_id, a.scorer, a.k,
    case when idcg > 0 then rnd4(least(1.0e0, dcg / idcg)) else 0.0e0 end as ndcg,
    rnd4(relevant / a.k) as precision, rnd4(perfect / a.k) as perfect_rate, rnd4(bad / a.k) as bad_rate,
    rnd4(pub / a.k) as publishable_rate, coalesce(rnd3(mean), 0.0e0) as mean_human_score,
    case when relevant > 0 then 1.0e0 else 0.0e0 end as hit_rate, relevant as relevant_found
  from at_k a left join ideal i on i.candidate_set_id = a.candidate_set_id and i.k = a.k
)
"""


def _both(spark, sf_dir):
    return derived.predictions(spark, sf_dir), derived.pool(spark, sf_dir)


@register(
    "e1_dcg",
    """select candidate_set_id, scorer, rnd6(sum(case when human_score > 0 then (pow(2, human_score) - 1) / log2(rank + 1) else 0 end)) as dcg
       from predictions left join pool using (candidate_set_id, candidate_id) where rank <= 10 group by all""",
)
def dcg(spark, sf_dir):
    return ev.dcg(*_both(spark, sf_dir))


@register("e2_ndcg_at_k", TOP + "select candidate_set_id, scorer, k, ndcg from m")
def ndcg(spark, sf_dir):
    return ev.metrics_at_k(*_both(spark, sf_dir)).select("candidate_set_id", "scorer", "k", "ndcg")


@register(
    "e3_rates_at_k",
    TOP + "select candidate_set_id, scorer, k, precision, perfect_rate, bad_rate, publishable_rate from m",
)
def rates(spark, sf_dir):
    return ev.metrics_at_k(*_both(spark, sf_dir)).select(
        "candidate_set_id", "scorer", "k", "precision", "perfect_rate", "bad_rate", "publishable_rate"
    )


@register("e4_mean_score_at_k", TOP + "select candidate_set_id, scorer, k, mean_human_score from m")
def mean_score(spark, sf_dir):
    return ev.metrics_at_k(*_both(spark, sf_dir)).select("candidate_set_id", "scorer", "k", "mean_human_score")


@register(
    "e5_hit_rate_at_k",
    TOP.replace("unnest([5, 10])", "unnest([1, 3, 5])") + "select candidate_set_id, scorer, k, hit_rate from m",
)
def hit_rate(spark, sf_dir):
    preds, pool = _both(spark, sf_dir)
    return ev.metrics_at_k(preds, pool, (1, 3, 5)).select("candidate_set_id", "scorer", "k", "hit_rate")


RECALL = """, whole as (
  select candidate_set_id, count(*) as total, count(human_score) as labelled,
         count(*) filter (where human_score >= 3) as relevant_total from pool group by all)
select candidate_set_id, scorer, k,
  case when labelled = total and relevant_total > 0 then rnd4(relevant_found / relevant_total)
       when labelled = total then 0.0e0 end as recall,
  case when labelled <> total then printf('Recall requires 100%% labeled candidate pool (currently %d/%d labeled)', labelled, total)
       when relevant_total = 0 then 'No candidates in candidate pool met relevance threshold (human_score >= 3)' end as message
from m join whole using (candidate_set_id)"""


@register("e6_recall_at_k", TOP + RECALL)
def recall(spark, sf_dir):
    return ev.recall_at_k(*_both(spark, sf_dir))


@register(
    "e6_recall_at_k_fully_labelled",
    (TOP + RECALL)
    .replace("from predictions p left join pool o", "from ranked_labelled p left join labelled_pool o")
    .replace("from pool where human_score is not null", "from labelled_pool")
    .replace("from pool group by all", "from labelled_pool group by all")
    .replace(
        "with top as (",
        """with labelled_pool as (select * from pool where human_score is not null), ranked_labelled as (
  select * exclude (rank), row_number() over (partition by candidate_set_id, scorer order by rank) as rank
  from predictions semi join labelled_pool using (candidate_set_id, candidate_id)), top as (""",
    ),
)
def recall_full(spark, sf_dir):
    from clipspark.operators.ranking import number_by_score

    preds, pool = _both(spark, sf_dir)
    pool = pool.where(F.col("human_score").isNotNull())
    kept = preds.join(pool, ["candidate_set_id", "candidate_id"], "left_semi").drop("rank")
    return ev.recall_at_k(
        number_by_score(kept, ["candidate_set_id", "scorer"], "score", "candidate_id"), pool
    )


@register(
    "e7_shortlist_recall",
    """with listed as (select * from predictions where rank <= 20), whole as (
      select candidate_set_id, count(*) as total, count(*) filter (where human_score >= 4) as p, count(*) filter (where publishable) as u
      from pool group by all), got as (
      select candidate_set_id, scorer, count(*) as scored, count(*) filter (where human_score >= 4) as gp, count(*) filter (where publishable) as gu
      from listed left join pool using (candidate_set_id, candidate_id) group by all)
    select candidate_set_id, scorer, scored, rnd4(scored / total) as coverage, case when scored < total then scored end as shortlist_size,
      case when p > 0 then rnd4(gp / p) else 1.0e0 end as perfect_recall, case when u > 0 then rnd4(gu / u) else 1.0e0 end as publishable_recall
    from got join whole using (candidate_set_id)""",
)
def shortlist_recall(spark, sf_dir):
    preds, pool = _both(spark, sf_dir)
    return ev.shortlist_recall(preds.where(F.col("rank") <= 20), pool)


@register(
    "e8_compare_scorers",
    TOP + """, long as (unpivot (select candidate_set_id, scorer, k, ndcg, precision, perfect_rate, bad_rate, publishable_rate, mean_human_score, hit_rate from m)
      on ndcg, precision, perfect_rate, bad_rate, publishable_rate, mean_human_score, hit_rate into name metric value value)
    select candidate_set_id, metric, k, max(value) filter (where scorer = 'A') as A, max(value) filter (where scorer = 'B') as B
    from long group by all""",
)
def compare(spark, sf_dir):
    preds, pool = _both(spark, sf_dir)
    return ev.compare_scorers(preds, pool, ["A", "B"])


@register(
    "e9_score_distribution",
    """with s as (select candidate_set_id, scorer, min(score) as lo, max(score) as hi, count(*) as n,
      quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9]) as p, count(distinct score) as ur, count(distinct round(score, 2)) as ud,
      count(*) filter (where round(score, 2) = 0) as z, rnd2(stddev_pop(score)) as sd from predictions group by all)
    select candidate_set_id, scorer, round(lo, 2) as min, rnd2(p[1]) as p10, rnd2(p[2]) as p25, rnd2(p[3]) as median,
      rnd2(p[4]) as p75, rnd2(p[5]) as p90, round(hi, 2) as max, ur as unique_raw, ud as unique_rounded, z as zeros,
      sd as standard_deviation, nullif(concat_ws('; ',
        case when n >= 10 and ud < 10 then printf('Score collapse warning: only %d unique rounded scores among %d candidates', ud, n) end,
        case when sd < 2 then printf('Low variance warning: standard deviation is %.2f (expected spread across 0-100)', sd) end,
        case when z / n >= 0.3 then printf('Zero-score collapse warning: %d/%d (%.1f%%) candidates scored 0.0', z, n, z / n * 100) end), '') as warning
    from s""",
)
def distribution(spark, sf_dir):
    return ev.score_distribution(derived.predictions(spark, sf_dir))


@register(
    "e10_editorial_precision",
    """with j as (select p.*, o.human_score as h, coalesce(o.publishable, false) as pub,
        coalesce(editorial_class = 'REJECT', false) or coalesce(starts_with(status, 'rejected'), false) as rej,
        coalesce(editorial_class = 'STRONG', false) as strong, critic_result = 'REJECT' as crit
      from predictions p left join pool o using (candidate_set_id, candidate_id)),
    s as (select candidate_set_id, scorer, count(h) as labelled_predictions, count(*) filter (where rej) as reject_count,
      count(h) filter (where rej) as reject_labelled, count(h) filter (where rej and h <= 2) as rb,
      count(*) filter (where strong) as strong_count, count(h) filter (where strong) as strong_labelled,
      count(h) filter (where strong and (pub or h >= 4)) as sg, count(*) filter (where crit) as critic_reject_count,
      count(h) filter (where crit) as cl, count(h) filter (where crit and h <= 2) as cb, count(editorial_class) as classed from j group by all)
    select candidate_set_id, scorer, labelled_predictions, reject_count, reject_labelled,
      case when reject_labelled > 0 then rnd4(rb / reject_labelled) end as reject_precision, strong_count, strong_labelled,
      case when strong_labelled > 0 then rnd4(sg / strong_labelled) end as strong_precision, critic_reject_count,
      case when cl > 0 then rnd4(cb / cl) end as critic_reject_precision,
      nullif(concat_ws('; ', case when classed = 0 then 'No editorial_class fields found.' end,
        case when reject_count > 0 and reject_labelled = 0 then 'No REJECT decision has a human label; RejectPrecision is undefined.' end,
        case when strong_count > 0 and strong_labelled = 0 then 'No STRONG decision has a human label; StrongPrecision is undefined.' end), '') as message
    from s""",
)
def editorial(spark, sf_dir):
    return ev.editorial_precision(*_both(spark, sf_dir))


@register(
    "e10_class_agreement",
    """select candidate_set_id, scorer, editorial_class, count(*) as candidates, rnd3(avg(human_score)) as mean_human
       from predictions left join pool using (candidate_set_id, candidate_id) where editorial_class is not null group by all""",
)
def classes(spark, sf_dir):
    return ev.class_agreement(*_both(spark, sf_dir))


@register(
    "e11_label_summary",
    """select candidate_set_id, count(*) as total, count(human_score) as labelled,
      count(*) filter (where hook_score is not null or bad_start is not null) as dimension_labelled,
      count(*) filter (where human_score >= 3) as strong, count(*) filter (where human_score = 2) as borderline,
      count(*) filter (where human_score <= 1) as reject, count(*) filter (where publishable) as publishable_count,
      rnd3(avg(human_score)) as mean_human,
      count(*) filter (where round_even(human_score, 0) = 0) as h0, count(*) filter (where round_even(human_score, 0) = 1) as h1,
      count(*) filter (where round_even(human_score, 0) = 2) as h2, count(*) filter (where round_even(human_score, 0) = 3) as h3,
      count(*) filter (where round_even(human_score, 0) = 4) as h4,
      count(*) filter (where bad_start) as bad_start_count, count(*) filter (where bad_end) as bad_end_count,
      count(*) filter (where bad_start is not null or bad_end is not null) as boundary_labelled,
      count(human_score) = count(*) as complete,
      case when count(human_score) > 0 then rnd4(count(*) filter (where human_score >= 3) / count(human_score)) end as strong_rate,
      case when count(human_score) > 0 then rnd4(count(*) filter (where publishable) / count(human_score)) end as publishable_rate
    from pool group by all""",
)
def summary(spark, sf_dir):
    return ev.label_summary(derived.pool(spark, sf_dir))


@register(
    "e11_label_dimensions",
    """with long as (select candidate_set_id, f.n as field, f.v as value from (select candidate_set_id, unnest([{'n': 'hook_score', 'v': hook_score},
        {'n': 'standalone_score', 'v': standalone_score}, {'n': 'payoff_score', 'v': payoff_score}, {'n': 'value_score', 'v': value_score},
        {'n': 'context_dependency', 'v': context_dependency}]) as f from pool))
    select candidate_set_id, field, count(value) as labelled, rnd3(avg(value)) as mean, rnd3(median(value)) as median,
      count(*) filter (where round_even(value, 0) = 0) as h0, count(*) filter (where round_even(value, 0) = 1) as h1,
      count(*) filter (where round_even(value, 0) = 2) as h2, count(*) filter (where round_even(value, 0) = 3) as h3,
      count(*) filter (where round_even(value, 0) = 4) as h4 from long group by all""",
)
def dimensions(spark, sf_dir):
    return ev.label_dimensions(derived.pool(spark, sf_dir))


@register(
    "e12_disagreements",
    """with a as (select * from predictions where scorer = 'A'), b as (select * from predictions where scorer = 'B')
    select a.candidate_set_id, a.candidate_id, 'false_positive' as disagreement_type, human_score, a.rank as model_rank, a.score as model_score,
      cast(null as bigint) as model_b_rank, cast(null as double) as model_b_score, cast(null as bigint) as rank_gap
    from a join pool using (candidate_set_id, candidate_id) where rank <= 5 and human_score <= 1
    union all
    select o.candidate_set_id, o.candidate_id, 'false_negative', o.human_score, a.rank, a.score, null, null, null
    from pool o left join a using (candidate_set_id, candidate_id) where o.human_score >= 3 and (a.rank is null or a.rank > 5)
    union all
    select a.candidate_set_id, a.candidate_id, 'scorer_divergence', o.human_score, a.rank, a.score, b.rank, b.score, abs(a.rank - b.rank)
    from a join b using (candidate_set_id, candidate_id) left join pool o using (candidate_set_id, candidate_id) where abs(a.rank - b.rank) >= 3""",
)
def disagreements(spark, sf_dir):
    preds, pool = _both(spark, sf_dir)
    return ev.disagreements(preds, pool, "A", "B")


CASES = """with cases as (
  select case when doc_id % 17 = 0 then 'elsewhere' else source end as candidate_set_id,
    case when doc_id % 19 = 0 then -doc_id - 1 else doc_id end as candidate_id,
    ['rank_up', 'rank_down', 'in_top_k', 'out_of_top_k', 'rejected', 'other'][1 + doc_id % 6] as expectation,
    case when doc_id % 2 = 0 then 10 end as k
  from labels join documents using (doc_id)
), item as (select *, true as found from predictions where scorer = 'A'), known as (select distinct candidate_set_id, true as known from item),
r as (select c.*, known, found, rank, previous_rank as prev, status, coalesce(status, 'None') as shown, coalesce(k, 5) as kk,
        status is null or status = 'ranked' as ok
  from cases c left join known using (candidate_set_id) left join item using (candidate_set_id, candidate_id)),
checked as (select candidate_set_id, candidate_id, expectation,
  case when known is null then null when found is null then false
    when expectation in ('rank_up', 'rank_down') and prev is null then false
    when expectation = 'rank_up' then rank < prev when expectation = 'rank_down' then rank > prev
    when expectation = 'in_top_k' then rank <= kk and ok when expectation = 'out_of_top_k' then rank > kk or not ok
    when expectation = 'rejected' then coalesce(starts_with(status, 'rejected'), false) else false end as passed,
  case when known is null then 'Skipped: another candidate set.'
    when found is null then 'Candidate is absent from the prediction document (not scored).'
    when expectation = 'rank_up' and prev is null then 'No previous rank recorded; cannot verify upward movement.'
    when expectation = 'rank_down' and prev is null then 'No previous rank recorded; cannot verify downward movement.'
    when expectation in ('rank_up', 'rank_down') then printf('Moved from #%d to #%d.', prev, rank)
    when expectation in ('in_top_k', 'out_of_top_k') then printf('Rank #%d against K=%d (status=%s).', rank, kk, shown)
    when expectation = 'rejected' then 'Status is ' || shown || '.' else 'Unknown expectation ''' || expectation || '''.' end as message,
  case when known then rank end as new_rank, known is null as skipped from r)
"""


def _checked(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("rank_up", "rank_down", "in_top_k", "out_of_top_k", "rejected", "other")])
    cases = derived.table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.when(i % 17 == 0, "elsewhere").otherwise(F.col("source")).alias("candidate_set_id"),
        F.when(i % 19 == 0, -i - 1).otherwise(i).alias("candidate_id"),
        F.get(kinds, (i % 6).cast("int")).alias("expectation"),
        F.when(i % 2 == 0, 10).alias("k"),
    )
    return ev.regression_check(cases, derived.predictions(spark, sf_dir).where(F.col("scorer") == "A"))


@register("e13_regression_check", CASES + "select * from checked")
def regression(spark, sf_dir):
    return _checked(spark, sf_dir)


@register(
    "e13_regression_totals",
    CASES + """select candidate_set_id, count(*) filter (where not skipped) as total, count(*) filter (where passed) as passed,
      count(*) filter (where not skipped and not passed) as failed, count(*) filter (where skipped) as skipped from checked group by all""",
)
def regression_totals(spark, sf_dir):
    return ev.regression_totals(_checked(spark, sf_dir))


@register(
    "e14_derive_regressions",
    """with r as (select p.*, o.human_score as h, coalesce(status, 'ranked') <> 'ranked' as rej
      from predictions p join pool o using (candidate_set_id, candidate_id) where o.human_score is not null),
    g as (select *, case when h >= 4 and (rank > 5 or rej) then 'strong_positives' when h <= 2 and rank <= 5 and not rej then 'false_positives'
        when h >= 3 and rej then 'false_negatives' end as case_group from r)
    select candidate_set_id, scorer, candidate_id, h as human_score, case_group,
      case when case_group = 'false_positives' then 'out_of_top_k' else 'in_top_k' end as expectation, cast(5 as bigint) as k
    from g where case_group is not null""",
)
def derive(spark, sf_dir):
    return ev.derive_regressions(*_both(spark, sf_dir))
