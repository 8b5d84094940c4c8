"""Formula, blend and stored-response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import register
from clipspark.operators import responses as rs
from clipspark.operators import scoring as sc
from clipspark.sources import derived

KEYS = ["candidate_set_id", "candidate_id"]


def _answer(body: str, n: str) -> str:
    """SQL twin of the derived answers: some broken, some fenced, some chatty."""
    text = f"case when {n} % 11 = 0 then left({body}, length({body}) - 1) else {body} end"
    return (
        f"case when {n} % 3 = 0 then '```json' || chr(10) || ({text}) || chr(10) || '```' "
        f"when {n} % 5 = 0 then 'Sure! ' || ({text}) || ' Done.' else ({text}) end"
    )


def _yes(k: int) -> str:
    return f"case when doc_id % {k} = 0 then 'true' else 'false' end"


def _pick(*options: str) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + f"][1 + doc_id % {len(options)}]"


def _object(fields: list[tuple[str, str]], tail: str = "''") -> str:
    parts = [f"'{', ' if n else ''}\"{name}\": ' || ({value})" for n, (name, value) in enumerate(fields)]
    return "'{' || " + " || ".join(parts) + f" || {tail} || '}}'"


def _pct(k: int) -> str:
    return f"doc_id * {k} % 101"


EDITORIAL = _object(
    [
        ("editorial_class", "'\"' || case when cast(source[4:] as bigint) % 4 = 0 and doc_id % 8 <> 0 then 'fatal_reject' else "
         + _pick("STRONG", "good", "MAYBE", "WEAK", "REJECT", "odd", "") + " end || '\"'"),
        ("scroll_stop", _pct(31)), ("context_dependency", _pct(17)), ("dead_air", f"'\"' || {_pct(7)} || '\"'"),
        ("salvageable", "case when doc_id % 5 = 0 then '\"yes\"' else 'false' end"),
        ("best_internal_moment_present", _yes(6)), ("needs_more_setup", _yes(2)), ("needs_boundary_refinement", _yes(3)),
        ("payoff_inside_candidate", _yes(10)), ("standalone_after_refinement_probability", _pct(13)),
        ("quality_penalty", "doc_id % 20"),
        ("fatal_reject_evidence", _pick('["dead air", " "]', "[]", '["dead air"]', '"payoff lies outside, nothing useful"')),
        ("reason_to_watch", _pick("null", '"They continue talking about it all day"', '"Short one"',
                                  '"A host falls off the chair mid sentence"', '"n/a"')),
        ("reject_reasons", "case when doc_id % 9 = 0 then '[\"too slow\", \"\"]' else '[]' end"),
        ("confidence", _pct(7)),
    ]
)
CRITIC = _object(
    [
        ("decision", "'\"' || " + _pick("keep", "REJECT", "", "maybe", "no") + " || '\"'"),
        ("reason", "'\" because ' || doc_id || '\"'"),
        ("confidence", _pct(37)), ("hard_reject", _yes(2)),
        ("failure_modes", _pick('["severe asr errors", "no visual value"]', '"duplicate"', "[]")),
    ],
    f"case when doc_id % 4 <> 0 then ', \"keep_for_comparison\": ' || ({_yes(7)}) || ', \"penalty\": ' || (doc_id % 30) else '' end",
)
MULTI = _object(
    [
        ("observable_event", _yes(2)), ("visual_payoff", "case when doc_id % 19 = 0 then '\"unsure\"' else 'true' end"),
        *[(n, _pct(k)) for k, n in enumerate(
            ("visual_event", "reaction", "emotion", "humor", "surprise", "energy", "standalone", "shareability",
             "context_dependency", "quality_score"), start=11)],
        ("boringness", "case when doc_id % 13 = 0 then 150 else 100 - doc_id * 3 % 40 end"),
        ("retention", "case when doc_id % 17 = 0 then 'null' else cast(doc_id % 60 as varchar) end"),
        ("outside_payoff", _yes(3)), ("missing_setup", _yes(4)), ("insufficient_visual_evidence", _yes(5)),
        ("confidence", "(doc_id % 100) / 100.0e0"), ("reason", "'\"seen\"'"),
    ]
)


def _responses(body: str) -> str:
    return f"""select source as candidate_set_id, doc_id as candidate_id, {_answer('b', 'doc_id')} as raw
      from (select source, doc_id, {body} as b from documents where doc_id % 23 <> 0)"""


def _parsed(name: str, keys: str, source: str) -> str:
    """CTEs ``name``: parsed body ``j`` (null if unusable) and ``err``."""
    return f"""{name}0 as ({source}),
  {name}1 as (select *, trim(regexp_replace(regexp_replace(trim(raw), '^```(?:json)?\\s*', ''), '\\s*```$', '')) as t from {name}0),
  {name}2 as (select *, case when json_valid(t) then t when strpos(t, '{{') > 0 and strpos(t, '}}') > 0 and length(t) - strpos(reverse(t), '}}') + 1 > strpos(t, '{{')
      then t[strpos(t, '{{'):length(t) - strpos(reverse(t), '}}') + 1] end as u from {name}1),
  {name} as (select {keys}, case when json_valid(u) then case when json_type(u) = 'OBJECT' then u end end as j,
    case when t = '' then 'Empty model response' when json_valid(u) then case when json_type(u) = 'OBJECT' then null else 'Expected a JSON object' end else 'Response is not JSON' end as err from {name}2)"""


def _str(*names: str) -> str:
    return "coalesce(" + ", ".join(f"(j ->> '$.{n}')" for n in names) + ")"


def _num(*names: str) -> str:
    return f"try_cast({_str(*names)} as double)"


def _unit(*names: str) -> str:
    n = _num(*names)
    return f"case when {n} is null then 0.0e0 else greatest(0.0e0, least(1.0e0, case when {n} > 1 then {n} / 100 else {n} end)) end"


def _penalty(names: tuple[str, ...], default: str) -> str:
    n = _num(*names)
    return f"case when {n} is null then {default} else greatest(-100.0e0, least(0.0e0, -abs({n}))) end"


def _bool(names: tuple[str, ...] | str, default: str = "false") -> str:
    names = (names,) if isinstance(names, str) else names
    s = f"lower(trim({_str(*names)}))"
    return f"case when {s} in ('true', 'yes', '1') then true when {s} in ('false', 'no', '0') then false else {default} end"


def _list(*names: str, limit: int = 8) -> str:
    s = _str(*names)
    return (
        f"coalesce(case when starts_with({s}, '[') then list_filter(list_transform(from_json({s}, '[\"VARCHAR\"]'), lambda x: trim(x)), lambda x: x <> '')[:{limit}] "
        f"when trim({s}) <> '' then [trim({s})] end, [])"
    )


def _fatal(e: str) -> str:
    e = f"lower({e})"
    named = " or ".join(f"contains({e}, '{p}')" for p in rs.FATAL_PHRASES)
    return (
        f"({named} or (contains({e}, 'payoff') and contains({e}, 'outside') and (contains({e}, 'no useful') or contains({e}, 'nothing')))"
        f" or ((contains({e}, 'severe') or contains({e}, 'unintelligible')) and (contains({e}, 'transcript') or contains({e}, 'asr'))"
        f" and (contains({e}, 'no visual') or contains({e}, 'no useful visual'))))"
    )


VAGUE = " or ".join("regexp_matches(lower(reason_to_watch), '" + p + "')" for p in rs.VAGUE_REASONS)
TABLE = "with " + _parsed("p", "candidate_set_id, candidate_id", _responses(EDITORIAL)) + f""",
  e0 as (select d.source as candidate_set_id, d.doc_id as candidate_id, j, err, upper(trim(coalesce({_str('editorial_class')}, ''))) as rawc from documents d left join p on p.candidate_id = d.doc_id),
  ed as (select candidate_set_id, candidate_id,
     case when j is null then 'WEAK' when rawc in ('REJECT', 'FATAL_REJECT') then 'FATAL_REJECT' when rawc in ('WEAK', 'MAYBE', 'GOOD', 'STRONG') then rawc else 'WEAK' end as cls,
     rnd6({_unit('scroll_stop')}) as scroll_stop, rnd6({_unit('context_dependency')}) as context_dependency, rnd6({_unit('dead_air')}) as dead_air,
     {_bool('salvageable', "not coalesce(rawc in ('REJECT', 'FATAL_REJECT') and j is not null, false)")} as salvageable, {_bool('best_internal_moment_present')} as internal_moment,
     {_bool('needs_more_setup')} as needs_more_setup, {_bool('needs_boundary_refinement')} as needs_refinement, {_bool('payoff_inside_candidate')} as payoff_inside,
     rnd6({_unit('standalone_after_refinement_probability')}) as standalone_probability,
     {_penalty(('quality_penalty', 'penalty'), '0.0e0')} as pen,
     coalesce(array_to_string({_list('fatal_reject_evidence', 'fatal_evidence')}, ' '), '') as fatal_evidence,
     case when lower(trim({_str('reason_to_watch')})) not in ('', 'null', 'none', 'n/a', '-') then trim({_str('reason_to_watch')}) end as reason_to_watch,
     {_list('reject_reasons')} || case when j is not null and rawc <> '' and rawc not in ('FATAL_REJECT', 'WEAK', 'MAYBE', 'GOOD', 'STRONG', 'REJECT')
        then ['unrecognized editorial_class ''' || rawc || ''' treated as WEAK'] else [] end as reasons,
     rnd6({_unit('confidence')}) as confidence, j is null as parse_failed, case when j is null then coalesce(err, 'no response stored') end as error from e0),
  g0 as (select *, least(pen, greatest(-40.0e0, (case when needs_more_setup then -10.0e0 else 0 end) + (case when needs_refinement then -5.0e0 else 0 end)
        + (case when context_dependency > 0.5e0 then -20.0e0 * (context_dependency - 0.5e0) else 0 end) + (case when internal_moment and not payoff_inside then -5.0e0 else 0 end))) as pen2,
     not parse_failed and cls = 'FATAL_REJECT' as fatal,
     not parse_failed and cls = 'FATAL_REJECT' and (salvageable or internal_moment or payoff_inside or not {_fatal('fatal_evidence')}) as unfounded,
     not parse_failed and cls <> 'FATAL_REJECT' and (reason_to_watch is null or len(regexp_split_to_array(trim(reason_to_watch), '\\s+')) < 4 or {VAGUE}) as vague from ed),
  ga as (select * exclude (cls, reasons, pen), case when unfounded or vague then 'WEAK' else cls end as cls, unfounded as recovered,
     rnd6(case when parse_failed then pen when unfounded then least(pen2, -30.0e0) when vague then least(pen2, -25.0e0) else pen2 end) as pen,
     reasons || (case when fatal and len(reasons) = 0 then ['model rejected without naming a reason'] else [] end)
       || (case when unfounded then ['fatal rejection downgraded: source window contains recoverable evidence'] else [] end)
       || (case when vague then [case when reason_to_watch is null then 'no reason to watch was produced' else 'reason to watch describes continuation, not a concrete moment' end] else [] end) as reasons from g0),
  cn as (select candidate_set_id, count(*) as n, count(*) filter (where cls <> 'FATAL_REJECT') as alive, count(*) filter (where cls = 'FATAL_REJECT' or recovered) as claims from ga group by 1),
  qu as (select candidate_set_id, case when n >= 4 and (alive < greatest(2, ceil(n * 0.25)) or claims >= ceil(n * 0.75)) then greatest(0, least(16, greatest(2, ceil(n * 0.25))) - alive) else 0 end as quota from cn),
  rk as (select candidate_set_id, candidate_id, row_number() over (partition by candidate_set_id order by internal_moment desc, payoff_inside desc, salvageable desc,
        standalone_probability desc, scroll_stop desc, dead_air, candidate_id) as rn from ga
     where cls = 'FATAL_REJECT' and not (not salvageable and not internal_moment and not payoff_inside and {_fatal('fatal_evidence')} and confidence >= 0.85e0)),
  rec as (select ga.* exclude (cls, pen, recovered, reasons), coalesce(rn <= quota, false) as back, case when coalesce(rn <= quota, false) then case when salvageable or internal_moment or payoff_inside then 'MAYBE' else 'WEAK' end else cls end as cls,
     case when coalesce(rn <= quota, false) then least(pen, -35.0e0) else pen end as pen, recovered or coalesce(rn <= quota, false) as recovered,
     reasons || case when coalesce(rn <= quota, false) then ['recovered after pathological rejection distribution'] else [] end as reasons
    from ga left join rk using (candidate_set_id, candidate_id) left join qu using (candidate_set_id))
"""

LOGPROBS = """with alt as (select doc_id as candidate_id, unnest([{'t': case when doc_id % 7 = 0 then 'hm' else ' Yes.' end, 'l': -(doc_id % 50) / 10.0e0},
  {'t': case when doc_id % 7 = 0 then 'er' else 'no' end, 'l': -(doc_id % 13) / 10.0e0}, {'t': case when doc_id % 7 = 0 then 'um' else 'YES' end, 'l': -(doc_id % 29) / 10.0e0},
  {'t': 'maybe', 'l': -(doc_id % 3) / 10.0e0}]) as a from documents),
n as (select candidate_id, lower(regexp_replace(a.t, '[^A-Za-z]', '', 'g')) as t, exp(a.l) as p from alt)
"""


@register(
    "c2_score_v2",
    """with f as (select source, candidate_id, coalesce(retention, 50.0e0) as retention, coalesce(llm_quality_score, 50.0e0) as q, * exclude (source, candidate_id, retention) from features),
    s as (select *, (story_payoff * 1.4e0 + retention * 1.4e0 + hook * 1.2e0 + standalone * 1.1e0 + shareability * 1.0e0 + humor * 0.8e0 + surprise * 0.8e0 + emotion * 0.7e0) / 8.4e0 as pos,
      greatest(0.0e0, boringness - 35) * 0.7e0 + greatest(0.0e0, context_dependency - 35) * 0.5e0 + (case when setup_only then 25.0e0 else 0 end)
        + (case when transitional then 30.0e0 else 0 end) + (case when outside_payoff then 20.0e0 else 0 end) as pen from f)
    select source, candidate_id, rnd2(greatest(0.0e0, least(0.75e0 * greatest(0.0e0, pos - pen) + 0.25e0 * q,
      case when transitional or boringness >= 75 then 35.0e0 when setup_only or context_dependency >= 75 then 40.0e0 when outside_payoff then 45.0e0 else 100.0e0 end))) as score from s""",
)
def c2(spark, sf_dir):
    return sc.score_v2(derived.features(spark, sf_dir)).select("source", "candidate_id", "score")


V21 = """with s as (select *, hook * 0.12e0 + standalone * 0.14e0 + story_payoff * 0.18e0 + emotion * 0.08e0 + humor * 0.10e0 + surprise * 0.08e0 + retention * 0.18e0 + shareability * 0.12e0 as pos,
  boringness * 0.25e0 + context_dependency * 0.12e0 + ((case when setup_only then 15.0e0 else 0 end) + (case when transitional then 12.0e0 else 0 end)) as pen,
  setup_only and story_payoff < 30 as c1, transitional and retention < 30 as c2, boringness >= 85 and story_payoff < 25 as c3 from features where retention is not null)
"""


@register(
    "c3_score_v2_1",
    V21 + """select source, candidate_id, rnd2(greatest(0.0e0, least(pos - pen, case when c3 then 30.0e0 when c2 then 35.0e0 when c1 then 40.0e0 else 100.0e0 end))) as score,
      concat_ws(',', case when c1 then 'setup_only_low_payoff:40' end, case when c2 then 'transitional_low_retention:35' end, case when c3 then 'extreme_boringness:30' end) as applied_caps from s""",
)
def c3(spark, sf_dir):
    return sc.score_v2_1(derived.features(spark, sf_dir))[0].select("source", "candidate_id", "score", "applied_caps")


@register("c3_score_v2_1_rejected", "select source, candidate_id, 'retention' as missing from features where retention is null")
def c3_rejected(spark, sf_dir):
    return sc.score_v2_1(derived.features(spark, sf_dir))[1].select("source", "candidate_id", "missing")


@register(
    "c4_score_logprob",
    LOGPROBS + """select candidate_id, rnd4(sum(case t when 'yes' then 100.0e0 * p when 'no' then 0.0e0 end) / nullif(sum(case when t in ('yes', 'no') then p end), 0)) as score from n group by 1""",
)
def c4(spark, sf_dir):
    return sc.score_logprob(derived.top_logprobs(spark, sf_dir), sc.BINARY_VALUES)


RANKS = """with c as (select source, doc_id, n_chars as av, (doc_id * 37) % 101 as bv from documents),
r as (select *, count(*) over (partition by source) as n,
  rank() over (partition by source order by av) - 1 + (count(*) over (partition by source, av) - 1) / 2.0e0 as ra,
  rank() over (partition by source order by bv) - 1 + (count(*) over (partition by source, bv) - 1) / 2.0e0 as rb from c),
f as (select source, doc_id, case when n = 1 then 0.5e0 else ra / (n - 1) end as a_rank, case when n = 1 then 0.5e0 else rb / (n - 1) end as b_rank from r)
"""


def _two_values(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.col("n_chars").alias("av"), (F.col("doc_id") * 37 % 101).alias("bv")
    )


@register("c5_rank_fraction", RANKS + "select source, doc_id, rnd6(a_rank) as fraction from f")
def c5(spark, sf_dir):
    out = sc.rank_fraction(_two_values(spark, sf_dir), "av", ["source"], "fraction")
    return out.select("source", "doc_id", F.round("fraction", 6).alias("fraction"))


@register("c6_blend_ranks", RANKS + "select source, doc_id, rnd4((0.4e0 * a_rank + 0.6e0 * b_rank) * 100.0e0) as score from f")
def c6(spark, sf_dir):
    return sc.blend_ranks(_two_values(spark, sf_dir), "av", "bv", ["source"]).select("source", "doc_id", "score")


def _mm_accept() -> str:
    """Accepted multimodal answers with typed fields."""
    ok = " and ".join(f"coalesce({_num(n)} between 0 and 100, false)" for n in rs.PERCENT_FIELDS)
    return "with " + _parsed("p", "candidate_set_id, candidate_id", _responses(MULTI)) + f""",
   ok as (select * from p where j is not null and {ok} and coalesce({_num('confidence')} between 0 and 1, false)
     and coalesce(lower(trim({_str('observable_event')})) in ('true', 'false'), false) and coalesce(lower(trim({_str('visual_payoff')})) in ('true', 'false'), false)
     and {_str('reason')} is not null)
"""


@register(
    "c7_score_multimodal",
    _mm_accept() + f""", x as (select candidate_id, {_num('quality_score')} as q, {_num('boringness')} >= 85 and {_num('retention')} <= 25 as a,
       {_bool('outside_payoff')} and {_str('observable_event')} = 'false' as b, {_bool('missing_setup')} and {_num('context_dependency')} >= 80 as c,
       candidate_id % 4 = 0 or {_bool('insufficient_visual_evidence')} as thin, {_num('confidence')} as conf from ok),
     y as (select *, case when a then least(q, 35.0e0) else q end as s1 from x), z as (select *, case when b then least(s1, 40.0e0) else s1 end as s2 from y)
     select candidate_id, rnd2(case when c then least(s2, 45.0e0) else s2 end) as score, case when thin then greatest(0.2e0, least(conf, 0.4e0)) else conf end as effective_confidence,
       concat_ws(',', case when a and q > 35 then 'boring_low_retention_cap:35.0' end, case when b and s1 > 40 then 'outside_payoff_unobservable_cap:40.0' end,
         case when c and s2 > 45 then 'missing_setup_context_cap:45.0' end,
         case when thin then printf('insufficient_visual_evidence_confidence_lowered:%.2f', greatest(0.2e0, least(conf, 0.4e0))) end) as applied_caps from z""",
)
def c7(spark, sf_dir):
    accepted, _ = rs.multimodal_table(derived.responses(spark, sf_dir, "multimodal"), KEYS)
    packages = derived.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("candidate_id"), (F.col("doc_id") % 4 == 0).alias("insufficient")
    )
    return sc.score_multimodal(accepted, packages)


FALLBACK = """with h as (select source, doc_id, cast(n_chars % 101 as double) as hs from documents),
p as (select doc_id, case when doc_id % 6 <> 0 then cast((doc_id * 37) % 101 as double) end as ps, case when doc_id % 6 = 0 then 'timeout ' || doc_id % 4 end as err from documents where doc_id % 10 <> 0),
f as (select source, doc_id, case when ps is not null then ps else hs end as score, ps is null as fallback_used, case when ps is null then coalesce(err, 'no primary result') end as fallback_reason from h left join p using (doc_id))
"""


def _fallback(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    i = F.col("doc_id")
    primary = docs.where(i % 10 != 0).select(
        "source", "doc_id", F.when(i % 6 != 0, (i * 37 % 101).cast("double")).alias("score"),
        F.when(i % 6 == 0, F.concat(F.lit("timeout "), (i % 4).cast("string"))).alias("error"),
    )
    heuristic = docs.select("source", "doc_id", (F.col("n_chars") % 101).cast("double").alias("score"))
    return sc.with_fallback(primary, heuristic, ["source", "doc_id"])


@register("c8_with_fallback", FALLBACK + "select * from f")
def c8(spark, sf_dir):
    return _fallback(spark, sf_dir)


@register(
    "c8_fallback_summary",
    FALLBACK + """select source, bool_or(fallback_used) as any_fallback, count(*) filter (where fallback_used) as fallbacks,
      arg_min(fallback_reason, doc_id) filter (where fallback_used) as first_reason from f group by 1""",
)
def c8_summary(spark, sf_dir):
    return sc.fallback_summary(_fallback(spark, sf_dir), "source", "doc_id")


@register(
    "c9_parse_responses",
    "with " + _parsed("p", "candidate_set_id, candidate_id", _responses(EDITORIAL))
    + f" select candidate_id, j is not null as usable, err as error, {_str('editorial_class')} as editorial_class, {_str('fatal_reject_evidence')} is not null as has_evidence from p",
)
def c9(spark, sf_dir):
    return rs.parse_responses(derived.responses(spark, sf_dir, "editorial")).select(
        "candidate_id",
        F.col("body").isNotNull().alias("usable"),
        "error",
        F.try_element_at("body", F.lit("editorial_class")).alias("editorial_class"),
        F.try_element_at("body", F.lit("fatal_reject_evidence")).isNotNull().alias("has_evidence"),
    )


SHOWN = """candidate_set_id, candidate_id, cls as editorial_class, scroll_stop, context_dependency, dead_air, salvageable, internal_moment, needs_more_setup,
  needs_refinement, payoff_inside, standalone_probability, pen as quality_penalty, fatal_evidence, reason_to_watch, array_to_string(reasons, '; ') as reject_reasons, confidence, parse_failed, error"""
COLS = ["candidate_set_id", "candidate_id", "editorial_class", "scroll_stop", "context_dependency", "dead_air", "salvageable",
        "internal_moment", "needs_more_setup", "needs_refinement", "payoff_inside", "standalone_probability", "quality_penalty",
        "fatal_evidence", "reason_to_watch", "reject_reasons", "confidence", "parse_failed", "error"]


def _flat(df, *more):
    return df.withColumn("reject_reasons", F.array_join("reject_reasons", "; ")).select(*COLS, *more)


def _cands(spark, sf_dir):
    return derived.table(spark, sf_dir, "documents").select(
        F.col("source").alias("candidate_set_id"), F.col("doc_id").alias("candidate_id")
    )


def editorial(spark, sf_dir):
    return rs.editorial_table(_cands(spark, sf_dir), derived.responses(spark, sf_dir, "editorial"), KEYS)


def recovered(spark, sf_dir):
    return rs.recover_rejections(rs.editorial_gates(editorial(spark, sf_dir)), "candidate_set_id", "candidate_id")


@register("c10_editorial_table", TABLE + f"select {SHOWN} from ed")
def c10(spark, sf_dir):
    return _flat(editorial(spark, sf_dir))


@register("c11_editorial_gates", TABLE + f"select {SHOWN}, recovered from ga")
def c11(spark, sf_dir):
    return _flat(rs.editorial_gates(editorial(spark, sf_dir)), "recovered")


@register("c12_recover_rejections", TABLE + f"select {SHOWN}, recovered from rec")
def c12(spark, sf_dir):
    return _flat(recovered(spark, sf_dir), "recovered")


CRITIC_SQL = (
    _parsed("c", "candidate_set_id, candidate_id", _responses(CRITIC))
    + f""",
   k0 as (select d.source as candidate_set_id, d.doc_id as candidate_id, j, err, upper(trim(coalesce({_str('decision')}, ''))) as rawc from documents d left join c on c.candidate_id = d.doc_id),
   cr as (select candidate_set_id, candidate_id, coalesce(j is not null and {_bool(('hard_reject', 'fatal_reject'))} and not ({_bool('keep_for_comparison', 'true')})
        and {_fatal("array_to_string(" + _list('failure_modes') + ", ' ') || ' ' || array_to_string(" + _list('fatal_evidence', 'fatal_reject_evidence') + ", ' ')")} and {_unit('confidence')} >= 0.85e0, false) as hard_reject,
      case when j is not null then rnd6({_unit('confidence')}) else 0.0e0 end as confidence,
      case when j is not null then {_penalty(('penalty', 'critic_penalty'), "case when rawc in ('REJECT', 'NO', 'FALSE', 'CUT', 'DROP') then -30.0e0 else 0.0e0 end")} else 0.0e0 end as penalty,
      case when j is not null then trim(coalesce({_str('reason')}, '')) when err is not null then 'Critic unavailable; candidate retained.' else 'Critic skipped: no response stored.' end as reason,
      j is null or rawc not in ('', 'KEEP', 'REJECT', 'YES', 'TRUE', 'PUBLISH', 'NO', 'FALSE', 'CUT', 'DROP')
        or (rawc = '' and not (json_exists(j, '$.penalty') or json_exists(j, '$.critic_penalty') or json_exists(j, '$.failure_modes') or json_exists(j, '$.keep_for_comparison'))) as parse_failed from k0)
"""
)


def critic(spark, sf_dir):
    return rs.critic_table(_cands(spark, sf_dir), derived.responses(spark, sf_dir, "critic"), KEYS)


@register("c13_critic_table", "with " + CRITIC_SQL + "select *, case when hard_reject then 'REJECT' else 'KEEP' end as decision from cr")
def c13(spark, sf_dir):
    return critic(spark, sf_dir)


@register(
    "c14_package_hashes",
    """with clips as (select source_id, start_ms // 45000 as candidate_seq, min(start_ms) as start_ms, min(start_ms) + 60000 as end_ms from segments group by 1, 2),
    p as (select source_id, candidate_seq, sha256('package_v1_1:set:' || source_id || ':' || candidate_seq || ':' || start_ms || ':' || end_ms || ':768')[:16] as package_hash from clips)
    select source_id, candidate_seq, package_hash, sha256(package_hash || ':mock:m1:p1:s2:none:0.2000')[:16] as request_hash from p""",
)
def c14(spark, sf_dir):
    packed = sc.package_hashes(derived.clips(spark, sf_dir).withColumn("candidate_set_id", F.lit("set")))
    return sc.request_hashes(packed, "mock", "m1", "p1", "s2", None, 0.2).select(
        "source_id", "candidate_seq", "package_hash", "request_hash"
    )


@register(
    "c15_usage_report",
    """with c as (select case user_id % 3 when 0 then 'gpt-4o-mini' when 1 then 'gpt-4o' else 'other' end as model, event_type as stage, event_id % 1000 as ti, event_id % 77 as t_o,
       event_id % 5 = 0 as cached, event_id % 7 = 0 as failed from events),
    s as (select model, coalesce(stage, 'ALL') as stage, count(*) filter (where not cached and not failed) as calls, cast(coalesce(sum(ti) filter (where not cached and not failed), 0) as bigint) as tokens_in,
       cast(coalesce(sum(t_o) filter (where not cached and not failed), 0) as bigint) as tokens_out, count(*) filter (where cached) as cache_hits, count(*) filter (where failed and not cached) as failed_calls
      from c group by rollup(model, stage) having model is not null)
    select *, tokens_in + tokens_out as tokens_total, rnd6(case model when 'gpt-4o-mini' then tokens_in * 0.15e0 / 1000000 + tokens_out * 0.6e0 / 1000000
       when 'gpt-4o' then tokens_in * 2.5e0 / 1000000 + tokens_out * 10.0e0 / 1000000 else 0.0e0 end) as estimated_cost_usd from s""",
)
def c15(spark, sf_dir):
    e = F.col("event_id")
    calls = derived.table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 == 0, "gpt-4o-mini").when(F.col("user_id") % 3 == 1, "gpt-4o").otherwise("other").alias("model"),
        F.col("event_type").alias("stage"), (e % 1000).alias("tokens_in"), (e % 77).alias("tokens_out"),
        (e % 5 == 0).alias("cached"), (e % 7 == 0).alias("failed"),
    )
    return rs.usage_report(calls)


CH = "ch as (select source_id, start_ms // 240000 as chapter from segments group by 1, 2)"
CHAPTER_BODY = """'{"summary": " s' || n || ' ", "topic": "t' || n % 5 || '", "participants": ["a", " ", "b"], "events": ["e1", "e2", "e3", "e4", "e5", "e6", "e7", "e8", "e9", "e10", "e11", "e12", "e13", "e14", "e15"], "setups": "one", "payoffs": []}'"""
SOURCE_BODY = """'{"video_summary": "v' || n || '", "content_type": "' || ['Stream', 'interview', 'show', '', 'GAME'][1 + n % 5] || '", "main_topics": ["x", "y' || n % 4 || '"], "conflicts": "c"}'"""


def _l12(name: str) -> str:
    return f"coalesce(array_to_string({_list(name, limit=12)}, '|'), '')"


@register(
    "c16_chapter_contexts",
    f"with {CH}, "
    + _parsed("p", "source_id, chapter", f"select source_id, chapter, {_answer('b', 'n')} as raw from (select *, {CHAPTER_BODY} as b from (select *, source_id * 7 + chapter as n from ch) where n % 13 <> 0)")
    + f""" select source_id, chapter, trim(coalesce({_str('summary')}, '')) as summary, trim(coalesce({_str('topic')}, '')) as topic, {_l12('participants')} as participants, {_l12('events')} as events,
        {_l12('setups')} as setups, {_l12('payoffs')} as payoffs, {_l12('open_loops')} as open_loops, j is null as degraded, case when j is null then coalesce(err, 'no response stored') end as degraded_reason
      from ch left join p using (source_id, chapter)""",
)
def c16_chapters(spark, sf_dir):
    return rs.chapter_contexts(derived.coarse_chapters(spark, sf_dir), derived.chapter_responses(spark, sf_dir))


@register(
    "c16_source_context",
    f"with {CH}, "
    + _parsed("p", "source_id", f"select n as source_id, {_answer('b', 'n')} as raw from (select doc_id as n, {SOURCE_BODY.replace('n %', 'doc_id %').replace('|| n ||', '|| doc_id ||')} as b from documents where doc_id % 13 <> 0)")
    + f""", r as (select d.doc_id as source_id, coalesce(cnt, 0) as chapter_count, trim(coalesce({_str('video_summary')}, '')) as video_summary,
        case when lower(trim(coalesce({_str('content_type')}, 'other'))) in ('stream', 'interview', 'vlog', 'game', 'challenge', 'other') then lower(trim(coalesce({_str('content_type')}, 'other'))) else 'other' end as content_type,
        {_l12('main_topics')} as main_topics, {_l12('conflicts')} as conflicts, j is null as degraded, case when j is null then coalesce(err, 'no response stored') end as degraded_reason
       from documents d left join (select source_id, count(*) as cnt from ch group by 1) c on c.source_id = d.doc_id left join p on p.source_id = d.doc_id)
     select *, sha256(source_id || '|' || chapter_count || '|' || video_summary || '|' || content_type || '|' || main_topics || '|' || conflicts)[:16] as context_hash from r""",
)
def c16(spark, sf_dir):
    srcs = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"))
    return rs.source_context(srcs, derived.coarse_chapters(spark, sf_dir), derived.source_responses(spark, sf_dir))


@register(
    "c17_multimodal_table",
    _mm_accept() + f"select candidate_set_id, candidate_id, {_num('boringness')} as boringness, {_num('retention')} as retention, {_num('quality_score')} as quality_score, {_num('confidence')} as confidence, {_bool('outside_payoff')} as outside_payoff from ok",
)
def c17(spark, sf_dir):
    accepted, _ = rs.multimodal_table(derived.responses(spark, sf_dir, "multimodal"), KEYS)
    return accepted.select(*KEYS, "boringness", "retention", "quality_score", "confidence", "outside_payoff")


@register(
    "c17_multimodal_rejected",
    _mm_accept() + f""" select candidate_set_id, candidate_id, concat_ws('; ', case when j is null then err end, {", ".join(
        f"case when j is not null and not coalesce({_num(n)} between 0 and 100, false) then '{n} outside 0-100 or missing' end" for n in rs.PERCENT_FIELDS)},
      case when j is not null and not coalesce({_num('confidence')} between 0 and 1, false) then 'confidence outside 0-1 or missing' end,
      case when j is not null and not coalesce(lower(trim({_str('observable_event')})) in ('true', 'false'), false) then 'observable_event is not a boolean' end,
      case when j is not null and not coalesce(lower(trim({_str('visual_payoff')})) in ('true', 'false'), false) then 'visual_payoff is not a boolean' end,
      case when j is not null and {_str('reason')} is null then 'reason missing' end) as breaches
     from p anti join ok using (candidate_set_id, candidate_id)""",
)
def c17_rejected(spark, sf_dir):
    return rs.multimodal_table(derived.responses(spark, sf_dir, "multimodal"), KEYS)[1]
