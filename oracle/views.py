"""The derived views as SQL, and a helper that puts the needed ones before a body."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "segments": """
  select source_id, segment_id, end_ms - dur as start_ms, end_ms, text from (
    select *, cast(sum(dur + gap) over (partition by source_id order by segment_id
                rows between unbounded preceding and current row) as bigint) - gap as end_ms
    from (
      select source_id, segment_id, text,
             cast(400 * (1 + length(text) % 17) as bigint) as dur,
             cast(case when segment_id % 7 = 0 then 1500 when segment_id % 3 = 0 then 700 else 150 end as bigint) as gap
      from (
        select doc_id as source_id, cast(unnest(range(len(parts))) as bigint) as segment_id, trim(unnest(parts)) as text
        from (select doc_id, string_split(regexp_replace(text, '([.!?]) ', '\\1\n', 'g'), chr(10)) as parts from documents)
      ) where text <> ''
    )
  )""",
    "numbered": """
  select source_id, segment_id, start_ms, end_ms, text,
         row_number() over (partition by source_id order by segment_id) - 1 as idx,
         count(*) over (partition by source_id) as n
  from segments""",
    "pointers": """
  select i.source_id, i.idx, i.n, i.start_ms, i.end_ms as own_end_ms,
         min(j.idx) filter (where j.end_ms >= i.start_ms + 60000) as closer,
         min(j.idx) filter (where j.start_ms >= i.start_ms + 45000) as later
  from numbered i left join numbered j on i.source_id = j.source_id and j.idx > i.idx
  group by all""",
    "starts": """
  select p.source_id, p.idx, p.n, p.start_ms,
         case when p.closer is null then p.n - 1
              when c.end_ms <= p.start_ms + 90000 then p.closer
              else p.closer - 1 end as end_idx,
         coalesce(p.later, p.n) as next_idx
  from pointers p left join numbered c on c.source_id = p.source_id and c.idx = p.closer""",
    "walk": """
  select source_id, idx, end_idx, next_idx, n from starts where idx = 0
  union all
  select s.source_id, s.idx, s.end_idx, s.next_idx, s.n
  from walk w join starts s on s.source_id = w.source_id and s.idx = w.next_idx
  where w.end_idx < w.n - 1""",
    "cut": """
  select w.source_id, w.idx, w.end_idx, a.start_ms, b.end_ms
  from walk w join numbered a on a.source_id = w.source_id and a.idx = w.idx
  join numbered b on b.source_id = w.source_id and b.idx = w.end_idx
  where b.end_ms - a.start_ms >= 30000 or (w.end_idx = w.n - 1 and b.end_ms - a.start_ms >= 18000)
  union all
  select source_id, 0, max(idx), arg_min(start_ms, idx), arg_max(end_ms, idx) from numbered
  where source_id not in (
    select w.source_id from walk w join numbered a on a.source_id = w.source_id and a.idx = w.idx
    join numbered b on b.source_id = w.source_id and b.idx = w.end_idx
    where b.end_ms - a.start_ms >= 30000 or (w.end_idx = w.n - 1 and b.end_ms - a.start_ms >= 18000))
  group by source_id""",
    "candidates": """
  select c.source_id, c.candidate_seq, printf('cand_%03d', c.candidate_seq) as candidate_id, c.start_ms, c.end_ms,
         c.end_ms - c.start_ms as duration_ms, count(*) as n_segments, string_agg(s.text, ' ' order by s.idx) as text
  from (select *, row_number() over (partition by source_id order by idx) as candidate_seq from cut) c
  join numbered s on s.source_id = c.source_id and s.idx between c.idx and c.end_idx
  group by all""",
    "tokens_of": """
  select source_id, candidate_seq, trim(text) as t, greatest(1.0e0, duration_ms / 1000.0e0) as dur,
    list_filter(regexp_extract_all(lower(trim(text)), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '\\p{L}+') and length(x) > 1) as w
  from candidates""",
    "lex": """
  select source_id, candidate_seq, t, w, len(w) as n, len(w) / dur * 60.0e0 as wpm,
    contains(t[:120], '?') or list_has_any(w[:25], ['почему','как','зачем','что','кто','где','куда','откуда','сколько','why','how','what','who','where','when']) as ask,
    list_has_any(w[:25], ['секрет','секреты','тайна','ошибка','ошибки','никогда','всегда','шок','главное','правда','факт','факты','внимание','осторожно','важно','secret','secrets','mystery','mistake','never','always','truth','revealed']) as tease,
    list_has_any(w[:25], ['ты','вы','тебе','вам','представь','представьте','смотри','смотрите','послушай','слушай','знаешь','знаете','you','imagine','look','listen','watch']) as talk,
    length(t) - length(replace(t, '!', '')) as bangs,
    len(list_filter(w, lambda x: x in ('вау','ого','жесть','кошмар','ужас','супер','круто','обалдеть','невероятно','боже','безумие','бомба','топ','кайф','офигеть','шок','провал','восторг','wow','insane','crazy','awesome','unbelievable','shocking','terrible','huge','omg'))) as emo,
    len(list_filter(w, lambda x: x in ('потому','поэтому','из-за','например','во-первых','во-вторых','исследование','статистика','результат','причина','тысяч','миллион','миллиард','процент','рублей','долларов','лет','because','therefore','example','result','statistic'))) as info,
    len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: length(x) > 2 and upper(x) = x and lower(x) <> x)) as caps,
    len(regexp_extract_all(regexp_replace(t, '\\p{L}', 'z', 'g'), '\\b\\d+([.,]\\d+)?\\b|%|\\$|€|₽')) as nums,
    len(list_distinct(w)) as kinds,
    coalesce(list_max(map_values(list_histogram(w))), 0) as top
  from tokens_of""",
    "parts": """
  select source_id, candidate_seq, n, wpm, ask, tease, talk, bangs, emo, info, nums, (top / n > 0.22e0 and n > 20) as repeats,
    least(100.0e0, 45.0e0 + (case when ask then 25.0e0 else 0 end) + (case when tease then 20.0e0 else 0 end) + (case when talk then 15.0e0 else 0 end)) as h,
    least(100.0e0, 40.0e0 + least(25.0e0, bangs * 10.0e0) + least(30.0e0, emo * 12.0e0) + least(15.0e0, caps * 5.0e0)) as e,
    least(100.0e0, 40.0e0 + least(25.0e0, nums * 8.0e0) + least(25.0e0, info * 8.0e0) + (case when kinds / n > 0.65e0 then 15.0e0 else 0 end)) as i,
    greatest(10.0e0, least(100.0e0, 60.0e0 + (case when w[1] in ('и','а','но','да','короче','так вот','ну','and','but','so','well') then -20.0e0 else 15.0e0 end)
      + (case when suffix(t, '.') or suffix(t, '!') or suffix(t, '?') or suffix(t, '."') or suffix(t, '!"') or suffix(t, '?"') then 15.0e0 else -10.0e0 end)
      + (case when n >= 50 then 10.0e0 else 0 end))) as s
  from lex""",
    "shared": """
  select *, greatest(0.0e0, least(100.0e0, rnd1(0.40e0 * h + 0.35e0 * e + 0.25e0 * i))) as v,
    (case when wpm < 70 then 15.0e0 when wpm > 240 then 10.0e0 else 0.0e0 end) + (case when repeats then 15.0e0 else 0 end) as penalty
  from parts""",
    "heuristic": """
  select p.source_id, p.candidate_seq, c.start_ms, c.end_ms,
    case when n < 5 then 10.0e0 else rnd1(greatest(0.0e0, least(100.0e0, 0.25e0 * h + 0.20e0 * s + 0.20e0 * e + 0.15e0 * i + 0.20e0 * v - penalty))) end as score,
    case when n < 5 then 10.0e0 else h end as hook_score, case when n < 5 then 10.0e0 else s end as standalone_score,
    case when n < 5 then 10.0e0 else e end as emotion_score, case when n < 5 then 10.0e0 else i end as information_score,
    case when n < 5 then 10.0e0 else v end as shareability_score,
    case when n < 5 then 'Fragment contains almost no speech words.' else coalesce(nullif(concat_ws('; ',
      case when ask then 'opening question hook' end, case when tease then 'high curiosity hook words' end,
      case when talk then 'direct viewer address' end, case when bangs > 0 then bangs || ' exclamation markers' end,
      case when emo > 0 then 'emotional keywords' end, case when nums > 0 then 'concrete numbers / data points' end,
      case when info > 0 then 'structured explanatory reasoning' end, case when wpm < 70 then 'slow speech density' end,
      case when repeats then 'excessive word repetition' end), ''), 'Balanced dialogue fragment') end as reason
  from shared p join candidates c using (source_id, candidate_seq)""",
    "ranked_ab": """
  select candidate_set_id, scorer, candidate_id, score,
         row_number() over (partition by candidate_set_id, scorer order by score desc, candidate_id) as rank
  from (select source as candidate_set_id, 'A' as scorer, doc_id as candidate_id, cast(n_chars % 101 as double) as score from documents
        union all
        select source, 'B', doc_id, cast((doc_id * 37) % 101 as double) from documents)""",
    "predictions": """
  select *, case when candidate_id % 5 = 0 then 'rejected_editorial' when candidate_id % 4 = 0 then null else 'ranked' end as status,
    case when candidate_id % 6 = 0 then null else (candidate_id * 13) % 50 + 1 end as previous_rank,
    case candidate_id % 6 when 0 then 'STRONG' when 1 then 'GOOD' when 2 then 'WEAK' when 3 then 'REJECT' when 4 then 'FATAL_REJECT' end as editorial_class,
    case when candidate_id % 8 = 0 then 'REJECT' else 'KEEP' end as critic_result
  from ranked_ab""",
    "pool": """
  select d.source as candidate_set_id, d.doc_id as candidate_id,
    case when l.doc_id is not null then cast(greatest(0, least(4, 3 * l.quality + d.doc_id % 2 - l.toxic)) as double) end as human_score,
    case when l.doc_id is not null then l.quality = 1 and l.toxic = 0 end as publishable,
    case when l.doc_id is not null and d.doc_id % 3 <> 0 then (d.doc_id % 9) / 2.0e0 end as hook_score,
    case when l.doc_id is not null and d.doc_id % 3 <> 0 then cast(d.doc_id % 5 as double) end as standalone_score,
    case when l.doc_id is not null and d.doc_id % 3 <> 0 then (d.doc_id % 7) / 2.0e0 end as payoff_score,
    case when l.doc_id is not null and d.doc_id % 3 <> 0 then (d.doc_id % 13) / 4.0e0 end as value_score,
    case when l.doc_id is not null and d.doc_id % 3 <> 0 then (d.doc_id % 4) / 1.0e0 end as context_dependency,
    case when l.doc_id is not null and d.doc_id % 3 <> 0 then d.doc_id % 4 = 0 end as bad_start,
    case when l.doc_id is not null and d.doc_id % 3 <> 0 then d.doc_id % 5 = 0 end as bad_end
  from documents d left join labels l using (doc_id)""",
    "features": """
  select source, doc_id as candidate_id,
    cast((doc_id * 7 + n_chars) % 101 as double) as hook, cast((doc_id * 9 + n_chars) % 101 as double) as standalone,
    cast((doc_id * 11 + n_chars) % 101 as double) as story_payoff, cast((doc_id * 13 + n_chars) % 101 as double) as emotion,
    cast((doc_id * 15 + n_chars) % 101 as double) as humor, cast((doc_id * 17 + n_chars) % 101 as double) as surprise,
    case when doc_id % 13 <> 0 then cast((doc_id * 19 + n_chars) % 101 as double) end as retention,
    cast((doc_id * 21 + n_chars) % 101 as double) as shareability, cast((doc_id * 23 + n_chars) % 101 as double) as boringness,
    cast((doc_id * 25 + n_chars) % 101 as double) as context_dependency,
    case when doc_id % 4 <> 0 then cast((doc_id * 3 + n_chars) % 101 as double) end as llm_quality_score,
    doc_id % 5 = 0 as setup_only, doc_id % 7 = 0 as transitional, doc_id % 11 = 0 as outside_payoff, 'text ' || doc_id as reason
  from documents where text <> ''""",
}


def expand(sql: str) -> str:
    """``rndN(x)``: round the shortest decimal form of ``x`` half up to N places, the
    rule Spark's ``round`` follows (DuckDB rounds the scaled binary value instead)."""
    while True:
        m = re.search(r"\brnd(\d)\(", sql)
        if not m:
            return sql
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end() : i - 1]
        sql = f"{sql[: m.start()]}cast(round(cast(cast(({inner}) as varchar) as decimal(38, 20)), {m.group(1)}) as double){sql[i:]}"


def with_views(body: str, recursive: bool = False) -> str:
    """Prefix ``body`` (which may start with its own ``with``) with the views it uses."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_text = VIEWS[name]
                needed.append(name)
                visit(visit_text)

    visit(body)
    ordered = [n for n in VIEWS if n in needed]
    recursive = recursive or "walk" in needed
    head = ", ".join(f"{n} as ({VIEWS[n]}\n)" for n in ordered)
    body = body.strip()
    low = body.lower()
    if low.startswith("with recursive"):
        body, recursive, joined = body[len("with recursive"):], True, ","
    elif low.startswith("with"):
        body, joined = body[len("with"):], ","
    else:
        joined = ""
    keyword = "with recursive" if recursive else "with"
    if not head:
        return expand(f"{keyword} {body}" if joined else body)
    return expand(f"{keyword} {head}{joined} {body}")
