"""DuckDB SQL for the rows of the registered queries."""

OP5 = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
iw as (select distinct item_id, least(10, len(w)) as k, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') as win
       from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0)),
dw as (select r, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') as win
       from (select r, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from iw) where len(w) >= k)),
hit as (select r, s, k, item_id from dw join iw using (k, win)),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + k)) as p from (select distinct r, s, k from hit)) group by r),
items as (select r, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) as items_sha256 from hit group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (r) left join items using (r)
"""

OP10 = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as s from d where len(w) >= 35)),
again as (select h from win group by h having count(*) > 1),
gone as (select r, list(distinct p) as ps from (select r, unnest(range(s, s + 35)) as p from win join again using (h)) group by r),
k as (select doc_id, r, len(w) as n, coalesce(len(ps), 0) as g,
             case when ps is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(ps, x[2])), lambda x: x[1]) end as kept
      from d left join gone using (r))
select doc_id, n::bigint as n_words, g::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""

OP3 = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select r, s, list_slice(w, s, s + 2) as k from (select r, w, unnest(range(1, len(w) - 1)) as s from w where len(w) >= 3)),
rep as (select r, count(distinct p) as n from (select r, unnest(range(s, s + 3)) as p from (select r, s, count(*) over (partition by r, k) as c from win) where c > 1) group by r),
line as (select r, source, t, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as line
         from (select r, source, t, unnest(lines) as x from d join w using (r))),
often as (select source, line from (select source, line, count(distinct t) as c from line group by all) join (select source as s2, count(distinct t) as n from d group by all) on source is not distinct from s2
          where c >= 10 or (c >= 3 and c >= 0.10 * n)),
boiler as (select r, sum(len(line) - len(replace(line, ' ', '')) + 1) as n from line l where exists (select 1 from often o where o.source is not distinct from l.source and o.line = l.line) group by r),
f as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(boiler.n, 0)::bigint as n_boilerplate
      from d join w using (r) left join rep using (r) left join boiler using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_boilerplate <= 0.5 * n_words and n_words - n_boilerplate >= 50 as kept, n_boilerplate from f
"""

OP6 = r"""
with d as (select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h from documents),
node as (select depth, h >> (60 - depth) as p, sum(n_bytes)::bigint as b, count(*) as n from d, range(0, 61) as x(depth) group by all),
own as (select doc_id, n_bytes, h, min(depth) as depth from d, range(0, 61) as x(depth) join node using (depth) where node.p = h >> (60 - depth) and (b <= 16777216 or n = 1) group by all)
select doc_id, n_bytes, case when depth = 0 then '' else lpad(bin(h >> (60 - depth)), depth::int, '0') end as shard, depth::bigint as depth, b as shard_bytes
from own join node using (depth) where node.p = h >> (60 - own.depth)
"""

OP2 = r"""
with recursive d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct r, array_to_string(list_slice(w, s, s + 2), ' ') as x from (select r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as s from d where len(w) > 0)),
n as (select r, count(*) as n from sh group by r),
pair as (select a.r as a, b.r as b, count(*) as c from sh a join sh b using (x) where a.r < b.r group by all),
link as (select a, b from pair join n p on p.r = a join n q on q.r = b where 100 * c >= 90 * (p.n + q.n - c)),
twoway as (select a, b from link union all select b, a from link),
reach as (select r, r as o from d union select reach.r, twoway.b from reach join twoway on twoway.a = reach.o)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, case when any_value(n.n) is null then d.doc_id else min(e.doc_id) end as component_id
from d left join n using (r) join reach using (r) join d e on e.r = reach.o group by d.r, d.doc_id
"""

OP1 = r"""
with d as (select doc_id, row_number() over () as r, coalesce(text, '') as t from documents),
k(kind, place, rx) as (values
  ('assign', 1, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 2, '(AKIA)([A-Z0-9]+)'), ('hex', 3, '()([0-9a-f]+)'), ('random', 4, '()([A-Za-z0-9+/_-]{16,}={0,2})')),
found as (
  select r, 'assign' as kind, 1 as place, string_split_regex(t, (select rx from k where place = 1)) as gaps, regexp_extract_all(t, (select rx from k where place = 1)) as ms, regexp_extract_all(t, (select rx from k where place = 1), 2) as vs from d
  union all select r, 'access', 2, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') from d
  union all select r, 'hex', 3, string_split_regex(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}') from d
  union all select r, 'random', 4, string_split_regex(t, '[A-Za-z0-9+/_-]{16,}={0,2}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{16,}={0,2}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{16,}={0,2}') from d),
m as (select r, kind, place, i, length(gaps[i]) as gap, length(ms[i]) as size, vs[i] as v from (select *, unnest(range(1, len(ms) + 1)) as i from found)),
pos as (select r, kind, place, v, size, sum(gap + size) over (partition by r, kind order by i) as e from m),
span as (select r, kind, place, v, (e - size)::bigint as s, e::bigint as e from pos
         where case kind when 'assign' then length(v) >= 6 when 'access' then size >= 20 when 'random' then regexp_matches(v, '[0-9]') else true end),
tok as (select distinct v, regexp_replace(v, '=+$', '') as core from span where kind = 'random'),
enc as (select v, core, case when not regexp_matches(core, '[A-Za-z]') then null when regexp_matches(core, '^([0-9a-f]+|[0-9A-F]+)$') then 'hex' when regexp_matches(core, '^[A-Z2-7]+$') then 'base32'
          when regexp_matches(core, '^[0-9a-z]+$') then 'lower36' when regexp_matches(core, '^[0-9A-Z]+$') then 'upper36'
          when regexp_matches(core, '[a-z]') and regexp_matches(core, '[A-Z]') and regexp_matches(core, '^[0-9A-Za-z]+$') then 'base62'
          when regexp_matches(core, '[a-z]') and regexp_matches(core, '[A-Z]') and regexp_matches(core, '^([0-9A-Za-z+/]+|[0-9A-Za-z_-]+)$') then 'base64' end as encoding from tok),
alpha(encoding, a) as (values ('hex', '0123456789abcdef'), ('base32', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), ('lower36', '0123456789abcdefghijklmnopqrstuvwxyz'), ('upper36', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'),
  ('base62', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'), ('base64', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/')),
sym as (select v, encoding, length(a) as k, i, instr(a, substr(c, i, 1)) - 1 as x from (select v, e.encoding, a, case when e.encoding = 'hex' then lower(core) else translate(core, '_-', '/+') end as c, unnest(range(1, length(core) + 1)) as i
        from enc e join alpha using (encoding))),
lagged as (select *, lag(x) over (partition by v order by i) as y from sym),
cnt as (select v, encoding, k, x, count(*) as c, sum((2 * x >= k)::int) as high, sum(coalesce(((2 * x >= k) <> (2 * y >= k))::int, 0)) as turns, sum(coalesce((x - (k - 1) / 2.0e0) * (y - (k - 1) / 2.0e0), 0)) as product from lagged group by all),
st as (select v, encoding, k::double as k, sum(c)::double as n, sum(c * c)::double as squares, sum(high)::double as n1, sum(turns)::double as turns, sum(product)::double as product from cnt group by all),
z as (select *, (pow(greatest(squares * k / n - n, 0) / (k - 1), 1 / 3.0e0) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) as z1,
        abs(turns + 1 - (1 + 2 * n1 * (n - n1) / n)) / sqrt(greatest((2 * n1 * (n - n1) / n) * (2 * n1 * (n - n1) / n - 1) / (n - 1), 1e-9)) as z2, abs(product / ((k * k - 1) / 12) / sqrt(n - 1)) as z3 from st),
p as (select v, encoding || '/' || case when n < 24 then 0 when n < 32 then 1 when n < 48 then 2 else 3 end as stratum,
        floor(1000000 * least(1, 3 * least(1 - 1 / (1 + exp(-(1.5976 * z1 + 0.07056 * z1 * z1 * z1))), case when n1 in (0, n) then 0 else 2 * (1 - 1 / (1 + exp(-(1.5976 * z2 + 0.07056 * z2 * z2 * z2)))) end,
          2 * (1 - 1 / (1 + exp(-(1.5976 * z3 + 0.07056 * z3 * z3 * z3))))))) as p from z),
step as (select stratum, p, sum(count(*)) over (partition by stratum order by p) as rank, sum(count(*)) over (partition by stratum) as m from p group by stratum, p),
lim as (select stratum, max(p) filter (where p * m <= rank * 50000) as lim from step group by stratum),
good as (select v from p join lim using (stratum) where lim is null or p > lim),
every as (select r, kind, place, s, e from span where kind <> 'random'
          union all select r, kind, place, s, e from span x where kind = 'random' and v in (select v from good)
            and not exists (select 1 from span b where b.r = x.r and b.kind <> 'random' and b.s < x.e and x.s < b.e)),
told as (select r, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex, count(*) filter (where kind = 'random') as n_random,
           string_agg(kind || ':' || s || ':' || e, ',' order by s, place) as spans, string_agg(kind || ':' || s || ':' || e, ',' order by s, place) filter (where kind <> 'random') as base from every group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_random, 0)::bigint as n_random
from d left join told using (r)
"""

OP11 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
named as (select conv_id, turn, sha256(length(role) || ':' || role || text) as name, length(text) as size from t),
own as (select conv_id, list(name order by turn nulls first, name) as names, list(size order by turn nulls first, name) as sizes,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, x:
                   list_reduce(list_prepend(xor(c, x), range(8)), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295) % 6 as h
        from named group by conv_id),
c as (select o.conv_id, list_concat(coalesce(list_slice(b.names, 1, o.h), []), list_slice(o.names, o.h + 1, len(o.names))) as names,
             list_concat(coalesce(list_slice(b.sizes, 1, o.h), []), list_slice(o.sizes, o.h + 1, len(o.sizes))) as sizes
      from own o left join own b on b.conv_id = o.conv_id - o.conv_id % 100),
step as (select conv_id, d, len(names) as n, case when d > 0 then sizes[d] else 0 end as size, md5(array_to_string(list_slice(names, 1, d), '')) as k,
                case when d > 0 then md5(array_to_string(list_slice(names, 1, d - 1), '')) end as up from (select *, unnest(range(0, len(names) + 1)) as d from c)),
node as (select d, k, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(size) as saved,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '')) as ends from step group by d, k),
kids as (select up as k, d - 1 as d, count(*) as n from node where d > 0 group by all),
below as (select s.d, s.k, sum(n.saved) as saved, count(*) filter (where kids.n is null) as leaves
          from node n join step s on s.conv_id = n.conv_id and s.d <= n.d left join kids on kids.k = n.k and kids.d = n.d group by all)
select node.conv_id, node.d::bigint as depth, parent.conv_id as parent_conv_id, node.n_convs::bigint as n_convs, coalesce(kids.n, 0)::bigint as n_children,
       below.leaves::bigint as n_leaves, below.saved::bigint as saved_tokens, node.ends as ends_sha256
from node join below on below.k = node.k and below.d = node.d left join kids on kids.k = node.k and kids.d = node.d
left join node parent on parent.k = node.up and parent.d = node.d - 1
"""


def _op13(rounds: int = 4) -> str:
    """Rounds written out one after another."""
    with_ = [
        "v as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as xs from embeddings "
        "where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "o as materialized (select *, row_number() over (order by vec_id nulls last, xs) - 1 as r, (select max(len(xs)) // 4 from v) as w from v)",
        "x as materialized (select r, d, d // w as part, xs[d + 1] as x from (select *, unnest(range(0, len(xs))) as d from o))",
        "c0 as materialized (select r as e, d, part, x as y from x where r < 256)",
    ]
    near = "select r, part, min(far * 256 + e) as m from (select x.r, x.part, c.e, sum((x - y) * (x - y))::bigint as far from x join c{0} c using (d) group by all) group by all"
    for i in range(rounds):
        with_.append(f"a{i} as materialized ({near.format(i)})")
        with_.append(
            f"c{i + 1} as materialized (select e, d, part, coalesce(f.y, c.y) as y from c{i} c left join "
            f"(select m % 256 as e, x.d, floor(sum(x)::double / count(*))::bigint as y from a{i} a join x on x.r = a.r and x.part = a.part group by all) f using (e, d))"
        )
    with_.append(f"a as materialized ({near.format(rounds)})")
    with_.append("code as (select r, string_agg(printf('%02x', (m % 256)::int), '' order by part) as code, sum(m // 256)::bigint as error from a group by r)")
    with_.append(f"book as (select sha256(string_agg(y::varchar, ',' order by part, e, d)) as codebooks_sha256 from c{rounds})")
    return "with " + ",\n".join(with_) + "\nselect vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from o join code using (r), book"


OP13 = _op13()
