"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from scorelens.llm.quality_rules import COMMON_WORDS

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP_SQL = f"""
with lines as (
  select doc_id, generate_subscripts(s, 1) as i, unnest(s) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents)),
keyed as (select *, translate(trim(line, {_BLANKS}), {_AZ}) as k from lines),
shared as (select k, max(doc_id) as last from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (last <> doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (last is null or last = doc_id), '')) as kept_sha256
from keyed left join shared using (k) group by doc_id"""


def quality_rules_sql(max_char_distance: float = 0.25, max_word_distance: float = 0.22) -> str:
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    hit = lambda ws: f"len([x for x in w if list_contains({words(ws)}, x)])"
    one = lambda ws: "[" + ", ".join(f"len([x for x in w if x = '{x}'])" for x in ws) + "]"
    sums = [hit(ws) for ws in COMMON_WORDS.values()]
    language = "case " + " ".join(f"when s[{g + 1}] = list_max(s) then {g + 1}" for g in range(4)) + " end"
    common = "case g " + " ".join(f"when {g + 1} then {one(ws)}" for g, ws in enumerate(COMMON_WORDS.values())) + " end"
    count = lambda kind: f"length(regexp_replace(t, '[^{kind}]+', '', 'g'))"
    points = r""".,;:!?''"()-"""
    return rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
parts as (select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
  [x for x in string_split(t, chr(10)) if trim(x, {_BLANKS}) <> ''] as l from docs),
base as (select r, doc_id, t, w, len(w) as n_words, length(list_aggregate(w, 'string_agg', '')) as word_chars,
  {count("#*$%&|<>")} as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, [{", ".join(sums)}] as s from parts),
triples as (select r, i, w[i:i+2] as x from (select r, w, unnest(range(1, len(w) - 1)) as i from parts)),
twice as (select r, i from (select r, i, count(*) over (partition by r, x) as n from triples) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from twice) group by r),
shown as (select *, {language} as g, length(t) as n_all, coalesce(word_chars, 0) as wc,
  [{count("A-Z")}, {count("0-9")}, {count(points)}, {count(r"!-/:-@\[-`{-~\x00-\x08\x0E-\x1F\x7F")} - {count(points)}] as a from base),
hists as (select r, doc_id, n_words, n_all, g, wc, n_symbols, n_dup_lines,
  list_append(list_append(a, n_all - wc), wc - list_sum(a)) as c, list_append({common}, n_words - list_max(s)) as m from shown),
refs as (select g, i, avg(c[i]::double / n_all) as qc, avg(m[i]::double / n_words) as qm
  from hists, (select unnest(range(1, 8)) as i) where n_all >= 200 and n_words >= 50 group by g, i),
terms as (select r, i, c[i]::double / n_all as pc, m[i]::double / n_words as pm, qc, qm
  from hists join refs using (g) where n_all >= 200 and n_words >= 50),
dist as (select r, sqrt(sum(case when i <= 6 then (case when pc > 0 then pc * log2(2 * pc / (pc + qc)) else 0 end + case when qc > 0 then qc * log2(2 * qc / (pc + qc)) else 0 end) / 2 else 0 end)) as dc,
  sqrt(sum((case when pm > 0 then pm * log2(2 * pm / (pm + qm)) else 0 end + case when qm > 0 then qm * log2(2 * qm / (pm + qm)) else 0 end) / 2)) as dm
  from terms group by r),
verdict as (select doc_id, n_words::bigint as n_words, wc::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, coalesce(dc, 0) as dc, coalesce(dm, 0) as dm
  from hists left join covered using (r) left join dist using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and dc <= {max_char_distance} and dm <= {max_word_distance} as kept
from verdict"""


NEAR_DEDUP_SQL = rf"""
with recursive parts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, array_to_string(w[i:i+2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from parts where len(w) >= 3)
  union all select doc_id, array_to_string(w, ' ') from parts where len(w) in (1, 2)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as common from shingles x join shingles y using (s) where x.doc_id <> y.doc_id group by 1, 2)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * common >= 85 * (p.n + q.n - common)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, l.b from reach join links l on l.a = reach.b)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id) left join sizes using (doc_id)"""


CONVERSATION_TRIE_SQL = """
with turns as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
convs as (select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(list_concat([4294967295], [ascii(x) for x in string_split(conv_id::varchar, '')]),
  lambda c, b: list_reduce(list_concat([xor(c, b::bigint)], range(8)), lambda v, i: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)), 4294967295) % 6 as h
  from (select distinct conv_id from turns)),
rebuilt as (select conv_id, role, text, row_number() over (partition by conv_id order by own, pos) as d from (
  select c.conv_id, role, text, pos, 0 as own from convs c join turns t on t.conv_id = c.base and t.pos <= h
  union all select conv_id, role, text, pos, 1 from turns join convs using (conv_id) where pos > h)),
paths as (select conv_id, d, text, sha256(array_to_string(list(md5(role) || md5(text)) over (partition by conv_id order by d), ',')) as node from rebuilt),
steps as (select conv_id, d, length(text) as chars, node, coalesce(lag(node) over (partition by conv_id order by d), 'root') as parent from paths
  union all select conv_id, 0, 0, 'root', null from convs),
nodes as (select node, any_value(d) as depth, any_value(parent) as parent, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs from steps group by node),
kids as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
valued as (select *, coalesce(n_children, 0) as c from nodes left join kids using (node)),
below as (select s.node, count(*) filter (c = 0) as n_leaves, sum((n_convs - 1) * v.chars) as saved
  from valued v join steps s on s.conv_id = v.conv_id and s.d <= v.depth group by s.node),
ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from (
  select conv_id, arg_max(node, d) as node from steps group by conv_id) group by node)
select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.c as n_children, n_leaves, saved::bigint as saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from valued v join below using (node) left join ends using (node) left join nodes p on p.node = v.parent"""


LEXICAL_SEARCH_SQL = rf"""
with terms as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
sizes as (select r, doc_id, len(t) as n from terms),
total as (select count(*) filter (n > 0) as nn, coalesce(sum(n), 0)::bigint as ll from sizes),
asked as (select q, item_id, t, count(*) as k from (select row_number() over () as q, item_id,
  unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by all),
held as (select r, t, count(*) as tf from (select r, unnest(t) as t from terms) where t in (select t from asked) group by all),
weights as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, total group by t, nn),
parts as (select r, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) as s from held join sizes using (r) join weights using (t), total),
scores as (select q, item_id, doc_id, r, sum(k * s)::bigint as score from asked join parts using (t) join sizes using (r) group by all having sum(k * s) > 0),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls first) as rank from scores)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20"""
