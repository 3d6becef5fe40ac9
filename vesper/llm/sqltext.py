"""SQL of queries whose operators SQL can express, for DuckDB."""

from __future__ import annotations

from .quality_rules import BOILERPLATE

WORDS = r"'[^\x20\x09-\x0D]+'"
ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
PHRASES = " or ".join(f"contains(low, '{p.decode()}')" for p in BOILERPLATE)

QUALITY_RULES = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
bags as (select r, doc_id, text, regexp_extract_all(text, {WORDS}) as w from docs),
grams as (select r, i, array_to_string(w[i:i + 7], ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as i from bags where len(w) >= 8)),
many as (select r, i, count(*) over (partition by r, g) as n from grams),
covered as (select r, count(distinct p) as n_repeat_words from (select r, unnest(range(i, i + 8)) as p from many where n > 1) group by r),
lines as (
  select r, line, translate(line, {ASCII}) as low, regexp_extract_all(line, {WORDS}) as lw
  from (select r, unnest(string_split(text, chr(10))) as line from docs)
), rated as (
  select r, line, len(lw) as words, coalesce(list_sum(list_transform(lw, lambda x: length(x))), 0) as chars,
    len(list_filter(lw, lambda x: right(x, 1) in ('.', '!', '?'))) as stops, len(list_filter(lw, lambda x: right(x, 2) = '!!')) as shouts,
    len(list_filter(lw, lambda x: x in ('|', '>', '<', '/', '-', '*', '+'))) as lone,
    length(line) - length(regexp_replace(line, '[#*$%&|<>~^=_{{}}\\]', '', 'g')) as marks, ({PHRASES}) as boiler from lines
), judged as (
  select *, words > 0 and (stops = 0 or 10 * shouts > 3 * words or 10 * marks > chars or (lone >= 2 and 5 * lone >= words) or boiler) as failed from rated
), summed as (
  select r, count(*) as n_lines, count(*) filter (failed) as n_lines_removed, coalesce(sum(chars) filter (failed), 0)::bigint as chars_removed,
    sum(chars)::bigint as word_chars, count(*) filter (words > 0) - count(distinct line) filter (words > 0) as n_dup_lines from judged group by r
), counted as (
  select b.doc_id, len(b.w) as n_words, s.word_chars, length(b.text) - length(regexp_replace(b.text, '[#*$%&|<>]', '', 'g')) as n_symbols, s.n_dup_lines,
    coalesce(c.n_repeat_words, 0) as n_repeat_words, s.n_lines, s.n_lines_removed, s.chars_removed from bags b join summed s using (r) left join covered c using (r)
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * chars_removed <= 50 * word_chars as kept from counted
"""


def jaccard_components(k: int, percent: int) -> str:
    return rf"""
with recursive bags as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII}), {WORDS}) as w from documents),
shingles as (
  select distinct r, case when len(w) < {k} then array_to_string(w, ' ') else array_to_string(w[i:i + {k - 1}], ' ') end as g
  from (select r, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) as i from bags where len(w) > 0)
), sizes as (select r, count(*) as n from shingles group by r),
shared as (select a.r as a, b.r as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.r <> b.r group by a.r, b.r),
links as (select s.a, s.b from shared s join sizes x on x.r = s.a join sizes y on y.r = s.b where 100 * s.n >= {percent} * (x.n + y.n - s.n)),
reach as (select r as a, r as b from bags union select reach.a, links.b from reach join links on reach.b = links.a)
select o.doc_id, coalesce(s.n, 0) as n_shingles, min(p.doc_id) as component_id
from reach join bags o on o.r = reach.a join bags p on p.r = reach.b left join sizes s on s.r = reach.a group by reach.a, o.doc_id, s.n
"""


SUFFIX_DEDUP = """
with docs as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
strings as (select r, doc_id, p, substr(h, 2 * p - 1, 100) as s from (select *, unnest(range(1, n - 48)) as p from docs where n >= 50)),
gone as (select r, p from (select r, p, doc_id, min(doc_id) over (partition by s) as least from strings) where least < doc_id),
edges as (select r, p, p > 50 + coalesce(lag(p) over (partition by r order by p), -100) as new from gone),
runs as (select r, min(p) as a, max(p) + 49 as b from (select r, p, sum(new::int) over (partition by r order by p) as run from edges) group by r, run),
cuts as (select r, list(struct_pack(a, b) order by a) as spans, sum(b - a + 1)::bigint as n_removed, count(*) as n_spans from runs group by r),
parts as (
  select r, b + 1 as lo, coalesce(lead(a) over (partition by r order by a) - 1, 1000000000) as hi from runs
  union all select r, 1 as lo, coalesce((select min(a) - 1 from runs q where q.r = docs.r), 1000000000) as hi from docs
), texts as (select r, string_agg(substr(h, 2 * lo - 1, 2 * (hi - lo + 1)), '' order by lo) as h from parts join docs using (r) group by r)
select d.doc_id, d.n as n_bytes, coalesce(c.n_removed, 0) as n_removed, coalesce(c.n_spans, 0) as n_spans, sha256(unhex(t.h)) as kept_sha256
from docs d left join cuts c using (r) join texts t using (r)
"""
