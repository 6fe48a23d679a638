"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

_LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: terms in at least 3 documents of their language, and how far a source's chances of them are from its language's or another source's
DIVERGENCE = f"""
with docs as (
  select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS.upper()}', '{_LETTERS}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents),
words as (select d, lang, source, unnest(terms) as term from docs),
kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct d) >= 3),
counts as (select w.lang, w.source, w.term, count(*) as n from words w join kept k on w.lang = k.lang and w.term = k.term group by all),
places as (select distinct lang, source from docs),
sizes as (select p.lang, p.source, coalesce(sum(c.n), 0)::hugeint as total from places p left join counts c on p.lang = c.lang and p.source = c.source group by all),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
chances as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.total + l.v) as p,
         1 + (1000000000::hugeint * (k.n + 1)) // (l.total + l.v) as whole
  from sizes s join langs l on s.lang = l.lang join kept k on s.lang = k.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from chances a join chances b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from places a join places b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, (((p - whole) * (p - whole)) // whole)::bigint as value from chances where n > 0 and p > whole)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 200
"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round: distances of every part to every entry, then the floors of the means."""
    steps = [f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
ps as (select r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] as x from kept, range({parts}) t(p)),
e0 as (select p, r - 1 as e, x from ps where r <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} as materialized (
  select r, p, x, (min(({{'d': d, 'e': e}})))['e'] as e, min(d) as d
  from (select ps.r, ps.p, ps.x, b.e, list_sum(list_transform(list_zip(ps.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from ps join e{k} b on ps.p = b.p)
  group by r, p, x)""")
        if k < rounds:
            steps.append(f"""
m{k} as (select p, e, i, floor_div(sum(c)::bigint, count(*)) as c from (select p, e, unnest(x) as c, unnest(range(len(x))) as i from a{k}) group by p, e, i),
e{k + 1} as materialized (
  select b.p, b.e, coalesce(m.x, b.x) as x from e{k} b left join (select p, e, list(c order by i) as x from m{k} group by p, e) m on b.p = m.p and b.e = m.e)""")
    body = ",".join(steps).replace("floor_div(sum(c)::bigint, count(*))", "((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::bigint")
    return body + f""",
codes as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by r),
book as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as sha from e{rounds}),
rows as (select k.vec_id, k.label, c.code, c.error from kept k join codes c on k.r = c.r)
select vec_id, label, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256 from rows, book
"""
