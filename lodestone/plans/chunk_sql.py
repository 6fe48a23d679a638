"""DuckDB SQL that restates the chunkers and the units of marked documents from their rules, as the other side of the comparison."""

from __future__ import annotations

#: what may end a chunk: kind, RE2 pattern that ends at the place, quality
ENDS = (("paragraph", "\\n\\s*\\n", 3.5), ("code", "```\\n", 2.7), ("table", "\\|[ \\t]*\\n", 2.7), ("sentence", "[.!?]\\s", 2.8), ("line", "\\n", 0.6), ("word", "\\s", 0.4))


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _candidates(kind: str, pattern: str, quality: float) -> str:
    """Ends of the pattern in seg (which begins at a) with their scores against goal. A table's last line is not followed by a further one."""
    found, between = f"regexp_extract_all(seg, '{pattern}')", f"string_split_regex(seg, '{pattern}')"
    ends = f"list_transform(range(1, len({found}) + 1), lambda i: list_sum(list_transform({between}[1:i], lambda x: length(x))) + list_sum(list_transform({found}[1:i], lambda x: length(x))))"
    if kind == "table":
        ends = f"list_filter({ends}, lambda e: seg[e + 1:e + 1] <> '|')"
    return f"list_transform({ends}, lambda e: {{'score': {quality}::double - 0.002::double * abs(a + e - goal), 'near': -abs(a + e - goal), 'low': -(a + e), 'kind': '{kind}'}})"


def recursive(source: str, size: int = 1000, overlap: int = 200, least: int = 100, window: int = 150) -> str:
    """CTEs from (doc_id, t): spans (doc_id, k, pos, stop, kind), one row a chunk."""
    reach = min(50, overlap // 2)
    every = ", ".join(_candidates(*e) for e in ENDS)
    return f"""recursive texts as (select doc_id, t, length(t)::bigint as n from ({source}) where regexp_matches(t, '\\S')),
walk as (
  select doc_id, t, n, -1 as k, 0::bigint as pos, 0::bigint as stop, '' as kind, 0::bigint as follows from texts
  union all
  select doc_id, t, n, k + 1, follows, e.stop, e.kind, case when e.stop < n then case when next_at > follows then next_at else e.stop end end
  from (select *, case when regexp_matches(near, '[.!?] ') then low - 1 + length(regexp_extract(near, '(?s)^(.*?[.!?]) ', 1)) + 1 when contains(near[2:], ' ') then low + strpos(near[2:], ' ') else e.stop - {overlap} end as next_at
    from (select *, e.stop - {overlap} - {reach} as low, t[e.stop - {overlap} - {reach}:least(e.stop, e.stop - {overlap} + {reach})] as near
      from (select *, case when n <= {size} then {{'stop': n, 'kind': 'complete_text'}} when goal >= n then {{'stop': n, 'kind': 'text_end'}} when len(c) = 0 then {{'stop': goal, 'kind': 'size'}}
          else {{'stop': -list_sort(c, 'desc')[1].low, 'kind': list_sort(c, 'desc')[1].kind}} end as e
        from (select *, flatten([{every}]) as c
          from (select *, follows + {size} as goal, greatest(follows + {least} + 1, follows + {size} - {window}) as a, t[greatest(follows + {least} + 1, follows + {size} - {window}) + 1:least(n, follows + {size} + {window})] as seg
            from walk where follows is not null)))))),
ranked as (select doc_id, t, k, pos, stop, kind, lead(stop) over w as last_stop, lead(kind) over w as last_kind, lag(stop) over w as before, k = max(k) over (partition by doc_id) as final, k = max(k) over (partition by doc_id) - 1 as previous
  from walk where k >= 0 window w as (partition by doc_id order by k)),
spans as (select doc_id, k, pos, case when previous and length({stripped('t[stop + 1:]')}) < {least} then last_stop else stop end as stop, case when previous and length({stripped('t[stop + 1:]')}) < {least} then last_kind else kind end as kind
  from ranked where not (final and before is not null and length({stripped('t[before + 1:]')}) < {least}))"""


def packed(parts: str, size: int, glue: str, slack: int) -> str:
    """A list of the parts, joined by glue while their lengths with slack stay within size."""
    row = "{'done': []::varchar[], 'now': %s, 'n': %s::bigint}"
    full = f"a.now <> '' and a.n + length(x.now) > {size}"
    fold = f"""list_reduce(list_transform({parts}, lambda p: {row % ('p', 'length(p)')}), lambda a, x: {{'done': case when {full} then list_append(a.done, a.now) else a.done end,
  'now': case when a.now = '' or {full} then x.now else a.now || {glue} || x.now end, 'n': (case when {full} then length(x.now) else a.n + length(x.now) + {slack} end)::bigint}}, {row % ("''", '0')})"""
    return f"(select case when f.now = '' then f.done else list_append(f.done, f.now) end from (select {fold} as f))"


def trimmed(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {stripped('p')}), lambda p: p <> '')"


SENTENCES = """select doc_id, (k - 1)::int as chunk_index, md5(c) as digest from (select doc_id, unnest(c) as c, generate_subscripts(c, 1) as k from (select doc_id, %s as c
from (select doc_id, string_split(text, '. ') as p from documents)))""" % packed(
    trimmed(f"list_transform(range(1, len(p) + 1), lambda i: case when i < len(p) and {stripped('p[i]')} <> '' and not ends_with(rtrim(p[i]), '.') then regexp_replace(p[i], '\\s+$', '') || '.' else p[i] end)"), 500, "' '", 1
)

#: documents with blank lines between their lines, but for every third
SPACED = "(select doc_id, case when doc_id % 3 = 0 then text else replace(text, chr(10), chr(10) || ' ' || chr(10)) end as text from documents)"

SECTIONS = f"""select doc_id, (k - 1)::int as chunk_index, md5(c) as digest from (select doc_id, unnest(c) as c, generate_subscripts(c, 1) as k from (select doc_id, case when len(p) > 1 then {packed('p', 500, "chr(10) || chr(10)", 2)} else {packed('l', 333, "' '", 1)} end as c
from (select doc_id, {trimmed("string_split_regex(text, '\\n\\s*\\n')")} as p, {trimmed("string_split(regexp_replace(text, '[.]\\s', '.' || chr(1), 'g'), chr(1))")} as l from {SPACED})))"""

RECURSIVE = "with " + recursive("select doc_id, text as t from documents") + """
select doc_id, k::int as chunk_index, pos::int as start, stop::int as "end", kind as boundary, greatest(coalesce(lag(stop) over w - pos, 0), 0)::int as overlap_previous, greatest(coalesce(stop - lead(pos) over w, 0), 0)::int as overlap_next
from spans window w as (partition by doc_id order by k)"""

#: parts of a marked document (plans.document_queries): lengths of what comes before its sections and of its items
_LAST = "length('intro ' || doc_id) + 1 + length('# Title ' || source) + 1 + length(text) + 1"

HYBRID = "with " + recursive("select doc_id, '# Title ' || source || chr(10) || replace(text, '|', '/') || chr(10) as t from documents") + f""",
d as (select *, length('intro ' || doc_id) + 1 as one, {_LAST} as two, length('- [x] done' || chr(10) || '- open @lang:' || lang) as items from documents),
parts as (
  select doc_id, 0 as o, 0 as sequence, 0 as start, one as "end", 'prose' as kind, '' as path, 0 as depth from d
  union all select doc_id, 1000 + k, k, one + pos, one + stop, 'prose', 'Title ' || source, 1 from spans join d using (doc_id)
  union all select doc_id, 100000 + v.o, v.o, v.a, v.b, v.kind, 'Title ' || source || ' > Items', 2 from d, lateral (select unnest([
    {{'o': 0, 'a': two, 'b': two + 9, 'kind': 'prose'}}, {{'o': 1, 'a': two + 9, 'b': two + 9 + items, 'kind': 'list'}},
    {{'o': 2, 'a': two + 11 + items, 'b': two + 40 + items, 'kind': 'table'}}, {{'o': 3, 'a': two + 42 + items, 'b': two + 77 + items, 'kind': 'code_block'}}]) as v)
  union all select doc_id, 200000 + v.o, v.o, v.a, v.b, v.kind, 'Title ' || source || ' > Items > **Deep**', 3 from d, lateral (select unnest([
    {{'o': 0, 'a': two + 78 + items, 'b': two + 91 + items, 'kind': 'prose'}}, {{'o': 1, 'a': two + 91 + items, 'b': two + 91 + items + length('> quoted' || chr(10) || '>> twice [[owner:ann]]'), 'kind': 'blockquote'}}]) as v))
select doc_id, (row_number() over (partition by doc_id order by o) - 1)::int as chunk_index, sequence::int as sequence, start::int as start, "end"::int as "end", kind, path, depth::int as depth from parts"""

UNITS = f"""with d as (select *, {_LAST} as two, length('- [x] done' || chr(10) || '- open @lang:' || lang) as items, string_split('intro ' || doc_id || chr(10) || '# Title ' || source || chr(10) || replace(text, '|', '/') || chr(10) || '## Items', chr(10)) as lines from documents),
l as (select doc_id, i, lines[i] as line, list_sum(list_transform(lines[1:i], lambda x: length(x) + 1)) - length(lines[i]) - 1 as pos from d, lateral (select unnest(range(1, len(lines) + 1)) as i)),
g as (select *, i - row_number() over (partition by doc_id order by i) as island from l where {stripped('line')} <> ''),
p as (select doc_id, min(pos) as start, max(pos + length(line)) as "end", string_agg(line, chr(10) order by i) as content from g group by doc_id, island),
u as (select doc_id, 'paragraph' as kind, start, "end", '{{"words":"' || len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) || '","sentences":"' || len(regexp_extract_all(content, '[.!?](\\s|$)')) || '"}}' as details from p
  union all select doc_id, v.kind, v.a, v.b, v.details from d, lateral (select unnest([
    {{'kind': 'list', 'a': two + 9, 'b': two + 9 + items, 'details': '{{"style":"task","items":"2","done":"1","depth":"1"}}'}},
    {{'kind': 'table', 'a': two + 11 + items, 'b': two + 40 + items, 'details': '{{"columns":"2","rows":"3","has_separator":"true","alignments":"left,center"}}'}},
    {{'kind': 'code_block', 'a': two + 42 + items, 'b': two + 77 + items, 'details': '{{"language":"python","block_type":"fenced","line_count":"4","has_imports":"true"}}'}},
    {{'kind': 'paragraph', 'a': two + 78 + items, 'b': two + 90 + items, 'details': '{{"words":"2","sentences":"0"}}'}},
    {{'kind': 'blockquote', 'a': two + 91 + items, 'b': two + 91 + items + length('> quoted' || chr(10) || '>> twice [[owner:ann]]'), 'details': '{{"depth":"2","attribution":""}}'}}]) as v))
select doc_id, (row_number() over (partition by doc_id order by start) - 1)::int as unit_index, kind, start::int as start, "end"::int as "end", details from u"""

INGEST = """with kept as (select doc_id, text from (select doc_id, text, row_number() over (partition by md5(lower(trim(text))) order by doc_id) as n from documents where text <> '' and length(text) <= 50000 and length(trim(text)) >= 10) where n = 1),
""" + recursive("select doc_id, text as t from kept").replace("recursive texts", "texts", 1) + """
select doc_id, 'reference' as collection, count(*)::bigint as n_chunks, 0::bigint as n_empty from spans group by doc_id
union all select doc_id, case when text = '' then 'empty' when length(text) > 50000 then 'too long' else 'too short' end, 0, 0 from documents where text = '' or length(text) > 50000 or length(trim(text)) < 10"""
INGEST = INGEST.replace("with kept", "with recursive kept", 1)
