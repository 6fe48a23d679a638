"""Cleaning, query understanding, scoring and formatting over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import querying as Q
from lodestone.functions import scoring as G
from lodestone.functions import text as T
from lodestone.operators.postings import small_batches
from lodestone.plans.registry import query, sql_any, sql_count, sql_times, table

WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
TW = WORDS.format("text")
LW = WORDS.format("lower(text)")


def docs(spark, d):
    return table(spark, d, "documents")


#: what some of the users' turns begin with, so that every rule of the query functions is met
HEADS = ["", "React vs Vue.js ", "compare Python versus Django ", "machine learning code in django ", "data validation from the physics programming collection ", "recent articles on ai ", 'show me "exact phrase" and " other " of ', "how to use docker ", "fix the error of ", "python function example "]
TURNS = "(select conv_id, turn, [" + ", ".join(f"'{h}'" for h in HEADS) + "][(conv_id * 3 + turn) % 10 + 1] || text as text from conversations where role = 'user')"


def turns(spark, d):
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(10)) + 1).cast("int"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(head, "text").alias("text"))


def _mojibake_sql(x: str) -> str:
    for bad in sorted(T.MOJIBAKE, key=len, reverse=True):
        x = f"replace({x}, '{bad}', '{T.MOJIBAKE[bad].replace(chr(39), chr(39) * 2)}')"
    return x


CLEAN = f"trim(regexp_replace({_mojibake_sql("regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g')")}, '\\s+', ' ', 'g'))"


@query(f"with c as (select doc_id, {CLEAN} as t from documents) select doc_id, md5(t) as digest, length(t)::bigint as n from c where length(t) >= 10")
def clean_text(spark, d):
    rows = docs(spark, d).select("doc_id", T.clean("text", unicode_form=False).alias("t")).where("t is not null")
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query()
def clean_text_nfkc(spark, d):
    rows = small_batches(docs(spark, d)).select("doc_id", T.clean("text").alias("t")).where("t is not null")
    return rows.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("select doc_id, md5(case when length(text) <= 120 then text when strpos(reverse(text[1:120]), ' ') > 0 then text[1:120 - strpos(reverse(text[1:120]), ' ')] else text[1:120] end) as digest from documents")
def cut_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.cut_at_space("text", 120)).alias("digest"))


@query("select doc_id from (select doc_id, row_number() over (partition by md5(lower(trim(text))) order by doc_id) as n from documents) where n = 1")
def exact_dedup(spark, d):
    return T.keep_first(docs(spark, d)).select("doc_id")


@query("select doc_id, source || '_' || md5(text)[1:8] as key, sha256(text)[1:16] as fingerprint from documents")
def document_keys(spark, d):
    return docs(spark, d).select("doc_id", T.document_key("source", "text").alias("key"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("fingerprint"))


@query("""select page_id, md5(trim(case when length(t) > 1000 then t[1:1000] || '...' else t end)) as digest
from (select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as t from pages)""")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.sanitise_comment("html")).alias("digest"))


@query("""select event_type, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace('Some' || event_type || 'Field-ID', '([A-Z])', '_\\1', 'g')), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') as field from events group by all""")
def snake_case_fields(spark, d):
    names = table(spark, d, "events").select("event_type").distinct()
    return names.select("event_type", T.snake_case(F.concat(F.lit("Some"), "event_type", F.lit("Field-ID"))).alias("field"))


@query("""select conv_id, turn, case when length(trim(text)) < 2 then 'query too short' when length(trim(text)) > 10000 then 'query too long'
  when length(regexp_replace(trim(text), '[\\w\\s]', '', 'g')) > length(trim(text)) * 0.5 then 'query is mostly punctuation' when turn not between 1 and 100 then 'top_k out of range' end as problem from conversations""")
def request_checks(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.request_problem("text", F.lit("notes"), "turn").alias("problem"))


@query("""select event_id, trim(event_type)[1:4] as short, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') as int), 5), 10), 60) as bounded,
  case when lower(trim(event_type)) in ('view', 'click') then lower(trim(event_type)) else 'other' end as kind from events""")
def field_validators(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", T.bounded_text("event_type", 4).alias("short"), T.bounded_int(F.get_json_object("props", "$.k"), 10, 60, 5).alias("bounded"), T.one_of("event_type", ["view", "click"], "other").alias("kind"))


def _intent_sql(t: str) -> str:
    return f"""case when {sql_any(t, Q.COMPARATIVE)} then 'comparative_analysis' when {sql_any(t, Q.TROUBLE)} then 'troubleshooting'
  when {sql_any(t, Q.CODE)} and {sql_any(t, list(Q.TECHNOLOGY))} then 'code_search' when {sql_any(t, Q.TUTORIAL)} and not contains({t}, 'collection') then 'tutorial_seeking' else 'information_seeking' end"""


@query(f"select intent, count(*)::bigint as n from (select {_intent_sql('lower(text)')} as intent from {TURNS}) group by intent")
def intent_counts(spark, d):
    return turns(spark, d).groupBy(Q.intent("text").alias("intent")).agg(F.count("*").alias("n"))


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


LETTER = "\\p{L}\\p{M}\\p{N}_"


def _words_sql(t: str, stop: list[str]) -> str:
    return f"list_filter(regexp_extract_all(lower({t}), '[{LETTER}]+'), lambda w: w not in ({_listed(stop)}) and length(w) > 2)"


def _key_terms_sql() -> str:
    pair = f"([{LETTER}]+)\\s+(?:vs|versus)\\s+"
    found = ", ".join(f"regexp_extract({of}, '{pair}([{more}]+)', {k}) as {name}" for of, more, k, name in (("l", LETTER, 1, "a"), ("l", LETTER, 2, "b"), ("q", LETTER + ".", 1, "wa"), ("q", LETTER + ".", 2, "wb")))
    steps = [
        f"select *, {_words_sql('q', Q.STOP_WORDS)} as t0, {_intent_sql('l')} as intent, {found} from (select conv_id, turn, text as q, lower(text) as l from {TURNS})",
        "select *, case when intent = 'comparative_analysis' and a <> '' then list_concat(list_filter(t0, lambda w: w <> a and w <> b), list_filter([wa, wb], lambda w: w <> '')) else t0 end as t1 from s0",
    ]
    for k, compound in enumerate(Q.COMPOUNDS, 1):
        x, y = compound.split()
        both = f"contains(l, '{compound}') and list_contains(t{k}, '{x}') and list_contains(t{k}, '{y}')"
        steps.append(f"select *, case when {both} then list_append(list_filter(t{k}, lambda w, i: w not in ('{x}', '{y}') and list_position(t{k}, w) = i), '{compound}') else t{k} end as t{k + 1} from s{k}")
    k = len(steps) - 1
    steps.append(f"select *, list_transform(t{k}, lambda w: case when w = 'django' then 'Django' when w = 'python' and contains(q, 'Python') then 'Python' else w end) as u from s{k}")
    ctes = ", ".join(f"s{i} as ({x})" for i, x in enumerate(steps))
    articles = "contains(l, 'articles') and contains(l, 'ai') then list_append(list_filter(u, lambda w: w in ('recent', 'articles')), 'AI')"
    meta = "contains(l, 'from') and contains(l, 'collection') then list_filter(u, lambda w: w not in ('collection', 'programming'))"
    return f"with {ctes} select conv_id, turn, array_to_string(case when {articles} when {meta} else u end, ' ') as terms from s{k + 1}"


@query(_key_terms_sql())
def key_terms(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.array_join(Q.key_terms("text"), " ").alias("terms"))


def _table_sql(t: str, names: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when contains({t}, '{k}') then '{v}' end" for k, v in names.items()) + ")"


MIXED = """(select doc_id, case doc_id % 8 when 0 then 'React vs Vue.js ' when 1 then 'fix Python error 3.11 ' when 2 then 'python function example ' when 3 then 'how to use docker on gpu '
  when 4 then 'show me papers from biology collection ' when 5 then 'results from 2023 latest ' when 6 then 'simple recent guide from last week ' else 'expert data validation ' end || text as q from documents)"""


def _mixed(spark, d):
    heads = ["React vs Vue.js ", "fix Python error 3.11 ", "python function example ", "how to use docker on gpu ", "show me papers from biology collection ", "results from 2023 latest ", "simple recent guide from last week ", "expert data validation "]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.pmod("doc_id", F.lit(8)) + 1).cast("int"))
    return docs(spark, d).select("doc_id", F.concat(head, "text").alias("q"))


@query(f"""select doc_id, {_intent_sql('lower(q)')} as intent, {_table_sql('lower(q)', Q.TECHNOLOGY)} as technologies, {_table_sql('lower(q)', Q.HARDWARE)} as hardware,
  nullif(regexp_extract(q, '(\\d+\\.\\d+)', 1), '') as version, case when contains(lower(q), 'last month') then 'last_month' when contains(lower(q), 'last week') then 'last_week' when {sql_any('lower(q)', Q.RECENT)} then 'recent' end as period,
  case when {sql_any('lower(q)', Q.BEGINNER)} then 'beginner' when {sql_any('lower(q)', Q.ADVANCED)} then 'advanced' end as level, {sql_any('lower(q)', Q.EXAMPLES)} as examples,
  nullif(regexp_extract(lower(q), '(?:from|in)\\s+(\\w+)\\s+collection', 1), '') as collection, nullif(regexp_extract(lower(q), 'from\\s+(\\d{{4}})', 1), '') as year from {MIXED}""")
def query_entities(spark, d):
    f = Q.filters("q")
    pick = lambda name: F.element_at(F.transform(F.filter(f, lambda x: x["field"] == name), lambda x: x["value"]), 1)
    first = lambda name: F.when(F.size(F.filter(f, lambda x: x["field"] == name)) > 0, F.get(F.transform(F.filter(f, lambda x: x["field"] == name), lambda x: x["value"]), F.lit(0)))
    return _mixed(spark, d).select(
        "doc_id", Q.intent("q").alias("intent"), F.array_join(Q.technologies("q"), ",").alias("technologies"), F.array_join(Q.hardware("q"), ",").alias("hardware"), Q.version("q").alias("version"),
        Q.period("q").alias("period"), Q.level("q").alias("level"), Q.wants_examples("q").alias("examples"), first("collection").alias("collection"), first("year").alias("year"),
    )


@query(f"""with x as (select doc_id, q, {_intent_sql('lower(q)')} as i, {_table_sql('lower(q)', Q.TECHNOLOGY)} as te, {_table_sql('lower(q)', Q.HARDWARE)} as hw, nullif(regexp_extract(q, '(\\d+\\.\\d+)', 1), '') as v,
  case when contains(lower(q), 'last month') then 'recent month' when contains(lower(q), 'last week') then 'recent week' when {sql_any('lower(q)', Q.RECENT)} then 'recent latest' end as p,
  case when {sql_any('lower(q)', Q.BEGINNER)} then 'beginner simple' when {sql_any('lower(q)', Q.ADVANCED)} then 'advanced expert' end as l, case when {sql_any('lower(q)', Q.EXAMPLES)} then 'examples' end as e from {MIXED})
select doc_id, trim(regexp_replace(concat_ws(' ', q, case i when 'comparative_analysis' then 'comparison analysis' when 'tutorial_seeking' then 'tutorial guide how-to' when 'code_search' then 'code implementation example' when 'troubleshooting' then 'troubleshooting solution fix' end,
  replace(te, ',', ' '), v, replace(hw, ',', ' '), p, e, l), '\\s+', ' ', 'g')) as enhanced from x""")
def query_enhancement(spark, d):
    return _mixed(spark, d).select("doc_id", Q.enhanced("q").alias("enhanced"))


QUOTED = """list_filter(list_transform(regexp_extract_all(text, '"([^"]*)"', 1), lambda p: trim(p)), lambda p: p <> '')"""
UNQUOTED = """regexp_replace(text, '"[^"]*"', '', 'g')"""


@query(f"""select conv_id, turn, array_to_string(list_concat({_words_sql('text', Q.RERANK_STOP)}, {QUOTED}), ' ') as rerank_keywords,
  array_to_string(list_sort(list_distinct(list_concat({QUOTED}, {_words_sql(UNQUOTED, Q.FORMAT_STOP)}))), ' ') as format_keywords from {TURNS}""")
def keyword_extraction(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.array_join(Q.rerank_keywords("text"), " ").alias("rerank_keywords"), F.array_join(F.sort_array(Q.format_keywords("text")), " ").alias("format_keywords"))


LENGTH = "case when length(text) < 50 then 0.0 when length(text) > 100000 then 0.8 else least(length(text) / 2000.0, 1.0) end"
STRUCTURE = f"""least(case when contains(text, chr(10) || chr(10)) then 0.3 else 0 end + case when {sql_times('text', '.')} >= 3 then 0.2 else 0 end + case when contains(text, '#') then 0.2 else 0 end
  + case when {sql_any('text', ['- ', '* ', '1. ', '2. '])} then 0.1 else 0 end + case when {sql_any('text', ['`', 'def ', 'class ', 'import '])} then 0.2 else 0 end, 1.0)"""
SENT = "list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
LANGUAGE = f"""least(0.7 + case when len({SENT}) > 0 then 0.2 * len(list_filter({SENT}, lambda s: s[1] = upper(s[1]) and upper(s[1]) <> lower(s[1]))) / len({SENT}) else 0 end
  + case when length(text) / greatest(len({SENT}), 1) between 10 and 100 then 0.1 else 0 end, 1.0)"""
UNIQUE = f"(select case when n = 0 then 0.0 when u / n < 0.3 then 0.2 when u / n < 0.5 then 0.5 else u / n end from (select len(list_distinct({LW})) as u, len({LW}) as n))"


@query(f"""with s as (select doc_id, {LENGTH} as a, {STRUCTURE} as b, {LANGUAGE} as c, {UNIQUE} as d from documents),
q as (select *, 0.15 * a + 0.2 * b + 0.25 * 0.4 + 0.1 * 0.5 + 0.2 * 0.7 + 0.05 * c + 0.05 * d as s from s)
select doc_id, round(a, 4)::double as length_score, round(b, 4)::double as structure_score, round(c, 6)::double as language_score, round(d, 6)::double as uniqueness_score, round(s, 6)::double as quality,
  case when round(s, 6) >= 0.9 then 'A' when round(s, 6) >= 0.8 then 'B' when round(s, 6) >= 0.7 then 'C' when round(s, 6) >= 0.6 then 'D' else 'F' end as grade from q""")
def quality_score(spark, d):
    p = docs(spark, d).select("doc_id", G.quality_parts("text").alias("p"))
    return p.select(
        "doc_id", F.round("p.length", 4).alias("length_score"), F.round("p.structure", 4).alias("structure_score"), F.round("p.language", 6).alias("language_score"),
        F.round("p.uniqueness", 6).alias("uniqueness_score"), F.round("p.quality", 6).alias("quality"), G.grade(F.round("p.quality", 6)).alias("grade"),
    )


@query("""select doc_id, round(least(0.4 + case when source <> '' then 0.3 else 0 end + case when doc_id % 3 = 0 then 0.1 else 0 end + case when doc_id % 4 <> 0 then 0.2 else 0 end + case when doc_id % 5 = 0 then 0.3 else 0 end + case when doc_id % 7 = 0 then 0.2 else 0 end, 1.0), 4)::double as credibility,
  case when doc_id % 4 = 0 then 0.5 when 100 + doc_id * 3 < 30 then 1.0 when 100 + doc_id * 3 < 365 then 0.8 when 100 + doc_id * 3 < 1825 then 0.6 else 0.3 end::double as freshness from documents""")
def credibility_freshness(spark, d):
    m = docs(spark, d).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(" and B"))).otherwise(F.col("source")).alias("author"),
        F.when(F.col("doc_id") % 4 != 0, F.date_sub(F.lit("2024-06-01").cast("date"), (100 + F.col("doc_id") * 3).cast("int")).cast("string")).alias("date"),
        F.when(F.col("doc_id") % 5 == 0, "10.1/x").alias("doi"), F.when(F.col("doc_id") % 7 == 0, "P").alias("publisher"),
    )
    return m.select("doc_id", F.round(G.credibility_score("author", "date", "doi", "publisher"), 4).alias("credibility"), G.freshness_score("date", F.lit("2024-06-01").cast("date")).alias("freshness"))


def _category_sql() -> str:
    parts = [f"case when w{k} > 0 then least(w{k} / length(t) * 1000, 0.95) else 0 end as c{k}" for k in range(4)]
    weights = [" + ".join(f"{sql_times('t', w)} * {len(w)}" for w in terms) + f" as w{k}" for k, terms in enumerate(G.CATEGORIES.values())]
    names = list(G.CATEGORIES)
    pick = " ".join(f"when greatest(c0, c1, c2, c3) > 0.4 and c{k} = greatest(c0, c1, c2, c3) then '{n}'" for k, n in enumerate(names))
    return f"""with l as (select doc_id, lower(text) as t from documents), w as (select *, {', '.join(weights)} from l), c as (select *, {', '.join(parts)} from w)
select doc_id, case {pick} else 'general' end as category, round(greatest(c0, c1, c2, c3, 0.4), 6)::double as confidence from c"""


@query(_category_sql())
def categorise(spark, d):
    return docs(spark, d).select("doc_id", G.category("text").alias("c")).select("doc_id", F.col("c.name").alias("category"), F.round("c.confidence", 6).alias("confidence"))


@query(f"select doc_id, concat_ws(',', {', '.join(f'case when {sql_any("lower(text)", terms)} then {chr(39)}{tag}{chr(39)} end' for tag, terms in G.TAGS.items())}) as tags from documents")
def semantic_tags(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(G.semantic_tags("text"), ",").alias("tags"))


TOPICS = ["a study in a journal with a hypothesis: ", "the algorithm of this library: ", "a survey and a comparison: ", "code review: ", ""]


@query(f"""with m as (select doc_id, lower([{_listed(TOPICS)}][doc_id % 5 + 1] || text) as t from documents), h as (select doc_id, {', '.join(f'{sql_count("t", G.DOMAINS[k])} as {k[0]}' for k in ('academic', 'technical', 'research'))} from m)
select doc_id, case when greatest(a, t, r) = 0 then 'general' when a >= t and a >= r then 'academic' when t >= r then 'technical' else 'research' end as domain from h""")
def domain(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x in TOPICS]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return docs(spark, d).select("doc_id", G.domain(F.concat(head, "text")).alias("domain"))


@query(f"""select doc_id, round(least(10.0, greatest(1.0, 3.0 + case when len({TW}) > 1000 then 2 when len({TW}) > 500 then 1 else 0 end + 0.5 * {sql_count('lower(text)', G.COMPLEX_WORDS)} + 0.3 * {sql_count('lower(text)', G.TECHNICAL_TERMS)})), 4)::double as complexity,
  greatest(1, round_even(len({TW}) / 200, 0))::int as minutes from documents""")
def complexity_reading_time(spark, d):
    return docs(spark, d).select("doc_id", F.round(G.complexity("text"), 4).alias("complexity"), G.reading_minutes("text").alias("minutes"))


@query(f"""select doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, '. ')[1:3], lambda s: {WORDS.format('s')}[1:3]), lambda w: len(w) >= 3), lambda w: array_to_string(w, ' ')), '|') as phrases from documents""")
def key_phrases(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(G.key_phrases("text"), "|").alias("phrases"))


@query("""select page_id, case when page_id % 5 = 0 then 'project-specific' when contains(p, 'src/') then 'project-specific' when page_id % 7 = 3 then 'reference' when contains(p, 'docs/') then 'reference' when contains(p, 'core/') then 'fundamental'
  when page_id % 7 = 1 and contains(p, 'standard') then 'fundamental' when contains(p, 'tmp/') then 'temporary' else 'general' end as kind
from (select page_id, case page_id % 6 when 0 then 'src/a' when 1 then 'docs/b' when 2 then 'core/c' when 3 then 'tmp/d' when 4 then 'x/standard' else 'y/z' end as p from pages)""")
def collection_router(spark, d):
    paths = F.array(*[F.lit(x) for x in ("src/a", "docs/b", "core/c", "tmp/d", "x/standard", "y/z")])
    p = table(spark, d, "pages").select("page_id", F.element_at(paths, (F.col("page_id") % 6 + 1).cast("int")).alias("path"), F.when(F.col("page_id") % 7 == 3, "manual").when(F.col("page_id") % 7 == 1, "pdf").otherwise("text").alias("kind"), F.when(F.col("page_id") % 5 == 0, "team1").when(F.col("page_id") % 5 == 1, "public").alias("team"))
    return p.select("page_id", G.route("kind", "path", "team").alias("kind"))


LINES = "string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10))"


@query(f"""with c as (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, {LINES} as l from documents)
select doc_id, case when t = '' then 'empty' when contains(t, '```') then 'code_block' when {sql_times('t', '`')} / length(t) > 0.05 then 'code_heavy'
  when len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^(- |\\* |\\+ |1\\. |2\\. )'))) > len(l) * 0.5 then 'list' when len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) > len(l) * 0.3 then 'table'
  when len(list_filter(l, lambda x: starts_with(ltrim(x), '#'))) > 0 then 'header_heavy' when {sql_times('t', '[')} + {sql_times('t', 'http')} > len({WORDS.format('t')}) * 0.1 then 'link_heavy'
  when {sql_any('t', ['$', chr(92) + '(', chr(92) + ')', chr(92) + '[', chr(92) + ']'])} then 'mathematical' else 'prose' end as kind from c""")
def chunk_content_type(spark, d):
    return docs(spark, d).select("doc_id", G.chunk_type("text").alias("kind"))


@query(f"""with c as (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, {LINES} as l from documents)
select doc_id, case when t = '' then 0.0 else round_even((case when length(t) < 50 then 0.6 when length(t) > 2000 then 0.8 else 1.0 end + case when right(t, 1) in ('.', '!', '?', ':', ';') then 1.0 when right(t, 1) = ',' then 0.7 else 0.5 end
  + case when len(l) > 1 and len(list_filter(l, lambda x: trim(x) = '')) / len(l) > 0.5 then 0.8 else 1.0 end)::double / 3, 2) end::double as score from c""")
def chunk_quality(spark, d):
    return docs(spark, d).select("doc_id", G.chunk_quality("text").alias("q")).select("doc_id", F.col("q.score").alias("score"))


@query(f"""select doc_id, length(text)::bigint as chars, len(regexp_extract_all(text, '\\p{{L}}'))::bigint as letters, len(regexp_extract_all(text, '\\p{{Nd}}'))::bigint as digits, len({TW})::bigint as words, len(list_distinct({LW}))::bigint as unique_words,
  len(string_split(text, chr(10)))::bigint as lines, {sql_times('text', '#')}::bigint as headers, {sql_times('text', '[')}::bigint as links from documents""")
def content_statistics(spark, d):
    return docs(spark, d).select("doc_id", G.content_statistics("text").alias("s")).select("doc_id", *[f"s.{c}" for c in ("chars", "letters", "digits", "words", "unique_words", "lines", "headers", "links")])


@query("""with h as (select doc_id, text, text[1:97] as h from documents), s as (select *, strpos(reverse(h), ' ') as b from h)
select doc_id, case when length(text) <= 100 then text when b > 0 and length(h) - b > 97 * 0.8 then h[1:length(h) - b] || '...' else h || '...' end as preview from s""")
def previews(spark, d):
    return docs(spark, d).select("doc_id", G.preview("text").alias("preview"))


@query(f"""with p as (select a.doc_id, lower(a.text) as x, lower(b.text) as y from documents a join documents b on b.doc_id = a.doc_id + 1),
c as (select doc_id, x, y, ({' + '.join(f"(contains(x, '{k}') and contains(y, '{k}'))::int" for k in G.CODE_WORDS)}) + case when contains(x, 'sort') and contains(y, 'sort') then 2 else 0 end + case when contains(x, 'array') and {sql_any('y', ['array', 'list'])} then 1 else 0 end as code,
  len(list_intersect(list_distinct({WORDS.format('x')}), list_distinct({WORDS.format('y')}))) as shared, len(list_distinct(list_concat({WORDS.format('x')}, {WORDS.format('y')}))) as either from p)
select doc_id, round(least(1.0, code / 11), 6)::double as code_similarity, round(case when either = 0 then 1 else shared / either end, 6)::double as jaccard from c""")
def text_similarity(spark, d):
    from lodestone.operators.search import jaccard

    a = docs(spark, d).select("doc_id", "text")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", F.round(G.code_similarity("text", "other"), 6).alias("code_similarity"), F.round(jaccard("text", "other"), 6).alias("jaccard"))


WORKS = ["neural network architecture model ", "deep learning model structure ", "machine learning research study ", "", "training a model for optimization ", "artificial intelligence framework "]


def _shared(k: str) -> str:
    return f"(contains(x, '{k}') and contains(y, '{k}'))::int"


def _all(column: str, words: tuple[str, ...]) -> str:
    return " and ".join(f"contains({column}, '{w}')" for w in words)


@query(f"""with m as (select doc_id, lower([{_listed(WORKS)}][doc_id % 6 + 1] || text) as t from documents), p as (select a.doc_id, a.t as x, b.t as y from m a join m b on b.doc_id = a.doc_id + 1),
c as (select *, {' + '.join(_shared(k) for k in G.ACADEMIC_WORDS)} + case when contains(x, 'neural network') and contains(y, 'deep learning') then 8 else 0 end + case when contains(x, 'neural') and (contains(y, 'deep') or contains(y, 'learning')) then 6 else 0 end
  + case when contains(x, 'architecture') and contains(y, 'structure') then 4 else 0 end + 3 * {_shared('model')} + case when contains(x, 'network') and (contains(y, 'structure') or contains(y, 'model')) then 3 else 0 end as n from p),
s as (select *, case when n > 0 then greatest(n / {len(G.ACADEMIC_WORDS) + 20}, 0.4) else 0 end as s from c)
select doc_id, round(least(1.0, case when {_all('x', ('neural', 'network', 'architecture'))} and {_all('y', ('deep', 'learning', 'model', 'structure'))} then greatest(s, 0.65) else s end), 6)::double as similarity from s""")
def academic_similarity(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x in WORKS]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int"))
    a = docs(spark, d).select("doc_id", F.concat(head, "text").alias("text"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return a.join(b, "doc_id").select("doc_id", F.round(G.academic_similarity("text", "other"), 6).alias("similarity"))


@query("""select event_id, round(greatest(0, 1 - value / 137), 3)::double as relevance, case when v > 0.9 then 0.95 when v > 0.8 then 0.85 when v > 0.6 then 0.7 when v > 0.4 then 0.5 else 0.3 end::double as confidence,
  case when v >= 0.9 then 'Highly Relevant' when v >= 0.7 then 'Very Relevant' when v >= 0.5 then 'Relevant' when v >= 0.3 then 'Somewhat Relevant' else 'Low Relevance' end as level,
  case when event_id % 1000 <= 50 then 'precise' when event_id % 1000 >= 500 then 'fast' else 'balanced' end as strategy from (select *, (event_id % 100) / 100 as v from events)""")
def score_steps(spark, d):
    e = table(spark, d, "events").withColumn("v", F.col("event_id") % 100 / 100)
    return e.select("event_id", G.relevance(F.col("value") / 137).alias("relevance"), G.confidence_step("v").alias("confidence"), G.relevance_level("v").alias("level"), G.strategy(F.col("event_id") % 1000).alias("strategy"))


@query(f"""select doc_id, {sql_times('lower(text)', 'the')}::bigint as tf_the, array_to_string(list_filter(['the', 'und', 'que', 'idiot'], lambda w: contains(lower(text), w)), ',') as matched,
  round(case when len({TW}) > 0 then least(1.0, ({sql_times('lower(text)', 'the')} + {sql_times('lower(text)', 'und')}) / len({TW})) else 0 end, 6)::double as density from documents""")
def term_frequency(spark, d):
    terms = F.array(*[F.lit(w) for w in ("the", "und", "que", "idiot")])
    return docs(spark, d).select("doc_id", G.term_frequency("text", "the").alias("tf_the"), F.array_join(G.matched_terms("text", terms), ",").alias("matched"), F.round(G.keyword_density("text", ["the", "und"]), 6).alias("density"))


@query("select doc_id, md5(regexp_replace(text, '(?i)(there|the|und)', '<mark>\\1</mark>', 'g')) as digest from documents")
def highlights(spark, d):
    return docs(spark, d).select("doc_id", F.md5(G.highlight("text", ["the", "there", "und"])).alias("digest"))


def _marked_sql(x: str) -> str:
    """Whole words marked by control characters; twice, since neighbours share the character between them."""
    edge = f"[^{LETTER}\\x01]"
    for _ in range(2):
        x = f"regexp_replace({x}, '(?i)(^|{edge})(the|und|of)({edge}|$)', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    return x


ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"


@query(f"select doc_id, md5(replace(replace({_marked_sql(ESCAPED)}, chr(1), '<mark>'), chr(2), '</mark>')) as digest from documents")
def word_highlights(spark, d):
    return docs(spark, d).select("doc_id", F.md5(G.highlight_words("text", ["the", "of", "und"])).alias("digest"))


@query("""select page_id, round(least(1.0, case when page_id % 2 = 0 then 0.3 else 0 end + case when page_id % 3 = 0 then 0.2 else 0 end + case when page_id % 5 = 0 then 0.2 else 0 end + case when page_id % 6 > 3 then 0.1 else 0 end + 0.2), 4)::double as structure,
  case when s >= 0.8 then 'very_high' when s >= 0.65 then 'high' when s >= 0.45 then 'medium' else 'low' end as confidence
from (select page_id, round(0.6 * (page_id % 100) / 100 + 0.25 * (page_id % 10) / 10 + 0.15 * 0.5, 9) as s from pages)""")
def hit_confidence(spark, d):
    p = table(spark, d, "pages")
    i = F.col("page_id")
    s = G.structure_relevance(F.when(i % 2 == 0, "t"), F.when(i % 3 == 0, "s"), F.when(i % 5 == 0, "text"), i % 6, "url")
    return p.select("page_id", F.round(s, 4).alias("structure"), G.hit_confidence(i % 100 / 100 + 1e-12, i % 10 / 10, F.lit(0.5)).alias("confidence"))
