"""Chunking, parsing, encoding, sources and windows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import scoring as G
from lodestone.operators import analytics as A
from lodestone.operators import chunking as K
from lodestone.operators import parsing as R
from lodestone.operators.encoding import HashingEncoder, embed, provider
from lodestone.operators.intervals import contained
from lodestone.operators.search import top_k
from lodestone.plans import chunk_sql as X
from lodestone.plans.registry import query, sql_any, table
from lodestone.streaming import windows as S

#: a mark-up version of each document: headers, a list, a table, code and a quote around its text, whose bars are no table
MARKED = """'intro ' || doc_id || chr(10) || '# Title ' || source || chr(10) || replace(text, '|', '/') || chr(10) || '## Items' || chr(10) || '- [x] done' || chr(10) || '- open @lang:' || lang || chr(10) || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10)
|| '```python' || chr(10) || 'import os' || chr(10) || '# no header' || chr(10) || '```' || chr(10) || '### **Deep**' || chr(10) || '> quoted' || chr(10) || '>> twice [[owner:ann]]'"""


def marked(spark, d):
    lines = [
        F.concat(F.lit("intro "), F.col("doc_id").cast("string")), F.concat(F.lit("# Title "), "source"), F.replace("text", F.lit("|"), F.lit("/")), F.lit("## Items"), F.lit("- [x] done"), F.concat(F.lit("- open @lang:"), "lang"), F.lit(""), F.lit("| a | b |"), F.lit("|---|:-:|"), F.lit("| 1 | 2 |"), F.lit(""),
        F.lit("```python"), F.lit("import os"), F.lit("# no header"), F.lit("```"), F.lit("### **Deep**"), F.lit("> quoted"), F.lit(">> twice [[owner:ann]]"),
    ]
    return table(spark, d, "documents").select("doc_id", F.concat_ws("\n", *lines).alias("text"))


@query("select doc_id, (i // 300)::int as chunk_index, i::int as start, least(i + 300, length(text))::int as \"end\", md5(text[i + 1:i + 300]) as digest from documents, unnest(range(0, length(text), 300)) r(i)")
def fixed_chunks(spark, d):
    return K.fixed_size(table(spark, d, "documents"), 300).select("doc_id", "chunk_index", "start", "end", F.md5("content").alias("digest"))


@query(X.SENTENCES)
def sentence_chunks(spark, d):
    return K.sentences(table(spark, d, "documents")).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


def spaced(spark, d):
    """Documents with blank lines between their lines, but for every third."""
    t = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


@query(X.SECTIONS)
def section_chunks(spark, d):
    return K.sections(spaced(spark, d)).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(f"""with p as (select doc_id, unnest(p) as p, generate_subscripts(p, 1) as k from (select doc_id, {X.trimmed("string_split_regex(text, '\\n\\s*\\n')")} as p from {X.SPACED})),
c as (select doc_id, k, case when length(p) > 25000 then {X.packed(X.trimmed("string_split(replace(p, '.', '.' || chr(1)), chr(1))"), 500, "' '", 1)} else [p] end as c from p),
u as (select doc_id, k, unnest(c) as c, generate_subscripts(c, 1) as i from c)
select doc_id, (row_number() over (partition by doc_id order by k, i) - 1)::int as chunk_index, md5(c) as digest from u""")
def paragraph_chunks(spark, d):
    """Parts between blank lines; those beyond 25,000 characters in packed sentences."""
    return K.paragraphs(spaced(spark, d)).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query(X.RECURSIVE)
def recursive_chunks(spark, d):
    return K.recursive(table(spark, d, "documents")).select("doc_id", "chunk_index", "start", "end", "boundary", "overlap_previous", "overlap_next")


@query("with " + X.recursive("select doc_id, text as t from documents") + " select doc_id, case doc_id % 5 when 0 then count(*) when 1 then count(*) else 0 end::bigint as n_problems from spans group by doc_id")
def chunk_validation(spark, d):
    """Chunks held against their texts; of every fifth document the starts are moved, of another fifth they are empty."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    j = K.recursive(docs).join(docs, "doc_id")
    i = F.col("doc_id") % 5
    start, end = F.col("start") + (i == 0).cast("int"), F.when(i == 1, F.col("start")).otherwise(F.col("end") + (i == 0).cast("int"))
    problem = K.chunk_problem(F.col("text"), F.col("content"), start, end, F.col("overlap_previous"))
    return j.groupBy("doc_id").agg(F.count(problem).alias("n_problems"))


@query(X.HYBRID)
def hybrid_chunks(spark, d):
    return K.hybrid(marked(spark, d)).select("doc_id", "chunk_index", "sequence", "start", "end", "kind", "path", "depth")


#: documents of which some begin like code, papers or tutorials
KINDS = {"code": "def f(): pass\n", "academic_paper": "Abstract. ", "tutorial": "A tutorial: ", "documentation": "API reference. ", "general": ""}
_HEAD = "[" + ", ".join(f"'{v}'" for v in KINDS.values()) + "][doc_id % 5 + 1]"


def of_kinds(spark, d):
    head = F.element_at(F.array(*[F.lit(v) for v in KINDS.values()]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(head, "text").alias("text"))


def _kind_sql(t: str) -> str:
    return f"case {' '.join(f'when {sql_any(t, terms)} then {chr(39)}{k}{chr(39)}' for k, terms in G.CONTENT_TYPES.items())} else 'general' end"


@query(f"""select doc_id, case when kind = 'code' then 1500 when kind = 'academic_paper' then 1200 when kind = 'tutorial' then 800 when n < 1000 then 300 when n < 10000 then 800 else 1200 end::int as size, case when kind = 'code' then 100 when kind = 'academic_paper' then 200 when kind = 'tutorial' then 150 when n < 1000 then 50 when n < 10000 then 100 else 200 end::int as overlap
from (select doc_id, length(t) as n, {_kind_sql('lower(t)')} as kind from (select doc_id, {_HEAD} || text as t from documents))""")
def chunk_profiles(spark, d):
    return of_kinds(spark, d).select("doc_id", K.profile(G.content_type("text"), F.length("text")).alias("p")).select("doc_id", "p.size", "p.overlap")


@query(f"select doc_id, {_kind_sql('lower(t)')} as content_type from (select doc_id, {_HEAD} || text as t from documents)")
def content_type(spark, d):
    return of_kinds(spark, d).select("doc_id", G.content_type("text").alias("content_type"))


@query(f"select doc_id, s.section::int as section, s.level::int as level, s.title, s.path from (select doc_id, source, {MARKED} as t from documents) m, (values (0, 0, '', ''), (1, 1, 'T', 'T'), (2, 2, 'Items', 'T > Items'), (3, 3, '**Deep**', 'T > Items > **Deep**')) v(section, level, title0, path0), lateral (select v.section, v.level, case when title0 = 'T' then 'Title ' || source else title0 end as title, replace(path0, 'T', 'Title ' || source) as path) s")
def markdown_sections(spark, d):
    rows = R.sections(marked(spark, d))
    return rows.select("doc_id", "section", "level", "title", F.when(F.col("level") == 0, "").otherwise(F.col("path")).alias("path"))


@query(f"""with t as (select doc_id, source, text, case doc_id % 4 when 0 then text when 1 then '# A' || chr(10) || text when 2 then text || chr(10) || '# A' || chr(10) || '# B ' || source else {MARKED} end as t from documents)
select doc_id, case doc_id % 4 when 0 then 1 when 1 then 1 when 2 then 3 else 4 end::bigint as n_sections, case doc_id % 4 when 0 then 0 when 3 then 3 else 1 end::int as max_level, case doc_id % 4 when 0 then 1 when 1 then 1 when 2 then 2 else 4 end::bigint as n_levels,
  length(t)::bigint as total_length, case when doc_id % 4 < 2 then 'flat' else 'hierarchical' end as kind from t""")
def structure_statistics(spark, d):
    k = F.col("doc_id") % 4
    t = table(spark, d, "documents").join(marked(spark, d).withColumnRenamed("text", "marked"), "doc_id")
    t = t.select("doc_id", F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("# A\n"), "text")).when(k == 2, F.concat("text", F.lit("\n# A\n# B "), "source")).otherwise(F.col("marked")).alias("text"))
    return R.structure_statistics(R.sections(t)).select("doc_id", "n_sections", "max_level", "n_levels", "total_length", "kind")


@query("select doc_id, '- Title ' || source || chr(10) || '  - Items' || chr(10) || '    - **Deep**' as outline from documents")
def section_outline(spark, d):
    return R.outline(R.sections(marked(spark, d)))


@query(X.UNITS)
def atomic_units(spark, d):
    return R.units(marked(spark, d)).select("doc_id", "unit_index", "kind", "start", "end", F.to_json("details").alias("details"))


def _inline_sql(t: str) -> str:
    parts = []
    for kind, pattern in R.INLINE.items():
        p = pattern.replace("\\w", "[\\p{L}\\p{M}\\p{N}_]")
        parts.append(f"select doc_id, '{kind}' as kind, unnest(regexp_extract_all({t}, '{p}', 1)) as key, trim(unnest(regexp_extract_all({t}, '{p}', 2))) as value from documents")
    return " union all ".join(parts)


@query(_inline_sql(f"({MARKED})"))
def inline_metadata(spark, d):
    return R.inline_tags(marked(spark, d)).select("doc_id", "kind", "key", "value")


@query("select doc_id, 'yaml' as kind, 'Doc ' || doc_id as title, source as author, lang || ',x' as tags, md5(text) as body from documents")
def frontmatter(spark, d):
    docs = table(spark, d, "documents")
    head = F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id").cast("string"), F.lit("\nauthor: "), "source", F.lit("\ntags: ["), "lang", F.lit(", x]\n---\n"), "text")
    return R.frontmatter(docs.select("doc_id", head.alias("text"))).select("doc_id", "kind", "title", "author", F.array_join("tags", ",").alias("tags"), F.md5("body").alias("body"))


@query("""select doc_id, md5('<h2>' || source || '</h2>' || chr(10) || '<strong>' || lang || '</strong> <em>it</em> <a href="u">n</a>') as digest, 1::int as n_bold, 1::int as n_link from documents""")
def markdown_html(spark, d):
    t = F.concat(F.lit("## "), "source", F.lit("\n**"), "lang", F.lit("** *it* [n](u)"))
    c = R.rule_counts("t")
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.md5(R.markdown_to_html("t")).alias("digest"), F.element_at(c, "bold").alias("n_bold"), F.element_at(c, "link").alias("n_link"))


@query()
def encoded_search(spark, d):
    """Documents embedded by the built-in encoder and searched by benchmark passages."""
    enc = HashingEncoder(64)
    chunks = embed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), F.col("text").alias("content")), enc)
    q = embed(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("content")), enc).select("qid", F.col("embedding").alias("query_embedding"))
    return top_k(chunks.where("embedding is not null"), q, 5).select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query("select doc_id, case when lang = 'en' then 'small' when lang = 'de' then 'multi' else 'default' end as encoder from documents")
def encoder_routing(spark, d):
    return table(spark, d, "documents").select("doc_id", provider(F.col("lang"), {"en": "small", "de": "multi"}, "default").alias("encoder"))


def _events(spark, d):
    return table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*)::bigint as n from events group by all")
def tumbling_counts(spark, d):
    return S.tumbling(_events(spark, d), "at", "1 hour", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""select strftime(b - o * interval 1 hour, '%Y-%m-%d %H:%M') as start, count(*)::bigint as n from (select time_bucket(interval 1 hour, ts) as b from events), (values (0), (1)) v(o) group by 1""")
def sliding_counts(spark, d):
    return S.sliding(_events(spark, d), "at", "2 hours", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("""with g as (select *, (lag(ts) over w is null or ts >= lag(ts) over w + interval 6 hour)::int as new from events window w as (partition by user_id order by ts)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*)::bigint as n from s group by user_id, k""")
def session_counts(spark, d):
    return S.sessions(_events(spark, d), "at", "6 hours", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("select doc_id, 2::int as section from documents union all select doc_id, 1 from documents where source = 'src3'")
def section_search(spark, d):
    rows = R.sections(marked(spark, d))
    a = R.find_sections(rows, title="items", exact_case=False, levels=(2, 3), content_pattern="^- \\[x\\].*open")
    b = R.find_sections(rows, title_pattern="^Title src3$", where=F.col("level") == 1)
    return a.select("doc_id", "section").unionByName(b.select("doc_id", "section"))


@query("select conv_id, turn from conversations where contains(lower(text), 'the') order by conv_id desc, turn limit 20")
def query_history(spark, d):
    return A.history_search(table(spark, d, "conversations"), "THE", 20, "text", "conv_id", "turn").select("conv_id", "turn")


@query("select word, count(*)::bigint as n from (select unnest(string_split_regex(lower(text), '\\s+')) as word from conversations where role = 'user') where length(word) > 3 group by word order by n desc, word limit 5")
def common_query_words(spark, d):
    return A.common_words(table(spark, d, "conversations").where("role = 'user'"), 5, "text")


@query("select doc_id, ceil(length(text) / 300)::bigint as n_chunks, length(text)::bigint as n_chars, round(length(text) / ceil(length(text) / 300), 6)::double as mean_chars from documents where length(text) > 0")
def chunk_statistics(spark, d):
    return A.chunk_statistics(K.fixed_size(table(spark, d, "documents"), 300), "doc_id").withColumn("mean_chars", F.round("mean_chars", 6))


@query("select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id) as n from events) where n > 12")
def cache_eviction(spark, d):
    return A.evicted(table(spark, d, "events"), 12, "user_id", "ts", "event_id").select("event_id")


@query("select event_id, round(coalesce((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 0), 6) as scaled from events window w as (partition by event_type)")
def scaled_metadata(spark, d):
    return A.scaled(table(spark, d, "events"), "value", "event_type", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""with s as (select event_type, length(event_type) % 2 as odd, avg((value > 10 * length(event_type) - 30)::int) as r, avg(case when length(event_type) % 2 = 0 then value / 1000 else value end) as m from events group by event_type)
select event_type, case when r >= 0.8 then 'A' when r >= 0.6 then 'B' when r >= 0.4 then 'C' else 'D' end as grade,
  array_to_string(list_concat(case when r < 0.5 then ['enlarge the cache'] else [] end, case when m > 1 then ['warm frequent keys'] else [] end), ',') as advice from s""")
def cache_advice(spark, d):
    """Kinds of events as caches, that hit and take time differently by the length of their names."""
    n = F.length("event_type")
    log = table(spark, d, "events").select("event_type", (F.col("value") > 10 * n - 30).alias("hit"), F.when(n % 2 == 0, F.col("value") / 1000).otherwise(F.col("value")).alias("seconds"))
    return A.cache_advice(A.cache_statistics(log, "event_type")).select("event_type", "grade", F.array_join("advice", ",").alias("advice"))


@query("select doc_id as qid, p as priority, case p when 1 then 'Search recent publications on \"' || source || '\"' else 'Look for overviews and tutorials about \"' || source || '\"' end as suggestion from documents, (values (1), (2)) v(p) where doc_id % 3 = 0")
def research_suggestions(spark, d):
    gaps = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("source").alias("query"), (F.col("doc_id") % 3 == 0).alias("has_gap"))
    return A.research_suggestions(gaps)


@query("select doc_id, 'Title ' || source || ' > Items' as context from documents")
def header_context(spark, d):
    levels = F.array(F.concat(F.lit("Title "), "source"), F.lit("Items"), F.lit("Deep"))
    return table(spark, d, "documents").select("doc_id", R.header_context(levels, F.array(F.lit(1), F.lit(2), F.lit(3)), 2).alias("context"))


@query("select doc_id, 'list' as kind, 2::bigint as outer_id from documents union all select doc_id, 'table', 2 from documents union all select doc_id, 'code_block', 2 from documents union all select doc_id, 'blockquote', 3 from documents")
def units_in_sections(spark, d):
    """Which section holds the units made for each document (its own text has none of these kinds)."""
    docs = marked(spark, d)
    units = R.units(docs).where("kind in ('list', 'table', 'code_block', 'blockquote')").select("doc_id", "kind", "start", "end")
    outer = R.sections(docs).select("doc_id", F.col("section").cast("long").alias("outer_id"), F.col("start").alias("outer_start"), F.col("end").alias("outer_end"))
    return contained(units, outer, "doc_id").where("outer_id >= 2").select("doc_id", "kind", "outer_id")


@query("select doc_id, length(text)::bigint as n from documents where doc_id % 2 = 0 union all select doc_id, -1 from documents where doc_id % 2 = 1")
def rebuild_index(spark, d):
    from lodestone.plans.pipelines import rebuild

    chunks = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("collection"), F.col("text").alias("content"), F.array(F.lit(0.5)).alias("embedding"), F.lit(None).cast("string").alias("embedding_error"))
    new = rebuild(chunks, HashingEncoder(8), ["a"])
    return new.select("doc_id", F.when(F.size("embedding") == 8, F.length("content").cast("long")).otherwise(F.lit(-1).cast("long")).alias("n"))


@query("select event_id, case when value / 100 > 0.5 then greatest(10, (event_id % 90) // 2) else -1 end::bigint as suggested from events")
def suggested_limits(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.coalesce(A.suggested_limit(F.col("value") / 100, F.col("event_id") % 90), F.lit(-1).cast("long")).alias("suggested"))


@query("select o_orderkey as key from orders where o_orderkey % 7 not in (2, 5) and o_orderkey % 3 <> 1 or o_orderkey % 11 = 0")
def cache_invalidation(spark, d):
    """Cached results that no changed collection touches; every eleventh touches none."""
    k = F.col("o_orderkey")
    touched = F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a"), (k % 7).cast("string")), F.concat(F.lit("b"), (k % 3).cast("string"))))
    changed = spark.createDataFrame([("a2",), ("a5",), ("b1",), ("none",)], "collection string")
    return A.still_cached(table(spark, d, "orders").select(k.alias("key"), touched.alias("collection")), changed).select("key")
