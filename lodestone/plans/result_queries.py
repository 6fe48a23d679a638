"""Metadata, formatted results and whole jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metadata as M
from lodestone.operators import results as R
from lodestone.operators.chunking import invalidated, recursive, with_model
from lodestone.operators.encoding import HashingEncoder
from lodestone.plans import chunk_sql
from lodestone.plans import pipelines as P
from lodestone.plans.registry import preview_sql, query, table
from lodestone.plans.search_queries import WEIGHTED, _weighted


@query("""select doc_id, doc_id::varchar as some_id, case when doc_id % 2 = 0 then '2024-01-01' else '2024-06-01T00:00:00' end as made_at, case when doc_id % 3 = 0 then doc_id::varchar else '0' end as chunk_size, trim(regexp_replace(text[1:30], '\\s+', ' ', 'g')) as title from documents""")
def clean_metadata(spark, d):
    m = F.create_map(F.lit("some Id"), F.col("doc_id").cast("string"), F.lit("madeAt"), F.when(F.col("doc_id") % 2 == 0, "2024-01-01").otherwise("never"), F.lit("chunkSize"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise("x"), F.lit("Title"), F.substring("text", 1, 30))
    c = table(spark, d, "documents").select("doc_id", M.clean_map(m, F.lit("2024-06-01").cast("timestamp")).alias("m"))
    return c.select("doc_id", F.coalesce(F.col("m")["some_id"], F.col("m")["some__id"]).alias("some_id"), F.col("m")["made_at"].alias("made_at"), F.col("m")["chunk_size"].alias("chunk_size"), F.col("m")["title"].alias("title"))


@query("select event_id, event_type || ',x' as tags, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as created_at, case when event_type in ('view', 'click') then event_type else 'unknown' end as kind, 2::int as n_tags from events")
def metadata_store_form(spark, d):
    e = table(spark, d, "events").withColumn("s", M.to_store(F.array("event_type", F.lit("x")), F.col("ts").cast("timestamp"), F.col("event_type"), ["view", "click"]))
    return e.select("event_id", "s.tags", "s.created_at", "s.kind", F.size(M.from_store(F.col("s"), F.current_timestamp())["tags"]).alias("n_tags"))


@query("select doc_id, case when doc_id % 2 = 0 then 'read' else 'read,write' end as ann, 'read' as bob from documents")
def permission_maps(spark, d):
    old = F.create_map(F.lit("ann"), F.array(F.lit("read")), F.lit("bob"), F.array(F.lit("read")))
    new = M.with_permissions(old, F.lit("ann"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("write"))))
    return table(spark, d, "documents").select("doc_id", new.alias("m")).select("doc_id", F.array_join(F.col("m")["ann"], ",").alias("ann"), F.array_join(F.col("m")["bob"], ",").alias("bob"))


_ENDINGS = {"markdown": "md|markdown", "text": "txt|text", "pdf": "pdf", "python": "py", "html": "html|htm"}


@query(f"""with p as (select page_id, case page_id % 5 when 0 then url || '.md' when 1 then url || '/a.PDF' when 2 then url || '.py' else url end as path from pages)
select page_id, 'Page ' || page_id as title, path, case when page_id % 2 = 0 then page_id::int else -1 end as page,
  case when page_id % 7 = 0 then 'given' {" ".join(f"when regexp_matches(lower(path), '[.]({e})$') then '{k}'" for k, e in _ENDINGS.items())} else 'unknown' end as kind from p""")
def source_attribution(spark, d):
    """All pages, with an ending put to three of five addresses; every seventh says its kind itself."""
    i = F.col("page_id")
    path = F.when(i % 5 == 0, F.concat("url", F.lit(".md"))).when(i % 5 == 1, F.concat("url", F.lit("/a.PDF"))).when(i % 5 == 2, F.concat("url", F.lit(".py"))).otherwise(F.col("url"))
    meta = F.to_json(F.struct(F.lit("").alias("title"), F.concat(F.lit("Page "), i.cast("string")).alias("document_title"), path.alias("file_path"), F.when(i % 2 == 0, i.cast("string")).alias("page"), F.when(i % 7 == 0, "given").alias("file_type")))
    return table(spark, d, "pages").select("page_id", meta.alias("m")).select("page_id", R.attribution("m").alias("a")).select("page_id", "a.title", "a.path", F.coalesce("a.page", F.lit(-1)).alias("page"), "a.kind")


REASON = """(select doc_id, round((doc_id % 100) / 100, 2) as s, source, 'simple zzzq word' as q, text || ' basic' as content from documents)"""


@query(f"""select doc_id, 'Ranked due to ' || case when s >= 0.8 then 'high semantic relevance' when s >= 0.5 then 'moderate relevance' else 'low relevance' end || ', ' || array_to_string((list_filter([case when contains(lower(content), 'simple') then 'contains ''simple''' end,
  case when contains(lower(content), 'zzzq') then 'contains ''zzzq''' end, case when contains(lower(content), 'word') then 'contains ''word''' end, 'from ' || source || ' collection', 'matches beginner-level preference'], lambda x: x is not null))[1:2], ', ') as reason from {REASON}""")
def ranking_reasons(spark, d):
    r = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100 / 100).alias("s"), "source", F.concat("text", F.lit(" basic")).alias("content"))
    return r.select("doc_id", F.regexp_replace(R.ranking_reason(F.col("s"), F.col("content"), F.col("source"), F.lit("simple zzzq word")), "\\. Relevance score: .*$", "").alias("reason"))


@query(f"""select doc_id, md5('[' || printf('%.3f', s) || '] 1. ' || doc_id || ': ' || regexp_replace({preview_sql('text', 500)}, '\\s+', ' ', 'g')) as digest from (select doc_id, text, (doc_id % 100) / 100 as s from documents where trim(text) <> '') where s >= 0.3""")
def formatted_results(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (F.col("doc_id") % 100 / 100).alias("similarity"), F.lit(1).alias("rank"))
    return R.formatted(rows, "cli", least=0.3).select(F.col("id").alias("doc_id"), F.md5("formatted").alias("digest"))


@query(f"""select doc_id, md5(snippet) as snippet, md5(regexp_replace(snippet, '(?i)(there|the)', '**\\1**', 'g')) as highlighted, case lang when 'en' then 'Code Block' when 'fr' then 'Table' when 'de' then 'List Item' else 'Text' end as kind_label, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 as n_the
from (select doc_id, lang, text, {preview_sql('text', 200)} as snippet from documents)""")
def enriched_results(spark, d):
    kind = F.when(F.col("lang") == "en", "code_block").when(F.col("lang") == "fr", "table").when(F.col("lang") == "de", "list_item").otherwise("text")
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), kind.alias("kind"))
    e = R.enriched(rows, ["the", "there"])
    return e.select("doc_id", F.md5("snippet").alias("snippet"), F.md5("highlighted").alias("highlighted"), "kind_label", F.col("term_counts")["the"].alias("n_the"))


@query(WEIGHTED + """select q.vec_id as qid, coalesce(array_to_string(list(id order by rank), ','), '') as ids, count(id)::bigint as n_hits, array_to_string(list_concat(case when count(id) = 0 then ['expand_scope'] when count(id) < 3 then ['expand_query'] else [] end,
  case when count(distinct collection) > 2 then ['filter_collections'] else [] end), ',') as suggestions from embeddings q left join ranked r on r.qid = q.vec_id where q.vec_id % 50 = 0 group by q.vec_id""")
def result_envelope(spark, d):
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"))
    e = R.envelope(q, _weighted(spark, d))
    return e.select("qid", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"), "n_hits", F.array_join("suggestions", ",").alias("suggestions"))


@query(WEIGHTED + 'select qid % 200 as "group", string_agg(id::varchar, \',\' order by qid, rank) as ids from ranked where rank <= 3 group by 1')
def batch_groups(spark, d):
    hits = _weighted(spark, d).where("rank <= 3")
    g = hits.select("qid", (F.col("qid") % 200).alias("group")).distinct()
    return R.grouped(hits, g).select("group", F.array_join("ids", ",").alias("ids"))


@query(chunk_sql.INGEST)
def ingest_job(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("text").alias("document_type"), F.concat(F.lit("docs/"), "source").alias("path"), F.lit(None).cast("string").alias("team"))
    chunks, rejected = P.ingest(docs, HashingEncoder(32))
    taken = chunks.groupBy("doc_id", "collection").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("embedding").isNull()).alias("n_empty"))
    return taken.unionByName(rejected.select("doc_id", F.col("problem").alias("collection"), F.lit(0).cast("long").alias("n_chunks"), F.lit(0).cast("long").alias("n_empty")))


@query()
def answer_job(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("text").alias("document_type"), F.lit("docs/x").alias("path"), F.lit(None).cast("string").alias("team"))
    chunks, _ = P.ingest(docs, HashingEncoder(32))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits, gaps = P.answer(chunks, q, HashingEncoder(32), k=5)
    return hits.join(gaps.select("qid", "confidence", "has_gap"), "qid").select("qid", "id", "new_rank", F.round("rerank_score", 4).alias("score"), "confidence", "has_gap", "reason")


@query("with " + chunk_sql.recursive("select doc_id, text as t from documents") + " select doc_id, count(*)::bigint as n_chunks, case when doc_id % 3 = 0 then count(*) else 0 end::bigint as n_invalid from spans group by doc_id")
def model_aware_chunks(spark, d):
    """Chunks made under two models, and how many of them a change to the one invalidates."""
    chunks = recursive(table(spark, d, "documents"))
    third = F.col("doc_id") % 3 == 0
    made = with_model(chunks.where(third), "m1").unionByName(with_model(chunks.where(~third), "m2"))
    gone = invalidated(made, "m2").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = made.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).join(gone, "doc_id", "left")
    return rows.select("doc_id", "n_chunks", F.coalesce("n", F.lit(0).cast("long")).alias("n_invalid"))
