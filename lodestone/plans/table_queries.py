"""Filters, joins, aggregates, windows and catalog operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import keep_first
from lodestone.operators import analytics as A
from lodestone.operators import catalog as C
from lodestone.operators import dedup as D
from lodestone.operators import filters as W
from lodestone.operators import models as M
from lodestone.operators import projects as P
from lodestone.operators.search import lexical_search, top_k
from lodestone.plans.registry import query, table
from lodestone.plans.search_queries import LEX, boosted


@query("select event_id, event_type, value from events where (event_type = 'click' and value > 20) or (event_type in ('view', 'purchase') and value between 5 and 10)")
def filter_and_or(spark, d):
    where = W.store_filter({"$or": [{"$and": [{"event_type": "CLICK"}, {"value": {"$gt": 20}}]}, {"event_type": {"$in": ["view", "purchase"]}, "value": {"$gte": 5, "$lte": 10}}]})
    return C.scan(table(spark, d, "events"), where=where, columns=["event_id", "event_type", "value"])


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_extract(props, '$.k')::double > 50 and contains(props, '\"k\"')")
def filter_json_path(spark, d):
    e = table(spark, d, "events")
    where = W.conjunction([("k", "greater_than", 50)], metadata="props") & W.has_keys("props", ["k"])
    return e.where(where).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id from events where ts > timestamp '2024-01-15' and event_type <> 'view'")
def filter_dates(spark, d):
    e = table(spark, d, "events").withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return e.where(W.conjunction([("at", "greater_than", "2024-01-15T00:00:00")]) & W.store_filter({"event_type": {"$ne": "view"}})).select("event_id")


@query("select page_id from pages where contains(lower(url), 'example') and (contains(lower(url), 'page') or contains(lower(url), 'ref')) ")
def filter_contains(spark, d):
    return table(spark, d, "pages").where(W.conjunction([("url", "contains", "EXAMPLE"), ("url", "contains_any", ["page", "ref"])])).select("page_id")


@query("select doc_id from documents where list_has_any([lang, source], ['fr', 'src3']) and list_has_all([lang, source, 'x'], ['x'])")
def filter_tags(spark, d):
    r = table(spark, d, "documents").withColumn("tags", F.array("lang", "source", F.lit("x")))
    return r.where(W.tags_match("tags", ["fr", "src3"]) & W.tags_match("tags", ["x"], every=True)).select("doc_id")


@query("select event_id from events where value < 60 and value + 10 > 50")
def filter_overlap(spark, d):
    return table(spark, d, "events").where(W.overlaps(F.col("value"), F.col("value") + 10, 50, 60)).select("event_id")


@query("select doc_id, source, n_chars from documents where lang = 'en' order by doc_id limit 25 offset 10")
def scan_page(spark, d):
    return C.scan(table(spark, d, "documents"), where=F.col("lang") == "en", limit=25, offset=10, columns=["doc_id", "source", "n_chars"], id="doc_id")


@query("select count(*)::bigint as n from documents where lang = 'de'")
def count_where(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").agg(F.count("*").alias("n"))


@query("select source as collection, count(*)::bigint as n_rows from documents group by source union all select 'empty', 0::bigint")
def collection_statistics(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("collection"))
    return C.statistics(rows, rows.distinct().unionByName(spark.createDataFrame([("empty",)], "collection string"))).select("collection", "n_rows")


TYPES = "case (regexp_extract(source, '(\\d+)', 1)::int) % 4 when 0 then 'fundamental' when 1 then 'reference' when 2 then 'temporary' end"


@query(f"""select coalesce(t, 'untyped') as collection_type, count(*)::bigint as n_collections, sum(n)::bigint as n_rows, string_agg(source, ',' order by source) as members
from (select source, {TYPES} as t, count(*) as n from documents group by all) group by 1""")
def type_summary(spark, d):
    k = F.regexp_extract("source", "(\\d+)", 1).cast("int") % 4
    t = F.when(k == 0, "fundamental").when(k == 1, "reference").when(k == 2, "temporary")
    return C.type_summary(table(spark, d, "documents").groupBy(F.col("source").alias("collection"), t.alias("collection_type")).agg(F.count("*").alias("n_rows")))


@query("""select doc_id as id, case when doc_id % 10 = 0 then upper(lang) else lang end as lang, case when doc_id % 10 = 0 then n_chars + 1 else n_chars end as n from documents
union all select -1 - doc_id, 'XX', 5 from documents where doc_id % 100 = 0""")
def upsert(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("n_chars").alias("n"))
    new = docs.where("id % 10 = 0").select("id", F.upper("lang").alias("lang"), (F.col("n") + 1).alias("n"))
    more = docs.where("id % 100 = 0").select((-1 - F.col("id")).alias("id"), F.lit("XX").alias("lang"), F.lit(5).cast("long").alias("n"))
    return C.upsert(docs, new.unionByName(more))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1) and lang <> 'es'")
def anti_delete(spark, d):
    docs = table(spark, d, "documents")
    gone = table(spark, d, "labels").where("toxic = 1")
    return C.delete(C.delete(docs, ids=gone, id="doc_id"), where=F.col("lang") == "es").select("doc_id")


@query("select case when label = 3 then 'three' else label::varchar end as collection, count(*)::bigint as n, count(*) filter (where label = 3)::bigint as n_renamed from embeddings group by label")
def rename_collection(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("collection"))
    return C.rename(e, "3", "three").groupBy("collection").agg(F.count("*").alias("n"), F.count("renamed_from").alias("n_renamed"))


@query("select case when source = 'src1' and doc_id::varchar like '2%' then 'moved' else source end as collection, count(*)::bigint as n from documents group by 1")
def move_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("collection"))
    return C.move(docs, "src1", "moved", "2*", ["doc_id"]).groupBy("collection").agg(F.count("*").alias("n"))


@query("""select vec_id, case when vec_id % 5 = 0 then 'no id' when vec_id % 5 = 1 then 'no content' when vec_id % 5 = 2 then 'other dimension' end as problem from embeddings""")
def append_checks(spark, d):
    e = table(spark, d, "embeddings")
    i = F.col("vec_id") % 5
    problem = C.append_problem(F.when(i != 0, F.col("vec_id")), F.when(i != 1, F.lit("x")), F.when(i == 2, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")), 64)
    return e.select("vec_id", problem.alias("problem"))


@query("""with t as (select doc_id, case doc_id % 9 when 0 then '' when 1 then '   ab   cd   ' when 2 then text || repeat('x', 50001) when 3 then null else text end as text, case when doc_id % 9 <> 4 then lang end as meta from documents)
select doc_id, case when text is null or text = '' then 'empty' when meta is null then 'no metadata' when length(text) > 50000 then 'too long' when length(trim(text)) < 10 then 'too short' end as problem from t""")
def ingest_checks(spark, d):
    """All documents, of which five of nine are spoilt in one way each."""
    i, t = F.pmod("doc_id", F.lit(9)), F.col("text")
    text = F.when(i == 0, "").when(i == 1, "   ab   cd   ").when(i == 2, F.concat(t, F.repeat(F.lit("x"), F.lit(50_001)))).when(i != 3, t)
    return table(spark, d, "documents").select("doc_id", C.document_problem(text, F.when(i != 4, F.col("lang"))).alias("problem"))


@query("select 'project-specific_' || regexp_replace(lower(source || ' X'), '[^a-z0-9_-]', '_', 'g') || '_v1' as name, 'reference_v1' as other, count(*)::bigint as n from documents group by source")
def collection_names(spark, d):
    n = C.collection_name(F.lit("project-specific"), F.concat("source", F.lit(" X")), F.lit("v1"))
    return table(spark, d, "documents").groupBy(n.alias("name"), C.collection_name(F.lit("reference"), F.lit("p"), F.lit("v1")).alias("other")).agg(F.count("*").alias("n"))


@query("select k as replica, n as n_rows, k < 2 as agrees from (values (0), (1), (2)) v(k), (select count(*)::bigint as n from nation)")
def replication_check(spark, d):
    n = table(spark, d, "nation")
    changed = n.withColumn(n.columns[1], F.when(F.col(n.columns[0]) == 1, "x").otherwise(F.col(n.columns[1])))
    return C.replicas_agree([n, n.repartition(3), changed]).select("replica", "n_rows", "agrees")


@query("""select source as collection, array_to_string(list_filter([case when metric <> 'cosine' then 'metric' end, case when m is null or m <> 16 then 'm' end], lambda x: x is not null), ',') as problems
from (select source, case when min(n_chars) > 30 then 'cosine' else 'l2' end as metric, case when count(*) % 3 = 0 then null else 16 - (count(*) % 3)::int + 1 end as m from documents group by source)""")
def settings_check(spark, d):
    """Settings of a catalogue of the sources against those that its type asks for."""
    n = F.count("*")
    c = table(spark, d, "documents").groupBy(F.col("source").alias("collection")).agg(F.when(F.min("n_chars") > 30, "cosine").otherwise("l2").alias("metric"), F.when(n % 3 != 0, (16 - n % 3 + 1).cast("int")).alias("m"))
    return C.settings_problems(c, {"metric": "cosine", "m": 16}).select("collection", F.array_join("problems", ",").alias("problems"))


@query("""select orders.o_orderkey as id from orders where o_orderdate >= (select max(o_orderdate) - interval 30 day from orders) qualify row_number() over (order by o_orderkey desc) <= 40""")
def backup_retention(spark, d):
    o = table(spark, d, "orders")
    last = o.agg(F.max("o_orderdate").alias("m")).first()["m"]
    return C.retained(o.where(F.col("o_orderdate") >= F.lit(last) - F.expr("interval 30 days")).select(F.col("o_orderkey").alias("id")), F.lit(0), 40, by="id")


# feedback: ratings from the event type, chunks are users
RATING = "case event_type when 'purchase' then 'positive' when 'signup' then 'positive' when 'error' then 'negative' else 'neutral' end"


def _feedback(spark, d):
    r = F.when(F.col("event_type").isin("purchase", "signup"), "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("chunk_id"), r.alias("rating"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("weight"), "event_type", "ts", "value", "user_id")


@query(f"""with f as (select user_id as chunk_id, case {RATING} when 'positive' then 1.0 when 'neutral' then 0.5 else 0 end as s, case when event_id % 3 <> 0 then value else 1 end as w from events),
g as (select chunk_id, sum(s * w) / sum(w) as q from f group by chunk_id), ids as (select distinct user_id as chunk_id from events union select -1)
select chunk_id, round(coalesce(q, 0.75), 6)::double as quality from ids left join g using (chunk_id)""")
def weighted_quality(spark, d):
    f = _feedback(spark, d)
    ids = f.select("chunk_id").distinct().unionByName(spark.createDataFrame([(-1,)], "chunk_id long"))
    return A.weighted_quality(ids, f).select("chunk_id", F.round("quality", 6).alias("quality"))


@query(f"""select event_type, strftime(ts, '%Y-%m-%d') as day, count(*)::bigint as n, round(avg(({RATING} = 'positive')::int), 6) as positive, round(avg(({RATING} = 'negative')::int), 6) as negative, round(avg(({RATING} = 'neutral')::int), 6) as neutral from events group by all""")
def feedback_analytics(spark, d):
    r = A.feedback_analytics(_feedback(spark, d), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return r.select("event_type", "day", "n", *[F.round(c, 6).alias(c) for c in ("positive", "negative", "neutral")])


GAPS = """with h as (select q.vec_id as qid, list_cosine_similarity(c.embedding::double[], q.embedding::double[]) as s from embeddings c, embeddings q where c.vec_id <> q.vec_id and q.vec_id % 20 = 0),
n as (select * from (select *, row_number() over (partition by qid order by s desc) as k from h) where k <= 6 and s >= 0.28),
g as (select q.vec_id as qid, count(s)::bigint as n_hits, max(s) as best from embeddings q left join n on q.vec_id = n.qid where q.vec_id % 20 = 0 group by q.vec_id),
r as (select *, case when best is null then 'none' when best >= 0.35 then 'high' when best >= 0.31 then 'medium' else 'low' end as confidence from g)
"""


@query(GAPS + """select qid, n_hits, round(best, 6) as best, confidence, n_hits = 0 as no_results, n_hits < 4 as sparse_results, coalesce(best < 0.31, true) as low_scores,
(n_hits < 4 or coalesce(best < 0.31, true)) and not (confidence = 'high' and n_hits > 0 and (n_hits >= 4 or n_hits >= 2)) as has_gap from r""")
def gap_analysis(spark, d):
    """Every twentieth vector as a query against all others; its six nearest from a similarity of 0.28 up are its hits."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("collection"), "embedding")
    q = e.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"), F.col("id").alias("self_id"))
    h = top_k(e, q, 6, not_self=True).withColumn("similarity", 1 - F.col("distance")).where("similarity >= 0.28")
    return A.gap_analysis(q, h, sparse=4, low=0.31, high=0.35).withColumn("best", F.round("best", 6))


@query(LEX + """, top as (select qid, id from (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from lex where score > 0) where rank <= 20),
h as (select top.qid, qw, list_intersect(qw, w) as found from top join q using (qid) join dd using (id)), g as (select qid, any_value(qw) as qw, avg(len(found) / len(qw)) as c, flatten(list(found)) as f from h group by qid)
select qid, round(c, 6)::double as coverage, array_to_string(list_sort(list_filter(qw, lambda x: not list_contains(f, x))), ' ') as missing from g""")
def coverage(spark, d):
    """How the twenty best documents of each query cover its words."""
    docs, q = boosted(spark, d)
    best = lexical_search(docs, q, 20).select("qid", F.col("id").alias("doc_id"))
    hits = best.join(docs, "doc_id").join(q, "qid").withColumnRenamed("text", "content")
    return A.coverage(hits).select("qid", F.round("coverage", 6).alias("coverage"), F.array_join("missing", " ").alias("missing"))


@query("""select count(*)::bigint as n, count(nullif(lang, ''))::bigint as n_lang, count(nullif(text, ''))::bigint as n_text, count(distinct source)::bigint as n_authors, (select count(distinct t) from (select unnest([lang, source]) as t from documents))::bigint as n_tags from documents""")
def registry_stats(spark, d):
    return A.registry_statistics(table(spark, d, "documents").withColumn("tags", F.array("lang", "source")), ["lang", "text"], author="source")


@query("select t as tag, count(*)::bigint as n from (select unnest([lang, source]) as t from documents) group by t order by n desc, t limit 5")
def top_tags(spark, d):
    return A.top_tags(table(spark, d, "documents").withColumn("tags", F.array("lang", "source")))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events order by ts desc, event_id limit 20")
def recent_documents(spark, d):
    return A.recent(table(spark, d, "events"), 20, "ts", "event_id").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by event_id) as a, row_number() over (partition by user_id order by event_id desc) as b, count(*) over (partition by user_id) as n from events),
g as (select user_id, max(n)::int as n, avg(value) filter (where a <= 10) as f, avg(value) filter (where b <= 10) as l from r group by user_id)
select user_id, n, round(f, 6) as first_mean, round(l, 6) as last_mean, case when n < 20 then 'too few' when l / f > 2 then 'major' when l / f > 1.5 then 'detected' else 'none' end as verdict from g""")
def latency_regression(spark, d):
    r = A.latency_regression(table(spark, d, "events"), "value", "event_id", "user_id")
    return r.select("user_id", "n", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"), "verdict")


@query("select event_type, count(*) filter (where value > 50)::bigint as hits, count(*) filter (where value <= 50)::bigint as misses, round(avg((value > 50)::int), 6) as hit_rate, round(avg(value), 6) as mean_seconds from events group by event_type")
def cache_statistics(spark, d):
    log = table(spark, d, "events").select("event_type", (F.col("value") > 50).alias("hit"), F.col("value").alias("seconds"))
    return A.cache_statistics(log, "event_type").select("event_type", "hits", "misses", F.round("hit_rate", 6).alias("hit_rate"), F.round("mean_seconds", 6).alias("mean_seconds"))


@query("select count(*)::bigint as n, count(*) filter (where length(text) >= 500)::bigint as kept, count(*) filter (where length(text) < 500)::bigint as filtered, count(*) filter (where trim(text) = '')::bigint as empty, round(avg((length(text) >= 500)::int), 6) as success_rate from documents")
def preparation_counters(spark, d):
    r = A.preparation_counters(table(spark, d, "documents"), F.when(F.length("text") >= 500, F.col("text")))
    return r.withColumn("success_rate", F.round("success_rate", 6))


@query("""with q as (select user_id as key, count(*) / 100 as f, (user_id % 40)::double as days from events group by user_id), p as (select *, 0.7 * f + 0.3 * greatest(0, 30 - days) / 30 as p from q)
select key, round(p, 6)::double as priority, round(0.8 * p, 6)::double as benefit from p order by p desc, key limit 10""")
def warm_up_plan(spark, d):
    q = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg((F.count("*") / 100).alias("frequency")).withColumn("days", (F.col("key") % 40).cast("double"))
    return A.warm_up_plan(q, 10).select("key", F.round("priority", 6).alias("priority"), F.round("benefit", 6).alias("benefit"))


@query("select o_orderkey as op, round(case when o_orderkey % 10 = 0 then 100 else (o_orderkey % 7) / (o_orderkey % 10) * 100 end, 4)::double as percent, round((o_orderkey % 7) / 5, 4)::double as per_second from orders")
def operation_progress(spark, d):
    k = F.col("o_orderkey")
    ops = table(spark, d, "orders").select(k.alias("op"), (k % 7).alias("done"), (k % 10).alias("total"), F.lit(5.0).alias("seconds"))
    return A.progress(ops).select("op", F.round("percent", 4).alias("percent"), F.round("per_second", 4).alias("per_second"))


@query("select event_type as kind, count(*)::bigint as n from events where value > 90 group by event_type")
def error_summary(spark, d):
    return A.error_summary(table(spark, d, "events").where("value > 90").withColumnRenamed("event_type", "kind"))


@query("""with m as (select n_nationkey as k, n_name from nation) select n_name as model_name, case when k % 5 = 4 then 'new_model' when k % 5 = 1 then 'version_update' when k % 5 = 2 then 'checksum_change' when k % 5 = 3 then 'config_change' else 'unchanged' end as change_type,
  k % 5 in (4, 1, 2) as requires_reindexing, case when k % 5 in (1, 2) then 'high' when k % 5 = 4 then 'medium' else 'low' end as impact from m""")
def model_changes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("model_name"))
    new = n.select("k", "model_name", F.lit("2").alias("version"), F.lit("c").alias("checksum"), F.lit("m").alias("metadata"))
    old = new.where("k % 5 <> 4").withColumn("version", F.when(F.col("k") % 5 == 1, "1").otherwise("2")).withColumn("checksum", F.when(F.col("k") % 5 == 2, "d").otherwise("c")).withColumn("metadata", F.when(F.col("k") % 5 == 3, "n").otherwise("m"))
    return M.changes(old, new)


@query("""select c_custkey as collection, case when c_custkey % 3 = 0 or c_nationkey >= 20 then true else c_custkey % 2 = 0 end as compatible, case when c_custkey % 3 = 0 or c_nationkey >= 20 then 'unknown model, check' when c_custkey % 2 = 0 then 'none' else 'reindex' end as advice,
  not (c_custkey % 3 = 0 or c_nationkey >= 20) and c_custkey % 2 <> 0 as blocked from customer""")
def model_compatibility(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("collection"), F.col("c_nationkey").alias("model_name"), F.when(k % 3 != 0, F.when(k % 2 == 0, "good").otherwise("bad")).alias("fingerprint"))
    f = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("model_name"), F.lit("good").alias("checksum"))
    return M.compatibility(c, f, strict=True)


@query("select o_orderkey as id, case when o_orderkey % 4 = 0 then true when o_orderkey % 4 = 1 then true else o_orderkey % 6 = 2 end as reindex from orders")
def reindex_rules(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), M.requires_reindexing(F.when(k % 4 == 1, "old").when(k % 4 != 0, "new"), F.lit("new"), F.when(k % 6 == 2, "pending").otherwise("completed")).alias("reindex"))


@query("""with c as (select n_nationkey as model_name, 3 * (c_custkey % (n_nationkey + 1)) as n, c_custkey / 10 as mb from customer join nation on c_nationkey = n_nationkey)
select n_nationkey as model_name, count(n)::bigint as n_collections, coalesce(sum(n), 0)::bigint as n_documents, round(coalesce(sum(mb), 0), 4)::double as mb, greatest(1, coalesce(sum(n), 0)::bigint // 50)::bigint as minutes,
  case when sum(n) > 1000 then 'high' when sum(n) > 100 then 'medium' else 'low' end as level from nation left join c on model_name = n_nationkey group by n_nationkey""")
def impact_assessment(spark, d):
    """Nations as models, their customers as collections of sizes that differ by nation."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    size = (3 * (F.col("c_custkey") % (F.col("n_nationkey") + 1))).alias("n_documents")
    r = M.impact(table(spark, d, "nation").select(F.col("n_nationkey").alias("model_name")), c.select(F.col("n_nationkey").alias("model_name"), size, (F.col("c_custkey") / 10).alias("mb")))
    return r.withColumn("mb", F.round("mb", 4))


@query("""with n as (select vec_id, label, embedding::double[] as a, case when vec_id % 50 = 7 then null when vec_id % 50 = 11 then embedding[1:3]::double[] else list_concat([embedding[1]::double + 0.1], embedding[2:]::double[]) end as b, vec_id % 50 <> 9 as there, case when vec_id % 50 not in (7, 9, 11) then list_cosine_similarity(embedding::double[], list_concat([embedding[1]::double + 0.1], embedding[2:]::double[])) end as c from embeddings)
select label::varchar as collection, count(*)::bigint as n, count(*) filter (where not there)::bigint as missing, count(*) filter (where there and b is null)::bigint as null_vectors, count(*) filter (where there and len(b) = 3)::bigint as other_dimension,
  round(avg(c), 6) as mean_cosine, round(min(c), 6) as min_cosine,
  case when count(*) filter (where not there or b is null or len(b) = 3) > 0 then 'failed' when avg(c) < 0.8 then 'warning' else 'passed' end as status from n group by label""")
def migration_check(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("collection"), F.col("embedding").cast("array<double>").alias("embedding"))
    moved = F.concat(F.array(F.element_at("embedding", 1) + 0.1), F.slice("embedding", 2, 1000))
    new = e.where("id % 50 <> 9").withColumn("embedding", F.when(F.col("id") % 50 == 11, F.slice("embedding", 1, 3)).when(F.col("id") % 50 != 7, moved))
    r = M.migration_check(e, new)
    return r.withColumn("mean_cosine", F.round("mean_cosine", 6)).withColumn("min_cosine", F.round("min_cosine", 6))


@query("select n_regionkey as project, count(distinct c_nationkey)::bigint as n_collections, count(*)::bigint as n_documents from customer join nation on c_nationkey = n_nationkey group by n_regionkey")
def project_totals(spark, d):
    links = table(spark, d, "nation").select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("collection"))
    stats = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("collection")).agg(F.count("*").alias("n_documents"))
    return P.overview(table(spark, d, "region").select(F.col("r_regionkey").alias("project")), links, stats)


@query("select n_regionkey as project, n_nationkey as collection from nation where n_nationkey % 3 <> 1 union all select 0, n_nationkey from nation where n_regionkey <> 0 and n_nationkey % 7 = 0")
def project_links(spark, d):
    n = table(spark, d, "nation")
    links = n.select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("collection"))
    new = n.where("n_nationkey % 7 = 0").select(F.lit(0).cast(links.schema["project"].dataType).alias("project"), F.col("n_nationkey").alias("collection")).unionByName(spark.createDataFrame([(0, 999)], "project long, collection long").select(F.col("project").cast(links.schema["project"].dataType), F.col("collection").cast(links.schema["collection"].dataType)))
    gone = n.where("n_nationkey % 3 = 1").select(F.col("n_regionkey").alias("project"), F.col("n_nationkey").alias("collection"))
    return P.link(P.unlink(links, gone), new, links)


@query("""with roots as (select distinct regexp_extract(url, '^[a-z]+://[^/]+', 0) as root, 'host' as project from pages union select distinct url[1:24], 'long' from pages union select distinct url[1:9], 'short' from pages union select 'ftp://', 'none'),
best as (select root, min(project) as project from roots group by root)
select page_id, (max({'n': length(root), 'p': project})).p as project from pages left join best on starts_with(url, root) group by page_id""")
def project_of_path(spark, d):
    """The longest of many roots, made of the hosts and beginnings of all pages, that a page's address begins with."""
    p = table(spark, d, "pages").select("page_id", "url")
    of = lambda root, name: p.select(root.alias("root"), F.lit(name).alias("project"))
    roots = of(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), "host").unionByName(of(F.substring("url", 1, 24), "long")).unionByName(of(F.substring("url", 1, 9), "short")).unionByName(of(F.lit("ftp://"), "none"))
    return P.project_of(p, roots, "page_id", "url")


@query("select n_nationkey as id, case when n_name like '%A%' then n_regionkey + 1 else n_regionkey end::int as version from nation")
def document_versions(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("content"), F.col("n_regionkey").cast("int").alias("version"))
    return D.next_version(n, n.select("id", F.replace("content", F.lit("A"), F.lit("B")).alias("content"))).select("id", "version")


DUP = "from (select doc_id, md5(lower(trim(text))) as g, text, n_chars from documents)"


@query(f"select g as group_id, count(*)::bigint as n {DUP} group by g having count(*) > 1")
def dup_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5(F.lower(F.trim("text"))).alias("group_id")).agg(F.count("*").alias("n")).where("n > 1")


@query("""select source as group_id, arg_max(doc_id, (n_chars, doc_id)) as latest, min(doc_id) as first_id, md5(string_agg(text, chr(10) || chr(10) order by doc_id)) as merged from documents group by source""")
def merge_strategies(spark, d):
    g = table(spark, d, "documents").select(F.col("source").alias("group_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("created"))
    a = D.merge(g, "latest_version").select("group_id", F.col("id").alias("latest"))
    b = D.merge(g, "first").select("group_id", F.col("id").alias("first_id"))
    c = D.merge(g, "content_union").select("group_id", F.md5("content").alias("merged"))
    return a.join(b, "group_id").join(c, "group_id")


@query("""with r as (select min(doc_id) as id, arg_min(text, doc_id) as t from documents group by md5(lower(trim(text)))),
w as (select id, list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '') as w from r), s as (select id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from w where len(w) > 0),
e as (select id, len(s) as n, unnest(s) as s from s), p as (select x.id as a, y.id as b, any_value(x.n) as n, any_value(y.n) as m, count(*) as c from e x join e y on x.s = y.s and x.id < y.id group by x.id, y.id)
select a, b, round(c / (n + m - c), 6) as similarity from p where c / (n + m - c) >= 0.8""")
def near_dup_pairs(spark, d):
    return D.near_pairs(table(spark, d, "documents")).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"select doc_id, min(doc_id) over (partition by g) as representative {DUP}")
def dup_members(spark, d):
    return D.members(table(spark, d, "documents"))


@query("""select label::varchar as collection, count(*) filter (where s >= 0.4)::bigint as n_duplicates
from (select a.vec_id, a.label, max(list_cosine_similarity(a.embedding::double[], b.embedding::double[])) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 4 = 0 group by all) group by 1""")
def duplicate_gate(spark, d):
    """Every fourth vector as a new one, held against its nearest among all others."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("collection"), "embedding")
    new = e.where("id % 4 = 0")
    near = top_k(e, new.select(F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"), F.col("id").alias("self_id")), 1, not_self=True)
    hits = near.select(F.col("qid").alias("id"), "distance")
    return D.duplicate_gate(new, hits, least_similarity=0.4).groupBy("collection").agg(F.count_if("is_duplicate").alias("n_duplicates"))


@query("""with l as (select doc_id, source, lag(n_chars) over w as before, lead(n_chars) over w as after from documents window w as (partition by source order by doc_id))
select source, sum(coalesce(before, 0))::bigint as before, sum(coalesce(after, 0))::bigint as after from l group by source""")
def neighbours(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    r = table(spark, d, "documents").select("source", F.lag("n_chars").over(w).alias("before"), F.lead("n_chars").over(w).alias("after"))
    return r.groupBy("source").agg(F.sum(F.coalesce("before", F.lit(0))).alias("before"), F.sum(F.coalesce("after", F.lit(0))).alias("after"))


@query("""with m as (select *, max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) as top from (select user_id, event_id, floor(value)::bigint as s, floor(value)::bigint + 3 as e from events)),
i as (select *, sum((top is null or s > top)::int) over (partition by user_id order by s, event_id) as island from m)
select user_id, min(s)::bigint as low, max(e)::bigint as high, count(*)::bigint as n from i group by user_id, island""")
def merged_intervals(spark, d):
    from lodestone.operators.intervals import merge_overlapping

    e = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("low"), (F.floor("value") + 3).alias("high"))
    return merge_overlapping(e, ["user_id"], "low", "high", "event_id")


@query("select lang, doc_id from documents qualify row_number() over (partition by md5(lower(trim(text))) order by doc_id) = 1 and lang in ('en', 'de')")
def set_operations(spark, d):
    docs = keep_first(table(spark, d, "documents")).select("lang", "doc_id")
    return docs.where("lang = 'en'").unionByName(docs.where("lang = 'de'")).intersect(docs).exceptAll(docs.where("lang = 'fr'"))
