"""Search, ranking and fusion over the embeddings and documents tables. The label of a vector is its collection; queries are the rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine_similarity, dimension_stats, distance, normalise, principal_components
from lodestone.operators import search as S
from lodestone.operators.filters import conjunction
from lodestone.plans.registry import query, table

SIM = "list_cosine_similarity(c.embedding::double[], q.embedding::double[])"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("collection"), "embedding")


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.pmod("id", F.lit(100)) == 0).select(F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"), F.col("id").alias("self_id"))


def _hits(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("qid", "id", "collection", F.round(1 - F.col("distance"), 6).alias("similarity"), "rank", *more)


TOPK = f"""
select qid, id, collection, round(similarity, 6) as similarity, rank from (
  select q.vec_id as qid, c.vec_id as id, c.label::varchar as collection, {SIM} as similarity,
    row_number() over (partition by q.vec_id order by 1 - {SIM}, c.vec_id)::int as rank
  from embeddings c, embeddings q where q.vec_id % 100 = 0) where rank <= 10"""


@query(TOPK)
def vector_topk(spark, d):
    chunks = _chunks(spark, d)
    return _hits(S.top_k(chunks, _asked(chunks).drop("self_id"), 10))


@query(f"""
select qid, id, collection, round(similarity, 6) as similarity, rank from (
  select q.vec_id as qid, c.vec_id as id, c.label::varchar as collection, {SIM} as similarity,
    row_number() over (partition by q.vec_id, c.label order by 1 - {SIM}, c.vec_id)::int as rank
  from embeddings c, embeddings q where q.vec_id % 100 = 0) where rank <= 3""")
def multi_collection_topk(spark, d):
    chunks = _chunks(spark, d)
    return _hits(S.top_k(chunks, _asked(chunks).drop("self_id"), 3, per_collection=True))


@query(f"""
select qid, id, collection, round(similarity, 6) as similarity, rank from (
  select q.vec_id as qid, c.vec_id as id, c.label::varchar as collection, {SIM} as similarity,
    row_number() over (partition by q.vec_id order by 1 - {SIM}, c.vec_id)::int as rank
  from embeddings c, embeddings q where q.vec_id in (3, 7, 11) and c.vec_id <> q.vec_id) where rank <= 5""")
def similar_by_id(spark, d):
    return _hits(S.similar_by_id(_chunks(spark, d), [3, 7, 11], 5))


@query(f"""
select qid, id, collection, round(similarity, 6) as similarity, rank from (
  select q.vec_id as qid, c.vec_id as id, c.label::varchar as collection, {SIM} as similarity,
    row_number() over (partition by q.vec_id order by 1 - {SIM}, c.vec_id)::int as rank
  from embeddings c, embeddings q where q.vec_id % 100 = 0 and c.label in (1, 3, 5) and c.vec_id > 50) where rank <= 5""")
def filtered_topk(spark, d):
    chunks = _chunks(spark, d)
    where = conjunction([("collection", "in", ["1", "3", "5"]), ("id", "gt", 50)])
    return _hits(S.top_k(chunks, _asked(chunks).drop("self_id"), 5, where=where))


@query("""
select qid, id, round(dist, 5) as dist, rank from (
  select q.vec_id as qid, c.vec_id as id, list_distance(c.embedding::double[], q.embedding::double[]) ** 2 as dist,
    row_number() over (partition by q.vec_id order by list_distance(c.embedding::double[], q.embedding::double[]) ** 2, c.vec_id)::int as rank
  from embeddings c, embeddings q where q.vec_id % 100 = 0 and c.vec_id <> q.vec_id) where rank <= 5""")
def l2_topk(spark, d):
    chunks = _chunks(spark, d)
    return S.top_k(chunks, _asked(chunks), 5, metric="l2", not_self=True).select("qid", "id", F.round("distance", 5).alias("dist"), "rank")


WEIGHTED = f"""
with hits as (select q.vec_id as qid, c.vec_id as id, c.label::varchar as collection, {SIM} as s,
    row_number() over (partition by q.vec_id, c.label order by 1 - {SIM}, c.vec_id) as rn
  from embeddings c, embeddings q where q.vec_id % 100 = 0),
weighted as (select qid, id, collection, s * case collection when '1' then 2.0 when '2' then 0.5 else 1.0 end as similarity from hits where rn <= 5),
ranked as (select *, row_number() over (partition by qid order by similarity desc, id)::int as rank from weighted where similarity >= 0.1)
"""


def _weighted(spark, d):
    chunks = _chunks(spark, d)
    return S.similarity_search(chunks, _asked(chunks).drop("self_id"), 5, weights={"1": 2.0, "2": 0.5}, threshold=0.1)


def _out(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("qid", "id", "collection", F.round("similarity", 6).alias("similarity"), "rank", *more)


@query(WEIGHTED + "select qid, id, collection, round(similarity, 6) as similarity, rank from ranked")
def weighted_merge(spark, d):
    return _out(_weighted(spark, d))


@query(WEIGHTED + "select qid, id, collection, round(similarity, 6) as similarity, rank from ranked where (rank - 1) % 2 = 0 and (rank - 1) / 2 < 4")
def diversified_limit(spark, d):
    return _out(S.limited(_weighted(spark, d), "diversified", 4))


@query(WEIGHTED + "select qid, id, collection, round(similarity, 6) as similarity, rank from ranked where similarity >= 0.4 and rank <= 6")
def threshold_limit(spark, d):
    return _out(S.limited(_weighted(spark, d), "threshold_based", 6, threshold=0.4))


@query(WEIGHTED + """select qid, id, collection, round(similarity, 6) as similarity, rank, total, total > 10 as has_next, true as has_previous
from (select *, count(*) over (partition by qid) as total from ranked) where rank > 5 and rank <= 10""")
def page_offset(spark, d):
    return _out(S.page(_weighted(spark, d), 2, 5), "total", "has_next", "has_previous")


@query(WEIGHTED + "select qid, collection, count(*)::bigint as n_hits, round(avg(similarity), 6) as mean_similarity from ranked group by all")
def hit_distribution(spark, d):
    return _weighted(spark, d).groupBy("qid", "collection").agg(F.count("*").alias("n_hits"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


@query(WEIGHTED + """, scored as (select *, 1 / (1 + exp(-(4 * similarity - (id % 7) * 0.3))) as rr from ranked where rank <= 20),
re as (select *, row_number() over (partition by qid order by rr desc, rank)::int as new_rank from scored)
select qid, id, new_rank, round(rr, 6) as rerank_score, round(rr - similarity, 6) as improvement from re where new_rank <= 5 and (rr >= 0.6 or new_rank = 1)""")
def rerank_keep_best(spark, d):
    scorer = S.sigmoid_score(4 * F.col("similarity") - F.pmod("id", F.lit(7)) * 0.3)
    rows = S.rerank(_weighted(spark, d), scorer, candidates=20, top=5, least=0.6)
    return rows.select("qid", "id", "new_rank", F.round("rerank_score", 6).alias("rerank_score"), F.round("improvement", 6).alias("improvement"))


@query(WEIGHTED + """select qid, count(*)::bigint as n_hits, round(avg((s > 0.8)::int), 4) as high, round(avg((s > 0.5 and s <= 0.8)::int), 4) as medium,
  round(avg((s <= 0.5)::int), 4) as low, round(count(distinct collection) / count(*), 3) as diversity, round(avg(similarity), 3) as relevance from (select *, round(similarity, 9) as s from ranked) group by qid""")
def confidence_distribution(spark, d):
    s = F.round("similarity", 9)
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    return _weighted(spark, d).groupBy("qid").agg(
        F.count("*").alias("n_hits"), share(s > 0.8).alias("high"), share((s > 0.5) & (s <= 0.8)).alias("medium"), share(s <= 0.5).alias("low"),
        F.round(F.countDistinct("collection") / F.count("*"), 3).alias("diversity"), F.round(F.avg("similarity"), 3).alias("relevance"),
    )


#: documents and queries of which some hold terms that raise scores
BOOSTED = """
with docs as (select doc_id, case doc_id % 7 when 0 then text || ' neural algorithm' when 1 then 'machine learning ' || text else text end as text from documents),
asked as (select item_id, case item_id % 3 when 0 then text || ' neural' when 1 then text || ' machine learning algorithm' else text end as text from benchmark),
"""
LEX = BOOSTED + """
q as (select item_id as qid, lower(text) as q, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) as qw from asked),
dd as (select doc_id as id, lower(text) as t, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) as w,
  array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')[1:10], ' ') as head from docs),
lex as (select qid, id, least(1.0, len(list_intersect(qw, w)) / len(qw)
  + case when contains(q, 'neural') and contains(t, 'neural') then 0.3 else 0 end
  + case when contains(q, 'machine learning') and contains(t, 'machine learning') then 0.4 else 0 end
  + case when contains(q, 'algorithm') and contains(t, 'algorithm') then 0.2 else 0 end
  + case when len(list_filter(qw, lambda x: contains(head, x))) > 0 then 0.2 else 0 end) as score from q, dd)
"""


def boosted(spark, d):
    """(documents, queries (qid, query))"""
    i, j, t = F.pmod("doc_id", F.lit(7)), F.pmod("item_id", F.lit(3)), F.col("text")
    docs = table(spark, d, "documents").select("doc_id", F.when(i == 0, F.concat(t, F.lit(" neural algorithm"))).when(i == 1, F.concat(F.lit("machine learning "), t)).otherwise(t).alias("text"))
    more = F.when(j == 0, F.concat(t, F.lit(" neural"))).when(j == 1, F.concat(t, F.lit(" machine learning algorithm"))).otherwise(t)
    return docs, table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), more.alias("query"))


LEXICAL = LEX + "select qid, id, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by score desc, id)::int as rank from lex where score > 0) where rank <= 10"


@query(LEXICAL)
def lexical_topk(spark, d):
    return S.lexical_search(*boosted(spark, d), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


#: dense: the nearest vectors; sparse: documents by the words of the query's own text, where a document's id is that of its vector
FUSE = f"""
with dense as (select q.vec_id as qid, c.vec_id as id, {SIM} as score from embeddings c, embeddings q where q.vec_id % 100 = 0),
dr as (select *, row_number() over (partition by qid order by score desc, id) - 1 as rk from dense),
d as (select * from dr where rk < 20),
w as (select doc_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) as w,
  array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')[1:10], ' ') as head from documents),
lex as (select a.doc_id as qid, b.doc_id as id, least(1.0, len(list_intersect(a.w, b.w)) / len(a.w) + case when len(list_filter(a.w, lambda x: contains(b.head, x))) > 0 then 0.2 else 0 end) as score
  from w a join embeddings e on e.vec_id = a.doc_id and e.vec_id % 100 = 0, w b where len(a.w) > 0),
sr as (select * from (select *, row_number() over (partition by qid order by score desc, id) - 1 as rk from lex where score > 0) where rk < 20),
"""


def _both(spark, d):
    chunks = _chunks(spark, d)
    asked = _asked(chunks).drop("self_id")
    dense = S.top_k(chunks, asked, 20).select("qid", "id", (1 - F.col("distance")).alias("score"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    texts = docs.join(asked.select(F.col("qid").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("qid"), F.col("text").alias("query"))
    return dense, S.lexical_search(docs, texts, 20).select("qid", "id", "score")


@query(FUSE + """x as (select coalesce(d.qid, sr.qid) as qid, coalesce(d.id, sr.id) as id, coalesce(0.7 / (60 + d.rk + 1), 0) + coalesce(0.3 / (60 + sr.rk + 1), 0) as score
from d full join sr on d.qid = sr.qid and d.id = sr.id) select qid, id, round(score, 8) as score from x""")
def rrf_fusion(spark, d):
    return S.reciprocal_rank_fusion(*_both(spark, d)).select("qid", "id", F.round("score", 8).alias("score"))


@query(FUSE + """x as (select coalesce(d.qid, sr.qid) as qid, coalesce(d.id, sr.id) as id, coalesce(0.7 * d.score, 0) + coalesce(0.3 * sr.score, 0) as score
from d full join sr on d.qid = sr.qid and d.id = sr.id) select qid, id, round(score, 6) as score from x""")
def weighted_fusion(spark, d):
    return S.weighted_fusion(*_both(spark, d)).select("qid", "id", F.round("score", 6).alias("score"))


@query("""
with x as (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings)
select dim::int as dim, round(min(x), 6) as min_x, round(max(x), 6) as max_x, round(avg(x), 6) as mean_x, round(stddev_pop(x), 6) as std_x,
  round(quantile_cont(x, 0.25), 6) as q25, round(median(x), 6) as median_x, round(quantile_cont(x, 0.75), 6) as q75 from x group by dim""")
def embedding_stats(spark, d):
    s = dimension_stats(table(spark, d, "embeddings"))
    return s.select(F.col("dim").cast("int").alias("dim"), *[F.round(c, 6).alias(c) for c in s.columns if c != "dim"])


def _norm_sql(centre: str, spread: str) -> str:
    return f"""
with x as (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
s as (select dim, {centre} as c, {spread} as s from x group by dim)
select vec_id, dim::int as dim, round((x - c) / case when s = 0 then 1 else s end, 5) as value from x join s using (dim)"""


def _normal(spark, d, method):
    return normalise(table(spark, d, "embeddings").select("vec_id", "embedding"), method).select("vec_id", F.posexplode("embedding").alias("dim", "v")).select("vec_id", "dim", F.round("v", 5).alias("value"))


@query("""with x as (select vec_id, embedding::double[] as e, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings)
select vec_id, dim::int as dim, round(x / sqrt(list_dot_product(e, e)), 5) as value from x""")
def norm_unit(spark, d):
    return _normal(spark, d, "unit")


@query(_norm_sql("min(x)", "max(x) - min(x)"))
def norm_min_max(spark, d):
    return _normal(spark, d, "min_max")


@query(_norm_sql("avg(x)", "stddev_pop(x)"))
def norm_z_score(spark, d):
    return _normal(spark, d, "z_score")


@query(_norm_sql("median(x)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"))
def norm_robust(spark, d):
    return _normal(spark, d, "robust")


@query()
def pca_project(spark, d):
    return principal_components(table(spark, d, "embeddings"), 8).select("vec_id", F.transform("projected", lambda x: F.round(x, 4)).alias("projected"))


@query()
def pca_share(spark, d):
    """As few components as explain half of the variance."""
    return principal_components(table(spark, d, "embeddings"), 0.5).select("vec_id", F.transform("projected", lambda x: F.round(x, 4)).alias("projected"))


@query("""
select a.vec_id, b.vec_id as other_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine,
  round(list_distance(a.embedding::double[], b.embedding::double[]) ** 2, 5) as l2, round(1 - list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as ip
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def vector_distances(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    j = a.join(b, F.col("other_id") == F.col("vec_id") + 1)
    return j.select("vec_id", "other_id", F.round(cosine_similarity("embedding", "other"), 6).alias("cosine"), F.round(distance("embedding", "other", "l2"), 5).alias("l2"), F.round(distance("embedding", "other", "ip"), 6).alias("ip"))


@query(WEIGHTED + """select qid, sum(n)::bigint as used, count(*)::bigint as packed from (
select r.qid, length(d.text) as n, sum(length(d.text)) over (partition by r.qid order by r.rank) as used from ranked r join documents d on r.id = d.doc_id) where used <= 6000 group by qid""")
def packed_context(spark, d):
    """The texts of the hits that fit into 6,000 characters; a document's id is that of its vector."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return S.packed_context(_weighted(spark, d).join(texts, "id"), 6000).groupBy("qid").agg(F.sum(F.length("content")).alias("used"), F.count("*").alias("packed"))


@query(WEIGHTED + """select qid, round(avg(similarity) filter (where rank <= 3), 6) as first_mean, round(avg(similarity) filter (where back <= 3), 6) as last_mean
from (select *, row_number() over (partition by qid order by rank desc) as back from ranked) group by qid""")
def first_last_avg(spark, d):
    back = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank")))
    rows = _weighted(spark, d).withColumn("back", back)
    return rows.groupBy("qid").agg(F.round(F.avg(F.when(F.col("rank") <= 3, F.col("similarity"))), 6).alias("first_mean"), F.round(F.avg(F.when(F.col("back") <= 3, F.col("similarity"))), 6).alias("last_mean"))
