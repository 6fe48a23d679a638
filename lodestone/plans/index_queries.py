"""Indexes and batches that are kept as tables: they are built from the driver's tables in a shared folder, and asked there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import vector_index as V
from lodestone.operators.catalog import replicas_agree
from lodestone.functions import sketches as K
from lodestone.operators import intervals as I
from lodestone.operators import parsing as P
from lodestone.operators.postings import FieldIndex, Postings
from lodestone.operators.scorers import WordShareScorer, rerank_by_model
from lodestone.operators.search import lexical_search
from lodestone.plans import chunk_sql as X
from lodestone.plans.document_queries import marked
from lodestone.plans.registry import query, table
from lodestone.plans.search_queries import LEX, LEXICAL, TOPK, _asked, _chunks, _hits, boosted
from lodestone.sources import backups as B
from lodestone.sources.commits import CommitTable, Rejected
from lodestone.sources.io import scratch
from lodestone.streaming import replicas as R
from lodestone.streaming import sessions as SE
from lodestone.streaming import windows as S


@query(TOPK)
def indexed_topk(spark, d):
    """The ten nearest by a neighbour graph: built on some collections, the others inserted, all of it searched; what the walk misses is found within its bound."""
    chunks = _chunks(spark, d)
    index = V.VectorIndex(spark, scratch(spark))
    index.build(chunks.where("cast(collection as int) < 5"))
    index.insert(chunks.where("cast(collection as int) >= 5 or collection is null"))
    return _hits(index.search(_asked(chunks).drop("self_id"), 10, beam=256))


@query(LEXICAL)
def indexed_lexical_topk(spark, d):
    """The search of lexical_topk by an index that is written first: few documents are scored, and its rows are the same."""
    docs, asked = boosted(spark, d)
    return Postings(spark, scratch(spark)).build(docs).search(asked, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query("""select doc_id from documents where lang in ('en', 'de') and n_chars >= 500 and n_chars <= 20000 and contains(lower(source), 'rc1') and list_contains(list_transform(string_split(source, 'c'), lambda x: x), 'sr')""")
def field_index_filter(spark, d):
    """Documents by values of their fields, from the lists of an index alone."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "source", F.split("source", "c").alias("parts"))
    index = FieldIndex(spark, scratch(spark)).build(docs, ["lang", "n_chars", "source", "parts"])
    return index.filter({"lang": {"$in": ["en", "de"]}, "n_chars": {"$gte": 500, "$lte": 20000}, "source": {"$contains": "RC1"}, "parts": "sr"}).select(F.col("id").alias("doc_id"))


@query("""with v as (select 1 as version, doc_id, lang, length(text) as n from documents where lang = 'en'
  union all select 2, doc_id, lang, length(text) from documents
  union all select 3, doc_id, lang, case when lang = 'fr' then length(text) + 1 else length(text) end from documents where lang <> 'es')
select version, false as rejected, coalesce(lang, '-') as lang, count(*)::bigint as n_rows, sum(n)::bigint as n_chars from v group by all
union all select 1, true, 'known ids', count(*)::bigint, 0 from documents where lang = 'en' union all select 1, true, 'faulty rows', count(*)::bigint, 0 from documents where lang = 'es'""")
def commit_batches(spark, d):
    """Three batches committed and two rejected, one for ids that are there and one for faulty rows; every version is read again at the end."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    t = CommitTable(spark, scratch(spark), docs.schema)
    t.insert_batch(docs.where("lang = 'en'"), id="doc_id")
    faulty = docs.where("lang <> 'en'").withColumn("text", F.when(F.col("lang") != "es", F.col("text")))
    refused = []
    for batch in (docs, faulty):
        try:
            t.insert_batch(batch, F.when(F.col("text").isNull(), "no text"), id="doc_id")
        except Rejected as e:
            refused += [(t.version(), True, why, n, 0) for why, n in e.problems.items()]
    t.insert_batch(docs.where("lang <> 'en' or lang is null"), id="doc_id")
    t.change_batch(docs.where("lang = 'fr'").withColumn("text", F.concat("text", F.lit("."))), docs.where("lang = 'es'"), id="doc_id")
    read = [t.read(v).groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")).select(F.lit(v).alias("version"), F.lit(False).alias("rejected"), "lang", "n_rows", "n_chars") for v in (1, 2, 3)]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(spark.createDataFrame(refused, "version int, rejected boolean, lang string, n_rows long, n_chars long"))


def _second(docs):
    """The table a day later: texts of one source changed, another source gone, and copies of a third under new ids."""
    grown = docs.where("source = 'src2'").withColumn("doc_id", -F.col("doc_id") - 1)
    kept = docs.where("source <> 'src1' or source is null").withColumn("text", F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return kept.unionByName(grown)


@query("""with a as (select doc_id, source, text from documents),
b as (select doc_id, source, case when source = 'src3' then text || '!' else text end as text from a where source <> 'src1' or source is null union all select -doc_id - 1, source, text from a where source = 'src2'),
c as (select * from b where source <> 'src4' or source is null)
select 1 as number, 'full' as kind, doc_id, md5(text) as digest from a union all select 2, 'incremental', doc_id, md5(text) from b
union all select 3, 'incremental', doc_id, md5(text) from c union all select 4, 'differential', doc_id, md5(text) from a""")
def backup_chain(spark, d):
    """Four backups of a table that changes, each restored: full, two incremental, and one that differs from the full one in nothing."""
    first = table(spark, d, "documents").select("doc_id", "source", "text")
    second = _second(first)
    third = second.where("source <> 'src4' or source is null")
    chain = B.BackupChain(spark, scratch(spark), first.schema, "doc_id", buckets=512)
    made = [chain.backup(first, "full"), chain.backup(second), chain.backup(third), chain.backup(first, "differential")]
    out = [chain.restore(m["number"]).select(F.lit(m["number"]).alias("number"), F.lit(m["kind"]).alias("kind"), "doc_id", F.md5("text").alias("digest")) for m in made]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""select v.replica, v.step, count(*) filter (where v.all or batch <> 1)::bigint as n_rows, v.all as agrees
from (select (doc_id % 4 + 4) % 4 as batch from documents) x, (values (0, 'before', true), (1, 'before', false), (0, 'after', true), (1, 'after', true)) v(replica, step, "all") group by all""")
def replicated_sinks(spark, d):
    """Documents streamed to two sinks of which the second fails on one batch and is brought up again afterwards."""
    at, docs = scratch(spark), table(spark, d, "documents").select("doc_id", "source", "text")
    down = [True]

    def shaky(rows, folder, number):
        if number == 1 and down:
            down.pop()
            raise OSError("out of reach")
        rows.write.mode("overwrite").parquet(folder)

    sinks = [R.Sink(spark, f"{at}/a", docs.schema), R.Sink(spark, f"{at}/b", docs.schema, shaky)]
    for k in range(4):  # a batch of all files that have arrived since the one before
        docs.where(F.pmod("doc_id", F.lit(4)) == k).write.mode("append").parquet(f"{at}/in")
        R.replicate(S.read_stream(spark, f"{at}/in", docs.schema, files=None), sinks, f"{at}/state").awaitTermination()
    before = replicas_agree([s.read() for s in sinks]).select("replica", "n_rows", "agrees", F.lit("before").alias("step"))
    before = spark.createDataFrame(before.collect(), before.schema)  # two rows, as they are before the next step
    R.catch_up(R.first_healthy(sinks), sinks[1])
    return before.unionByName(replicas_agree([s.read() for s in sinks]).withColumn("step", F.lit("after")).select("replica", "n_rows", "agrees", "step"))


@query("""with o as (select user_id, ts, event_type, case when ts - lag(ts) over w >= interval 6 hour or lag(ts) over w is null then 1 else 0 end as new,
  case when lag(event_type) over w = event_type then 0 else 1 end as other from events where user_id is not null and ts is not null window w as (partition by user_id order by ts, event_type)),
s as (select *, sum(new) over (partition by user_id order by ts, event_type rows unbounded preceding) as session from o)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as "end", count(*)::bigint as n, string_agg(event_type, '>' order by ts, event_type) filter (where new = 1 or other = 1) as kinds from s group by user_id, session""")
def session_state(spark, d):
    """Sessions of users kept as state of a stream whose files hold the events in any order; a last event long after closes all of them."""
    at = scratch(spark)
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    span = e.agg(F.datediff(F.max("at"), F.min("at")).alias("days"), F.max("at").alias("last")).first()
    e.repartition(3).write.parquet(f"{at}/in")
    end = spark.createDataFrame([(None, span["last"])], "user_id long, at timestamp").select(F.lit(-1).cast("long").alias("user_id"), (F.col("at") + F.expr(f"interval {2 * (span['days'] or 0) + 60} days")).alias("at"), F.lit("end").alias("event_type"))
    end.write.mode("append").parquet(f"{at}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, SE.STORE)
    try:
        found = SE.open_sessions(S.read_stream(spark, f"{at}/in", e.schema, files=100), "user_id", "at", "event_type", 6 * 3600 * 1000, f"{(span['days'] or 0) + 1} days")
        found.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(f"{at}/out").where("key >= 0").select(F.col("key").alias("user_id"), shown("start"), shown("end"), "n", "kinds")


@query(LEX + """, r as (select *, row_number() over (partition by qid order by score desc, id) as rank from lex where score > 0),
h as (select r.*, asked.text as query, docs.text as content from r join asked on r.qid = asked.item_id join docs on r.id = docs.doc_id where rank <= 15),
w as (select *, list_distinct(list_filter(string_split(lower(query), ' '), lambda x: x <> '')) as q, list_distinct(string_split(lower(content), ' ')) as c from h),
m as (select *, case when length(content) > 6000 or len(q) = 0 then 0.5 else 1 / (1 + exp(-(6.0 * len(list_intersect(q, c)) / len(q) - 2.0))) end as s from w)
select qid, id, rank::int as rank, round(s, 6)::double as rerank_score, row_number() over (partition by qid order by s desc, rank)::int as new_rank from m""")
def model_rerank(spark, d):
    """The fifteen best documents of each query reranked by a scorer that fails on long texts."""
    docs, asked = boosted(spark, d)
    hits = lexical_search(docs, asked, 15).join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id").join(asked, "qid")
    found = rerank_by_model(hits, WordShareScorer(most=6000), batch=16)
    return found.select("qid", "id", "rank", F.round("rerank_score", 6).alias("rerank_score"), "new_rank")


@query("""with x as (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) - 1 as dim from embeddings), q as (select unnest([0.01, 0.25, 0.5, 0.75, 0.99]) as q)
select dim::int as dim, q::double as q, true as near, count(*)::bigint as n from x, q group by dim, q""")
def sketch_quantiles(spark, d):
    """Quantiles of all dimensions by sketches a label, merged; near: their ranks are right within the stated error, by counting the whole table."""
    v = table(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    whole = K.merged(K.sketched(v, ["label", "dim"], "x"), ["dim"])
    qs = F.array(*[F.struct(F.lit(q).alias("q"), K.quantile("sketch", q).alias("at")) for q in (0.01, 0.25, 0.5, 0.75, 0.99)])
    asked = whole.select("dim", K.count("sketch").alias("held"), F.inline(qs))
    ranked = v.join(asked, "dim").groupBy("dim", "q", "held").agg(F.avg((F.col("x") < F.col("at")).cast("int")).alias("low"), F.avg((F.col("x") <= F.col("at")).cast("int")).alias("high"), F.count("*").alias("n"))
    near = (F.col("low") - K.RANK_ERROR <= F.col("q")) & (F.col("q") <= F.col("high") + K.RANK_ERROR) & (F.col("held") == F.col("n"))
    return ranked.select(F.col("dim").cast("int").alias("dim"), "q", near.alias("near"), "n")


@query(X.UNITS)
def units_by_sql(spark, d):
    """Units by a table function that SQL calls for each document."""
    spark.udtf.register("atomic_units", P.unit_function())
    marked(spark, d).createOrReplaceTempView("marked_documents")
    return spark.sql("select doc_id, unit_index, kind, start, `end`, to_json(details) as details from marked_documents, lateral atomic_units(text)")


@query("""with e as (select event_id, user_id, value as s, value + 2.5 as t from events where event_type in ('purchase', 'signup') and user_id is not null)
select a.event_id, count(*)::bigint as n, sum(b.event_id)::bigint as others from e a join e b on a.user_id = b.user_id and a.event_id <> b.event_id and a.s < b.t and a.t > b.s group by a.event_id""")
def overlapping_ranges(spark, d):
    """Ranges of values of a user's events that overlap others of this user."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'signup') and user_id is not null").select("user_id", "event_id", F.col("value").alias("start"), (F.col("value") + 2.5).alias("end"))
    other = e.select("user_id", F.col("event_id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    met = I.overlapping(e, other, "user_id", 3).where("event_id <> other_id")
    return met.groupBy("event_id").agg(F.count("*").alias("n"), F.sum("other_id").alias("others"))
