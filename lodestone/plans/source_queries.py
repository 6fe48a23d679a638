"""Files, formats, snapshots, streams, archives and settings: what is written to a shared folder and read again has to equal its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metadata as M
from lodestone.operators import catalog as C
from lodestone.operators import models
from lodestone.operators import parsing as R
from lodestone.operators import projects as P
from lodestone.plans.registry import query, table
from lodestone.sources import io
from lodestone.streaming import windows as S


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "lang", "text")


@query("select n_nationkey::bigint as folder, 'text' as kind, length(n_name)::bigint as n, md5(n_name) as digest from nation where n_nationkey <> 3")
def folder_files(spark, d):
    """Text files in subfolders, found by a pattern, with their titles, kinds and contents."""
    at = io.scratch(spark)
    n = table(spark, d, "nation")
    n.select("n_nationkey", F.col("n_name").alias("value")).where("n_nationkey <> 3").write.partitionBy("n_nationkey").text(at)
    n.where("n_nationkey = 3").select(F.col("n_name").alias("other")).write.json(f"{at}/n_nationkey=3")
    files = io.read_folder(spark, at, "*.txt")
    return files.select(F.regexp_extract("path", "n_nationkey=(\\d+)", 1).cast("long").alias("folder"), "kind", (F.col("size") - 1).alias("n"), F.md5(F.regexp_replace("content", "\n$", "")).alias("digest"))


@query("select doc_id, source as collection, md5(text) as digest, 'json' as form from documents union all select doc_id, source, md5(text), 'csv' from documents")
def export_import(spark, d):
    """Documents written as JSON by collection and as CSV, read again."""
    at, docs = io.scratch(spark), _docs(spark, d).withColumnRenamed("source", "collection")
    io.write_json(docs, f"{at}/a.json", by="collection")
    io.write_csv(docs, f"{at}/b.csv")
    a = io.read_any(spark, f"{at}/a.json", "doc_id long, lang string, text string, collection string")
    b = io.read_any(spark, f"{at}/b.csv", "doc_id long, collection string, lang string, text string")
    out = lambda df, form: df.select("doc_id", "collection", F.md5("text").alias("digest"), F.lit(form).alias("form"))
    return out(a, "json").unionByName(out(b, "csv"))


@query("select doc_id, md5('## ' || source || chr(10) || chr(10) || '*Collection:* ' || lang || chr(10) || chr(10) || text || chr(10)) as digest from documents")
def markdown_export(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", F.md5(io.markdown_text("source", "text", "lang")).alias("digest"))


@query("""select doc_id, 'skip' as how, lang from documents union all select -1, 'skip', 'new' union all select doc_id, 'overwrite', case when doc_id % 2 = 0 then 'new' else lang end from documents union all select -1, 'overwrite', 'new'
union all select doc_id, 'merge', case when doc_id % 4 = 0 then 'new' else lang end from documents union all select -1, 'merge', 'new'""")
def import_strategies(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("lang")).unionByName(spark.createDataFrame([(-1, "new")], "doc_id long, lang string"))
    some = new.withColumn("lang", F.when(F.col("doc_id") % 4 != 2, F.col("lang")))
    made = [io.merge_import(docs, some if how == "merge" else new, how, "doc_id").withColumn("how", F.lit(how)) for how in ("skip", "overwrite", "merge")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("select doc_id, md5(text) as digest, count(*) over ()::bigint as n_rows from documents")
def snapshot_restore(spark, d):
    """A snapshot with its manifest, restored after its checksum was compared."""
    at = io.scratch(spark)
    manifest = io.snapshot(_docs(spark, d), at)
    return io.restore(spark, at).select("doc_id", F.md5("text").alias("digest"), F.lit(manifest["n_rows"]).alias("n_rows"))


@query("select n_regionkey::varchar as project, n_name as collection from nation where n_regionkey < 3")
def project_archive(spark, d):
    """Projects and their links archived and read again; links of projects that were deleted before stay away."""
    at, n = io.scratch(spark), table(spark, d, "nation")
    links = n.select(F.col("n_regionkey").cast("string").alias("project"), F.col("n_name").alias("collection"))
    projects = table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("project"), F.col("r_name").alias("title"))
    io.archive(projects, links, at)
    return io.unarchive(spark, at, "project string, title string", "project string, collection string")[1].select("project", "collection")


@query("select r_name as project, r_regionkey = 2 as is_current from region")
def current_project(spark, d):
    r = table(spark, d, "region").select(F.col("r_name").alias("project"), "r_regionkey")
    name = r.where("r_regionkey = 2").first()["project"]
    return P.with_current(r, name).select("project", "is_current")


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 'a,b' when c_custkey % 3 = 1 then 'd' || c_nationkey else '' end as collections from customer")
def project_defaults(spark, d):
    k = F.col("c_custkey")
    explicit = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    defaults = F.when(k % 3 == 1, F.array(F.concat(F.lit("d"), F.col("c_nationkey").cast("string"))))
    return table(spark, d, "customer").select(k.alias("id"), F.array_join(P.resolved_collections(explicit, defaults), ",").alias("collections"))


@query("select doc_id, array_to_string(list_filter([lang, source, case when lang = 'x' then null else 'x' end], lambda t: t is not null), ',') as tags from documents")
def tag_unions(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(R.tag_union(F.array("lang", "source"), F.array("source", F.lit("x"), "lang")), ",").alias("tags"))


@query("select doc_id, lang as a, 'high' || (doc_id % 2) as b, case when doc_id % 2 = 0 then source end as c, 'one' as d from documents")
def settings_layers(spark, d):
    """Settings of two layers: inner maps merge, later values win."""
    maps = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    low = maps(("x", maps(("a", F.col("lang")), ("b", F.lit("low")))), ("y", maps(("d", F.lit("one")))))
    even = maps(("x", maps(("b", F.lit("high0")))), ("z", maps(("c", F.col("source")))))
    odd = maps(("x", maps(("b", F.lit("high1")))))
    m = table(spark, d, "documents").select("doc_id", M.merged_settings(low, F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd)).alias("m"))
    at = lambda x, y: F.try_element_at(F.try_element_at("m", F.lit(x)), F.lit(y)).alias(y)
    return m.select("doc_id", at("x", "a"), at("x", "b"), at("z", "c"), at("y", "d"))


@query("select o_orderkey as model from orders where o_orderdate >= date '1996-01-01'")
def fingerprint_cleanup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("model"), F.col("o_orderdate").cast("date").alias("created_at"))
    return models.kept_fingerprints(o, F.lit("1996-01-01").cast("date")).select("model")


@query("""select page_id, md5(case page_id % 3 when 0 then regexp_replace(html, '<[^>]+>', '', 'g') when 1 then '<h1>' || page_id || '</h1>' || chr(10) || '<strong>' || md5(html) || '</strong>' else html end) as digest from pages""")
def parsers_by_kind(spark, d):
    i = F.col("page_id")
    marked = F.concat(F.lit("# "), i.cast("string"), F.lit("\n**"), F.md5("html"), F.lit("**"))
    p = table(spark, d, "pages").select("page_id", F.element_at(F.array(F.lit("html"), F.lit("markdown"), F.lit("other")), (i % 3 + 1).cast("int")).alias("kind"), F.when(i % 3 == 1, marked).otherwise(F.col("html")).alias("text"))
    read = R.parse_by_kind(F.col("kind"), "text", {"html": lambda t: F.regexp_replace(t, "<[^>]+>", ""), "markdown": R.markdown_to_html})
    return p.select("page_id", F.md5(read).alias("digest"))


@query("select doc_id, 'rule' as kind, 1::bigint as n from documents union all select doc_id, 'note', 2 from documents where doc_id % 2 = 0")
def unit_handlers(spark, d):
    """Kinds of units that a caller adds: rules, and notes by their first sign."""
    note = F.when(F.col("doc_id") % 2 == 0, "!! one\n!! two\n\n!! three").otherwise("plain")
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("first\n\n---\n"), note, F.lit("\n")).alias("text"))
    found = R.units(t, handlers={"rule": lambda line: line.strip() == "---", "note": lambda line: line.startswith("!!")})
    return found.where("kind in ('rule', 'note')").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("select doc_id, case when doc_id % 3 = 0 then 'bad yaml front matter' when doc_id % 3 = 1 then 'bad toml front matter' end as problem, case when doc_id % 3 = 2 then 'yaml' else 'none' end as kind from documents")
def frontmatter_problems(spark, d):
    """Broken front matter is a problem of its document, and the others go on."""
    head = F.element_at(F.array(F.lit("---\na: [1\n---\n"), F.lit("+++\na = \n+++\n"), F.lit("---\na: 1\n---\n")), (F.col("doc_id") % 3 + 1).cast("int"))
    f = R.frontmatter(table(spark, d, "documents").select("doc_id", F.concat(head, "text").alias("text")))
    return f.select("doc_id", F.regexp_extract("problem", "^[^:]*", 0).alias("problem"), "kind")


@query("select doc_id, md5(text) as digest from documents where text <> '' and length(text) <= 50000 and length(trim(text)) >= 10")
def stream_ingest(spark, d):
    """Documents taken in as a stream of files, batch by batch, without the faulty ones."""
    at, docs = io.scratch(spark), _docs(spark, d)
    files = S.write_arrivals(docs, f"{at}/in", 4)
    stream = S.read_stream(spark, f"{at}/in", docs.schema, files=files)
    S.ingest_stream(stream, f"{at}/out", f"{at}/state", lambda b: b.select("doc_id", F.md5("text").alias("digest")), C.document_problem(F.col("text"))).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("doc_id", "digest")


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M') as start, event_type, count(*)::bigint as n from events group by all")
def stream_windows(spark, d):
    """Counts by hour of a stream with a bound for late rows; what is open at the end is closed by a last row long after."""
    at = io.scratch(spark)
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    last = e.agg((F.max("at") + F.expr("interval 40 days")).alias("at")).select("at", F.lit("end").alias("event_type"))
    S.write_arrivals(e, f"{at}/in", 2)
    last.coalesce(1).write.mode("append").parquet(f"{at}/in")
    counts = S.tumbling(S.read_stream(spark, f"{at}/in", e.schema, files=None), "at", "1 hour", "event_type", late="1 day")
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").where("event_type <> 'end'").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("select md5(lower(trim(text))) as digest from documents group by 1")
def stream_keep_first(spark, d):
    """One of equal texts of a stream."""
    at = io.scratch(spark)
    docs = _docs(spark, d).select("text", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.pmod("doc_id", F.lit(50)).cast("int"))).alias("at"))
    files = S.write_arrivals(docs, f"{at}/in", 3)
    once = S.keep_first_stream(S.read_stream(spark, f"{at}/in", docs.schema, files=files), "at", "2 hours")
    once.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.md5(F.lower(F.trim("text"))).alias("digest"))
