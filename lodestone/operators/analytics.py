"""Analytics over hits, documents, feedback and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.search import tokens


def gap_analysis(queries: DataFrame, hits: DataFrame, sparse: int = 3, low: float = 0.4, high: float = 0.7, override: int = 2) -> DataFrame:
    """queries (qid), hits (qid, similarity) -> (qid, n_hits, best, confidence, no_results, sparse_results, low_scores, has_gap)."""
    agg = hits.groupBy("qid").agg(F.count("*").alias("n_hits"), F.max("similarity").alias("best"))
    r = queries.select("qid").join(agg, "qid", "left").na.fill(0, ["n_hits"])
    confidence = F.when(F.col("best").isNull(), "none").when(F.col("best") >= high, "high").when(F.col("best") >= low, "medium").otherwise("low")
    r = r.withColumn("confidence", confidence).withColumn("no_results", F.col("n_hits") == 0).withColumn("sparse_results", F.col("n_hits") < sparse)
    r = r.withColumn("low_scores", F.coalesce(F.col("best") < low, F.lit(True)))
    trusted = (F.col("confidence") == "high") & ~F.col("no_results") & (~F.col("sparse_results") | (F.col("n_hits") >= override))
    return r.withColumn("has_gap", (F.col("no_results") | F.col("sparse_results") | F.col("low_scores")) & ~trusted)


def research_suggestions(gaps: DataFrame, query: str = "query") -> DataFrame:
    """Two rows for each query with a gap, the more urgent first."""
    rows = F.array(
        F.struct(F.lit(1).alias("priority"), F.format_string('Search recent publications on "%s"', F.col(query)).alias("suggestion")),
        F.struct(F.lit(2).alias("priority"), F.format_string('Look for overviews and tutorials about "%s"', F.col(query)).alias("suggestion")),
    )
    return gaps.where("has_gap").select("qid", F.inline(rows))


def coverage(hits: DataFrame, query: str = "query", content: str = "content") -> DataFrame:
    """(qid, coverage, missing): mean share of query words in a hit, and query words that no hit has."""
    h = hits.select("qid", tokens(query).alias("q"), tokens(content).alias("w"))
    h = h.select("qid", "q", F.array_intersect("q", "w").alias("found"))
    g = h.groupBy("qid").agg(F.avg(F.size("found") / F.nullif(F.size("q"), F.lit(0))).alias("coverage"), F.max("q").alias("q"), F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"))
    return g.select("qid", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.sort_array(F.array_except("q", "found")).alias("missing"))


def weighted_quality(chunks: DataFrame, feedback: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(id, quality): mean of 1, 0.5, 0 for positive, neutral, other ratings by weight (1 if null); 0.75 without feedback."""
    s = F.when(F.col("rating") == "positive", 1.0).when(F.col("rating") == "neutral", 0.5).otherwise(0.0)
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    g = feedback.groupBy(id).agg(F.sum(s * w).alias("s"), F.sum(w).alias("w"))
    return chunks.select(id).join(g, id, "left").select(id, F.coalesce(F.col("s") / F.nullif(F.col("w"), F.lit(0.0)), F.lit(0.75)).alias("quality"))


def feedback_analytics(feedback: DataFrame, *by: Column | str) -> DataFrame:
    """Totals and shares of ratings by any columns (reason, user, chunk, period)."""
    share = lambda r: F.avg((F.col("rating") == r).cast("int"))
    return feedback.groupBy(*by).agg(F.count("*").alias("n"), share("positive").alias("positive"), share("negative").alias("negative"), share("neutral").alias("neutral"))


def registry_statistics(docs: DataFrame, fields: list[str], tags: str = "tags", author: str = "author") -> DataFrame:
    """One row: documents, how many have each field, its share, distinct tags and authors."""
    there = [F.count(F.nullif(F.col(f).cast("string"), F.lit(""))).alias(f"n_{f}") for f in fields]
    total = docs.agg(F.count("*").alias("n"), *there, F.countDistinct(author).alias("n_authors"))
    kinds = docs.select(F.explode(tags).alias("t")).agg(F.countDistinct("t").alias("n_tags"))
    return total.crossJoin(F.broadcast(kinds))


def top_tags(docs: DataFrame, k: int = 5, tags: str = "tags") -> DataFrame:
    return docs.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def recent(docs: DataFrame, k: int, by: str, id: str) -> DataFrame:
    return docs.where(F.col(by).isNotNull()).orderBy(F.desc(by), id).limit(k)


def latency_regression(runs: DataFrame, value: str, order: str, by: str, window: int = 10) -> DataFrame:
    """(by, n, first_mean, last_mean, verdict): from 20 runs on, the last against the first ten: over 1.5 times detected, over 2 times major."""
    up, down = (Window.partitionBy(by).orderBy(o) for o in (F.col(order), F.desc(order)))
    r = runs.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).where((F.col("a") <= window) | (F.col("b") <= window))
    g = r.groupBy(by).agg(F.max(F.col("a") + F.col("b") - 1).alias("n"), F.avg(F.when(F.col("a") <= window, F.col(value))).alias("first_mean"), F.avg(F.when(F.col("b") <= window, F.col(value))).alias("last_mean"))
    ratio = F.try_divide("last_mean", "first_mean")
    return g.withColumn("verdict", F.when(F.col("n") < 2 * window, "too few").when(ratio > 2, "major").when(ratio > 1.5, "detected").otherwise("none"))


def cache_statistics(log: DataFrame, *by: Column | str) -> DataFrame:
    """log (hit boolean, seconds) -> hits, misses, hit rate and mean time."""
    return log.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("seconds").alias("mean_seconds"))


def preparation_counters(docs: DataFrame, cleaned: Column, text: str = "text") -> DataFrame:
    """One row: documents, kept, filtered and empty ones, and the share kept."""
    r = docs.select(cleaned.alias("c"), F.col(text).alias("t"))
    return r.agg(F.count("*").alias("n"), F.count("c").alias("kept"), F.count_if(F.col("c").isNull()).alias("filtered"), F.count_if(F.coalesce(F.trim("t"), F.lit("")) == "").alias("empty"), F.avg(F.col("c").isNotNull().cast("int")).alias("success_rate"))


def warm_up_plan(queries: DataFrame, k: int) -> DataFrame:
    """queries (key, frequency, days) -> the k of highest priority (0.7 x frequency + 0.3 x what is left of 30 days) with the benefit expected."""
    p = 0.7 * F.col("frequency") + 0.3 * F.greatest(F.lit(0.0), 30.0 - F.col("days")) / 30
    return queries.withColumn("priority", p).withColumn("benefit", 0.8 * p).orderBy(F.desc("priority"), "key").limit(k)


def refinements(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, suggestions): what to change about a query, from its number of hits, their mean distance and collections."""
    g = hits.groupBy("qid").agg(F.count("*").alias("n"), F.avg("distance").alias("d"), F.countDistinct("collection").alias("c"))
    r = queries.select("qid").join(g, "qid", "left").na.fill(0, ["n", "c"])
    found = F.array_compact(F.array(
        F.when(F.col("n") == 0, "expand_scope"), F.when(F.col("n") == 0, "refine_terms"), F.when(F.col("n").between(1, 2), "expand_scope"),
        F.when(F.col("d") > 0.7, "refine_terms"), F.when(F.col("c") > 2, "add_filter"),
    ))
    return r.select("qid", F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.array(F.lit("add_context"))).alias("suggestions"))


def progress(operations: DataFrame) -> DataFrame:
    """operations (done, total, seconds) with per cent (100 of nothing), items per second and seconds left."""
    share = F.coalesce(F.col("done") / F.nullif(F.col("total"), F.lit(0)) * 100, F.lit(100.0))
    rate = F.try_divide("done", "seconds")
    return operations.withColumn("percent", share).withColumn("per_second", rate).withColumn("seconds_left", F.try_divide(F.col("total") - F.col("done"), rate))


def error_summary(errors: DataFrame, kind: str = "kind") -> DataFrame:
    return errors.groupBy(kind).agg(F.count("*").alias("n"))


def history_search(history: DataFrame, part: str, k: int, text: str = "query", by: str = "asked_at", id: str = "id") -> DataFrame:
    """The newest k queries that hold a text in any case."""
    return history.where(F.contains(F.lower(text), F.lit(part.lower()))).orderBy(F.desc(by), id).limit(k)


def common_words(history: DataFrame, k: int = 5, text: str = "query", longer_than: int = 3) -> DataFrame:
    words = history.select(F.explode(F.split(F.lower(text), "\\s+")).alias("word")).where(F.length("word") > longer_than)
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def chunk_statistics(chunks: DataFrame, *by: str, content: str = "content") -> DataFrame:
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.sum(F.length(content)).alias("n_chars"), F.avg(F.length(content)).alias("mean_chars"))


def evicted(entries: DataFrame, most: int, by: str, used: str, id: str) -> DataFrame:
    """Entries of a group beyond the `most` last used."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(used), id))
    return entries.withColumn("__n", n).where(F.col("__n") > most).drop("__n")


def scaled(df: DataFrame, value: str, by: str, out: str) -> DataFrame:
    """df with the value moved to 0..1 within its group; a group of one value gives 0."""
    s = df.groupBy(by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.join(s, by).withColumn(out, F.coalesce((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0)), F.lit(0.0))).drop("__lo", "__hi")


def cache_advice(stats: DataFrame) -> DataFrame:
    """stats (hit_rate, mean_seconds) with a grade and what to do."""
    grade = F.when(F.col("hit_rate") >= 0.8, "A").when(F.col("hit_rate") >= 0.6, "B").when(F.col("hit_rate") >= 0.4, "C").otherwise("D")
    advice = F.array_compact(F.array(F.when(F.col("hit_rate") < 0.5, "enlarge the cache"), F.when(F.col("mean_seconds") > 1, "warm frequent keys")))
    return stats.withColumn("grade", grade).withColumn("advice", advice)


def suggested_limit(seconds: Column, k: Column, slow: float = 0.5, least: int = 10) -> Column:
    """A lower k for a query that took too long: half of it, `least` at least; null for the others."""
    return F.when(seconds > slow, F.greatest(F.lit(least).cast("long"), F.floor(k / 2)))


def still_cached(cache: DataFrame, changed: DataFrame, by: str = "collection") -> DataFrame:
    """Cached results without those that touch a changed collection. cache has an array of collections."""
    hit = cache.select("key", F.explode(by).alias("__c")).join(changed.select(F.col(by).alias("__c")), "__c").select("key").distinct()
    return cache.join(hit, "key", "left_anti")
