"""Hits made ready for readers: reasons, attribution, enrichment, texts and envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import querying as Q
from lodestone.functions import scoring as G


def ranking_reason(score: Column, content: Column, collection: Column, query: Column) -> Column:
    """Why a hit stands where it does: how relevant, which key terms it holds, where it is from, wishes it meets; the first three."""
    t = F.lower(content)
    how = F.when(score >= 0.8, "high semantic relevance").when(score >= 0.5, "moderate relevance").otherwise("low relevance")
    terms = F.transform(G.matched_terms(content, Q.key_terms(query)), lambda w: F.concat(F.lit("contains '"), w, F.lit("'")))
    rest = F.array_compact(F.array(
        F.when(F.coalesce(collection, F.lit("")) != "", F.concat(F.lit("from "), collection, F.lit(" collection"))),
        F.when((Q.level(query) == "beginner") & Q.has_any(t, Q.BEGINNER), "matches beginner-level preference"),
        F.when(Q.wants_examples(query) & Q.has_any(t, Q.EXAMPLES), "includes examples as requested"),
    ))
    reasons = F.slice(F.concat(F.array(how), terms, rest), 1, 3)
    return F.concat(F.lit("Ranked due to "), F.array_join(reasons, ", "), F.lit(". Relevance score: "), score.cast("string"))


def attribution(metadata: str) -> Column:
    """struct(title, path, section, page, kind) from a JSON column: the first of the usual names that is not empty."""
    first = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(metadata, f"$.{n}"), F.lit("")) for n in names])
    path = first("source", "file_path", "path")
    return F.struct(first("title", "document_title").alias("title"), path.alias("path"), first("section", "header", "section_title").alias("section"), first("page", "page_number").try_cast("int").alias("page"), F.coalesce(first("type", "file_type"), F.when(path.isNotNull(), G.source_type(path))).alias("kind"))


def enriched(hits: DataFrame, terms: list[str], content: str = "content", kind: str = "kind") -> DataFrame:
    """hits with a snippet of 200 characters, highlights, counts of the terms and a readable kind."""
    counts = F.create_map(*[x for t in terms for x in (F.lit(t), G.term_frequency(content, t))])
    return hits.select("*", G.preview(content, 200).alias("snippet"), G.highlight(G.preview(content, 200), terms, "**", "**").alias("highlighted"), counts.alias("term_counts"), F.initcap(F.replace(F.col(kind), F.lit("_"), F.lit(" "))).alias("kind_label"))


def formatted(hits: DataFrame, form: str = "markdown", least: float = 0.0, most_chars: int = 500, score: str = "similarity", content: str = "content") -> DataFrame:
    """hits from the least score up that have content, with a text for readers: markdown, html, plain or cli."""
    rows = hits.where((F.col(score) >= least) & (F.coalesce(F.trim(content), F.lit("")) != ""))
    body, label, shown = G.preview(content, most_chars), G.relevance_level(score), F.format_number(F.col(score), 3)
    head = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("id").cast("string"))
    texts = {
        "markdown": F.concat(F.lit("### "), head, F.lit("\n*"), label, F.lit("* ("), shown, F.lit(")\n\n"), body),
        "html": F.concat(F.lit("<div><h3>"), head, F.lit("</h3><em>"), label, F.lit(" ("), shown, F.lit(")</em><p>"), F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></div>")),
        "plain": F.concat(head, F.lit(" ("), shown, F.lit(")\n"), body),
        "cli": F.concat(F.lit("["), shown, F.lit("] "), head, F.lit(": "), F.regexp_replace(body, "\\s+", " ")),
    }
    return rows.withColumn("formatted", texts[form])


def envelope(queries: DataFrame, hits: DataFrame, score: str = "similarity") -> DataFrame:
    """One row a query: its hits in order, shares of confidence, collections and what to improve."""
    s = F.round(score, 9)
    share = lambda c: F.avg(c.cast("int"))
    g = hits.groupBy("qid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda h: h["id"]).alias("ids"), F.count("*").alias("n_hits"), share(s > 0.8).alias("high"), share((s > 0.5) & (s <= 0.8)).alias("medium"), share(s <= 0.5).alias("low"),
        F.sort_array(F.collect_set("collection")).alias("collections"),
    )
    r = queries.select("qid").join(g, "qid", "left").na.fill(0, ["n_hits", "high", "medium", "low"])
    improve = F.array_compact(F.array(F.when(F.col("n_hits") == 0, "expand_scope"), F.when(F.col("n_hits").between(1, 2), "expand_query"), F.when(F.size(F.coalesce("collections", F.array().cast("array<string>"))) > 2, "filter_collections")))
    return r.withColumn("suggestions", improve)


def grouped(results: DataFrame, groups: DataFrame) -> DataFrame:
    """results (qid, id, rank) and groups (qid, group) -> the ids of all queries of a group, in order."""
    j = results.join(groups, "qid")
    return j.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("qid", "rank", "id"))), lambda h: h["id"]).alias("ids"))
