"""Whole jobs: taking documents in, re-embedding, and answering queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import querying as Q
from lodestone.functions import scoring as G
from lodestone.functions.text import clean, keep_first
from lodestone.operators import chunking, results, search
from lodestone.operators.analytics import gap_analysis
from lodestone.operators.catalog import document_problem
from lodestone.operators.encoding import Encoder, embed
from lodestone.sources.io import kept


def ingest(docs: DataFrame, encoder: Encoder, config: chunking.Config = chunking.Config(), least_quality: float | None = None, cleaned: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """docs (doc_id, text, document_type, path, team) -> chunks ready to append, and the rejected documents with the reason.

    Faulty documents and those below the quality gate go, equal ones are taken once, the type of collection is routed,
    texts are chunked and embedded. cleaned: texts are cleaned first, which also joins their lines.
    """
    if cleaned:
        docs = docs.withColumn("text", F.coalesce(clean("text", least=0), F.lit("")))
    problem = document_problem(F.col("text"))
    if least_quality is not None:
        problem = F.coalesce(problem, F.when(G.quality_score("text") < least_quality, "low quality"))
    judged = docs.withColumn("problem", problem)
    fine = keep_first(judged.where("problem is null")).withColumn("collection", G.route("document_type", "path", "team"))
    chunks = chunking.recursive(fine, config, keep=("collection",))
    rows = chunks.select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), "doc_id", "chunk_index", "collection", "content", "start", "end")
    return embed(rows, encoder), judged.where("problem is not null").select("doc_id", "problem")


def rebuild(chunks: DataFrame, encoder: Encoder, collections: list[str] | None = None) -> DataFrame:
    """chunks with new embeddings for the named collections (all, if None)."""
    if collections is None:
        return embed(chunks.drop("embedding", "embedding_error"), encoder)
    hit = F.col("collection").isin(collections)
    new = embed(chunks.where(hit).drop("embedding", "embedding_error"), encoder)
    return chunks.where(~hit).unionByName(new, allowMissingColumns=True)


def answer(chunks: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 10, where: Column | None = None, threshold: float = 0.0, least_rerank: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """queries (qid, query) -> hits with rank and reason, and one row a query with its gap analysis.

    Queries are understood and enhanced, embedded, searched per collection, reranked by shared words and explained. Chunks
    and hits are written once, since several steps read them.
    """
    chunks = kept(chunks)
    asked = embed(queries.withColumn("enhanced", Q.enhanced("query")), encoder, text="enhanced", out="query_embedding").where("query_embedding is not null")
    found = search.similarity_search(chunks.where("embedding is not null"), asked.select("qid", "query_embedding"), k, threshold=threshold, where=where)
    texts = found.join(chunks.select("id", "content"), "id").join(queries.select("qid", "query"), "qid")
    shared = F.size(F.array_intersect(search.tokens("query"), search.tokens("content"))) / F.greatest(F.size(search.tokens("query")), F.lit(1))
    ranked = search.rerank(texts, F.greatest(F.lit(0.0), 0.5 * F.col("similarity") + 0.5 * shared), candidates=20, top=k, least=least_rerank)
    hits = kept(ranked.withColumn("reason", results.ranking_reason(F.round("rerank_score", 3), F.col("content"), F.col("collection"), F.col("query"))))
    return hits, gap_analysis(queries, hits)
