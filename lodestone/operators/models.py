"""Embedding model fingerprints: changes, compatibility, reindexing and migration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import cosine_similarity


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fingerprints (model_name, version, checksum, metadata) -> what changed, whether to reindex and the impact."""
    o = old.select("model_name", *[F.col(c).alias(f"old_{c}") for c in ("version", "checksum", "metadata")])
    kind = (
        F.when(F.col("old_checksum").isNull(), "new_model")
        .when(~F.col("version").eqNullSafe(F.col("old_version")), "version_update")
        .when(F.col("checksum") != F.col("old_checksum"), "checksum_change")
        .when(~F.col("metadata").eqNullSafe(F.col("old_metadata")), "config_change")
        .otherwise("unchanged")
    )
    r = new.join(o, "model_name", "left").select("model_name", kind.alias("change_type"))
    r = r.withColumn("requires_reindexing", F.col("change_type").isin("new_model", "version_update", "checksum_change"))
    return r.withColumn("impact", F.when(F.col("change_type").isin("version_update", "checksum_change"), "high").when(F.col("change_type") == "new_model", "medium").otherwise("low"))


def compatibility(collections: DataFrame, fingerprints: DataFrame, strict: bool = False) -> DataFrame:
    """collections (collection, model_name, fingerprint), fingerprints (model_name, checksum) -> compatible, advice. An unknown one is compatible with a warning; a mismatch blocks only if strict."""
    r = collections.join(fingerprints.select("model_name", "checksum"), "model_name", "left")
    same = F.col("fingerprint") == F.col("checksum")
    unknown = F.col("fingerprint").isNull() | F.col("checksum").isNull()
    return r.select("collection", F.when(unknown, True).otherwise(same).alias("compatible"), F.when(unknown, "unknown model, check").when(same, "none").otherwise("reindex").alias("advice"), (F.lit(strict) & ~F.coalesce(same, F.lit(True))).alias("blocked"))


def requires_reindexing(stored: Column, current: Column, status: Column) -> Column:
    return F.coalesce(stored, F.lit("")).isin("") | (stored != current) | F.coalesce(status.isin("pending", "failed"), F.lit(False))


def impact(event: DataFrame, collections: DataFrame) -> DataFrame:
    """event (model_name), collections (model_name, n_documents, mb) -> affected collections, documents, MB, minutes and level."""
    j = event.join(collections, "model_name", "left").groupBy("model_name").agg(F.count("n_documents").alias("n_collections"), F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"), F.coalesce(F.sum("mb"), F.lit(0.0)).alias("mb"))
    level = F.when(F.col("n_documents") > 1000, "high").when(F.col("n_documents") > 100, "medium").otherwise("low")
    return j.withColumn("minutes", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_documents") / 50))).withColumn("level", level)


def migration_check(old: DataFrame, new: DataFrame, least_mean: float = 0.8, id: str = "id", embedding: str = "embedding", by: str = "collection") -> DataFrame:
    """Old and new embeddings by id -> for each collection rows, missing, null vectors, other dimensions, mean and least cosine, status."""
    o = old.select(F.col(id).alias("id"), F.col(by).alias("collection"), F.col(embedding).alias("a"))
    n = new.select(F.col(id).alias("id"), F.col(embedding).alias("b"), F.lit(1).alias("there"))
    j = o.join(n, "id", "left").withColumn("cos", cosine_similarity("a", "b"))
    g = j.groupBy("collection").agg(
        F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("there").isNotNull() & (F.col("b").isNull() | (F.size("b") == 0))).alias("null_vectors"),
        F.count_if(F.size("b") != F.size("a")).alias("other_dimension"), F.avg("cos").alias("mean_cosine"), F.min("cos").alias("min_cosine"),
    )
    bad = (F.col("missing") > 0) | (F.col("null_vectors") > 0) | (F.col("other_dimension") > 0)
    return g.withColumn("status", F.when(bad, "failed").when(F.coalesce(F.col("mean_cosine") < least_mean, F.lit(True)), "warning").otherwise("passed"))


def kept_fingerprints(fingerprints: DataFrame, cutoff: Column) -> DataFrame:
    return fingerprints.where(F.col("created_at") >= cutoff)
