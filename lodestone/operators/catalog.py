"""Collections and their rows: scan, append, upsert, delete, move, rename, statistics, backup and replication. Functions return new tables; sinks are in lodestone.sources."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, ids: list | None = None, where: Column | None = None, limit: int | None = None, offset: int = 0, columns: list[str] | None = None, id: str = "id") -> DataFrame:
    rows = df if ids is None else df.where(F.col(id).isin(ids))
    rows = rows if where is None else rows.where(F.coalesce(where, F.lit(False)))
    if limit is not None or offset:
        rows = rows.orderBy(id).offset(offset)
        rows = rows if limit is None else rows.limit(limit)
    return rows.select(*columns) if columns else rows


def append_problem(id: Column, content: Column, embedding: Column, dimension: int) -> Column:
    """Why a row can't be appended, or null."""
    return F.when(id.isNull(), "no id").when(content.isNull(), "no content").when(embedding.isNull(), "no embedding").when(F.size(embedding) != dimension, "other dimension")


def append(df: DataFrame, new: DataFrame, embedding: str = "embedding", content: str = "content", id: str = "id") -> DataFrame:
    """df with the sound rows of new; missing ids are filled, and the dimension is that of df's rows (of new's, if df has none)."""
    first = df.select(F.size(embedding).alias("n")).where("n > 0").limit(1).collect() or new.select(F.size(embedding).alias("n")).where("n > 0").limit(1).collect()
    rows = new.withColumn(id, F.coalesce(F.col(id), F.sha2(F.concat_ws("|", F.col(content), F.col(embedding).cast("string")), 256)))
    fine = append_problem(F.col(id), F.col(content), F.col(embedding), first[0]["n"] if first else 0).isNull()
    return df.unionByName(rows.where(fine), allowMissingColumns=True)


def upsert(df: DataFrame, changes: DataFrame, id: str = "id") -> DataFrame:
    """Rows of df with the non-null values of changes put in; ids that df lacks are added."""
    new = changes.select(F.col(id).alias("__id"), *[F.col(c).alias(f"__{c}") for c in changes.columns if c != id])
    joined = df.join(new, F.col(id) == F.col("__id"), "full_outer")
    return joined.select(*[F.coalesce("__id", id).alias(id) if c == id else F.coalesce(f"__{c}", c).alias(c) if c in changes.columns else F.col(c) for c in df.columns])


def delete(df: DataFrame, ids: DataFrame | None = None, where: Column | None = None, id: str = "id") -> DataFrame:
    """Without the rows of the ids, or those that meet the condition; exactly one of both."""
    if (ids is None) == (where is None):
        raise ValueError("give either ids or a condition")
    return df.join(ids.select(id), id, "left_anti") if ids is not None else df.where(~F.coalesce(where, F.lit(False)))


def rename(df: DataFrame, old: str, new: str, collection: str = "collection") -> DataFrame:
    hit = F.col(collection) == old
    out = df.withColumn("renamed_from", F.when(hit, F.lit(old)).otherwise(F.col("renamed_from") if "renamed_from" in df.columns else F.lit(None).cast("string")))
    return out.withColumn(collection, F.when(hit, F.lit(new)).otherwise(F.col(collection)))


def glob(pattern: str) -> str:
    """The regular expression of a file name pattern."""
    return fnmatch.translate(pattern).replace("(?s:", "(?s)^(?:").replace("\\z", "$").replace("\\Z", "$")


def move(df: DataFrame, source: str, target: str, pattern: str, names: list[str], collection: str = "collection") -> DataFrame:
    """Rows of source whose first non-null name matches the pattern go to target."""
    hit = (F.col(collection) == source) & F.coalesce(F.coalesce(*[F.col(n).cast("string") for n in names]).rlike(glob(pattern)), F.lit(False))
    return df.withColumn(collection, F.when(hit, F.lit(target)).otherwise(F.col(collection)))


def statistics(rows: DataFrame, catalog: DataFrame, collection: str = "collection") -> DataFrame:
    """The catalog with n_rows of each collection, 0 for empty ones."""
    return catalog.join(rows.groupBy(collection).agg(F.count("*").alias("n_rows")), collection, "left").na.fill(0, ["n_rows"])


def type_summary(stats: DataFrame) -> DataFrame:
    """stats (collection, collection_type, n_rows) -> collections, rows and members of each type; no type is `untyped`."""
    return stats.groupBy(F.coalesce("collection_type", F.lit("untyped")).alias("collection_type")).agg(
        F.count("*").alias("n_collections"), F.sum("n_rows").alias("n_rows"), F.array_join(F.sort_array(F.collect_list("collection")), ",").alias("members")
    )


def settings_problems(catalog: DataFrame, expected: dict[str, object]) -> DataFrame:
    """catalog with an array of the settings that differ from the expected ones."""
    return catalog.withColumn("problems", F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), k) for k, v in expected.items()])))


def collection_name(kind: Column, project: Column, suffix: Column) -> Column:
    """Type, the project's name for project collections (other signs than letters, digits, _ and - become _) and suffix, joined by _."""
    clean = F.when(kind == "project-specific", F.regexp_replace(F.lower(project), "[^a-z0-9_-]", "_"))
    return F.concat_ws("_", kind, clean, F.nullif(suffix, F.lit("")))


def row_hash(columns: list[str]) -> Column:
    """A hash of a row as a decimal, to be added up: equal rows count as often as they occur. Nulls have a place of their own."""
    cols = sorted(columns)
    return F.xxhash64(*cols, *[F.col(c).isNull() for c in cols]).cast("decimal(38,0)")


def checksum(df: DataFrame) -> DataFrame:
    """One row: number of rows, and a digest that does not depend on their order but on how often each occurs."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(row_hash(df.columns)).cast("string").alias("checksum"))


def replicas_agree(tables: list[DataFrame]) -> DataFrame:
    """One row a replica: rows, checksum, and whether it agrees with the first."""
    sums = reduce(lambda a, b: a.unionByName(b), [checksum(t).withColumn("replica", F.lit(k)) for k, t in enumerate(tables)])
    first = sums.where("replica = 0").select(F.col("n_rows").alias("n0"), F.col("checksum").alias("c0"))
    return sums.crossJoin(F.broadcast(first)).select("replica", "n_rows", "checksum", (F.col("n_rows").eqNullSafe(F.col("n0")) & F.col("checksum").eqNullSafe(F.col("c0"))).alias("agrees"))


def retained(backups: DataFrame, cutoff: Column, most: int, by: str = "created") -> DataFrame:
    """Backups that are neither older than the cutoff nor beyond the newest `most`; each task passes on its newest `most` only."""
    return backups.where(F.col(by) >= cutoff).orderBy(F.desc(by)).limit(most)


def document_problem(content: Column, metadata: Column | None = None) -> Column:
    """Why a document is not taken in, or null."""
    none = F.lit(False) if metadata is None else metadata.isNull()
    return F.when(content.isNull() | (content == ""), "empty").when(none, "no metadata").when(F.length(content) > 50_000, "too long").when(F.length(F.trim(content)) < 10, "too short")
