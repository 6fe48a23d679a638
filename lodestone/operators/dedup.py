"""Duplicates: near ones by MinHash, gates, and merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.postings import small_batches
from lodestone.sources.io import kept


def minhash_bands(bands: int = 20, rows: int = 4):
    """A function from an array of hashes to a key for each band of least hashes; texts that share a key are candidates."""
    odd = np.random.default_rng(11).integers(1, 1 << 62, (bands * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weight = odd[:rows].reshape(1, rows)

    def keys(h: np.ndarray) -> np.ndarray:
        h = np.asarray(h, np.int64).view(np.uint64)
        mixed = (h ^ h >> np.uint64(31)) * odd
        least = (mixed ^ mixed >> np.uint64(29)).min(axis=1).reshape(bands, rows)
        return (((least * weight).sum(axis=1) << np.uint64(6)) + np.arange(bands, dtype=np.uint64)).view(np.int64)

    return keys


def _keys(hashed: DataFrame) -> DataFrame:
    """hashed (id, h) -> (id, n, key, before): a row a band, with the number of hashes and the keys of the bands before."""
    of = minhash_bands()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [of(h) for h in pdf["h"]]
            n = np.fromiter(map(len, pdf["h"]), np.int32, len(pdf))
            each = np.fromiter(map(len, found), np.int64, len(pdf))
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), each), "n": np.repeat(n, each), "key": np.concatenate([*found, np.zeros(0, np.int64)]), "before": [k[:i] for k in found for i in range(len(k))]})

    kind = dict(hashed.dtypes)["id"]
    return small_batches(hashed).mapInPandas(run, f"id {kind}, n int, key long, before array<long>")


def near_pairs(docs: DataFrame, threshold: float = 0.8, width: int = 5, id: str = "doc_id", text: str = "text", block: int = 256) -> DataFrame:
    """(a, b, similarity) between the representatives (smallest ids) of texts that are alike from the threshold up, verified on the shingles. Equal texts are one representative (see members); in each band every text meets every other of its key, dealt out by pairs of blocks where a key has more than `block` texts."""
    reps = docs.groupBy(F.md5(F.lower(F.trim(text))).alias("m")).agg(F.min(F.struct(F.col(id).alias("id"), F.col(text).alias("t"))).alias("r")).select("r.id", "r.t")
    reps = kept(reps)
    hashed = _hashed(reps, width)
    keys = kept(_keys(hashed))  # shuffled without texts or shingles
    blocks = keys.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    rows = keys.join(blocks, "key").select("*", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = rows.select("key", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("before").alias("seen"))
    right = rows.select("key", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("b"), F.col("n").alias("nb"), "before")
    # a pair is taken in its first band only, and if its sizes let it be alike at all
    may = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & ~F.arrays_overlap("seen", "before")
    pairs = left.join(right, ["key", "i", "j"]).where(may).select("a", "b")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = _hashed(reps.join(asked, "id", "left_semi"), width)
    both = pairs.join(found.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a").join(found.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    sim = shared / (F.size("ha") + F.size("hb") - shared)
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def members(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, representative): for each row the smallest id of the texts equal to it, as near_pairs names them."""
    key = F.coalesce(F.md5(F.lower(F.trim(text))), F.lit(""))
    least = docs.groupBy(key.alias("m")).agg(F.min(id).alias("representative"))
    return docs.select(id, key.alias("m")).join(least, "m").select(id, "representative")


def _hashed(reps: DataFrame, width: int) -> DataFrame:
    """reps (id, t) -> (id, h): hashes of the distinct shingles, without texts that have no word."""
    words = reps.select("id", F.array_remove(F.split(F.lower("t"), "\\s+"), "").alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return words.select("id", F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, width)))).alias("h"))


def duplicate_gate(new: DataFrame, hits: DataFrame, least_similarity: float = 0.85, id: str = "id") -> DataFrame:
    """new with is_duplicate: its nearest stored row (hits: id, distance) is at least as similar."""
    best = hits.groupBy(id).agg(F.min("distance").alias("__d"))
    return new.join(best, id, "left").withColumn("is_duplicate", F.coalesce(1 - F.col("__d") >= least_similarity, F.lit(False))).drop("__d")


def merge(groups: DataFrame, how: str, id: str = "id", content: str = "content", created: str = "created") -> DataFrame:
    """groups (group_id, id, content, created) -> one row a group: the latest, the union of contents with blank lines, or the first."""
    if how == "latest_version":
        return groups.groupBy("group_id").agg(F.max_by(id, F.struct(created, id)).alias("id"), F.max_by(content, F.struct(created, id)).alias("content"))
    if how == "content_union":
        rows = F.sort_array(F.collect_list(F.struct(F.col(id).alias("i"), F.col(content).alias("c"))))
        return groups.groupBy("group_id").agg(F.min(id).alias("id"), F.array_join(F.transform(rows, lambda r: r["c"]), "\n\n").alias("content"))
    order = Window.partitionBy("group_id").orderBy(id)
    return groups.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("group_id", F.col(id).alias("id"), F.col(content).alias("content"))


def next_version(docs: DataFrame, updates: DataFrame, id: str = "id") -> DataFrame:
    """docs (id, content, version) with updated contents, and one version more where they differ."""
    j = docs.join(updates.select(id, F.col("content").alias("__c")), id, "left")
    new = F.col("__c").isNotNull() & ~F.col("__c").eqNullSafe(F.col("content"))
    return j.withColumn("version", F.col("version") + new.cast("int")).withColumn("content", F.coalesce("__c", "content")).drop("__c")
