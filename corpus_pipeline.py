"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are redacted, sources are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs. All but the last
return the columns of documents. Every stage takes other columns of its input, whatever their names, as not there, reads
texts of any length whole, and gives an empty table for an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import mixing, piece_codec, queries, secret_scan, simhash_dedup, toxicity
from lodestone.llm.common import cut, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. Null and empty texts have no hits and stay; repeated rows stay or go together."""
    docs = docs.select(*COLUMNS)
    scored = toxicity.score(docs, queries.toxicity_model(spark, sf_dir, docs), out="__score")
    return scored.where("__score < 0.7").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of smallest id, and one row of it.

    Groups are linked by a similarity of 0.8 or more of the distinct shingles of five words, verified on the shingles.
    Null texts and texts without words are alike; a null id is the smallest only of a group that has no other; of texts
    that share the smallest id the one of smallest digest stays.
    """
    docs = docs.select(*COLUMNS)
    found = simhash_dedup.verified_duplicates(docs)
    first = F.struct(F.col("least").isNull(), F.col("least").alias("id"), "key")
    stays = found.groupBy("component").agg(F.min(first).alias("s")).select(F.col("s.key").alias("__k"), F.coalesce("s.id", F.lit(0)).alias("__i"), F.col("s.id").isNull().alias("__z"))
    at = ["__k", "__i", "__z"]
    rows = docs.select(*COLUMNS, simhash_dedup.text_key().alias("__k"), F.coalesce("doc_id", F.lit(0)).alias("__i"), F.col("doc_id").isNull().alias("__z"))
    # copies of one row become one before they are shuffled, and a group's other rows have other ids, so no key is hot
    return rows.dropDuplicates(at).join(stays, at).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced by their kinds; n_chars is counted anew where that changed a text. Null texts stay null."""
    found = secret_scan.find_secrets(docs.select(*COLUMNS), out="__found", redact="[{}]")
    return found.withColumn("n_chars", F.when(F.size("__found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Rows of equal id, source and size are numbered on both sides, so that each meets its own decision; where there are
    none, one join by id, source and size does. Empty texts and sources without words are not taken; a null id or source
    is a value of its own.
    """
    docs = docs.select(*COLUMNS)
    decided = cut(mixing.mix(docs))
    again = decided.where("dup > 0").limit(1).count()
    here = docs.withColumn("size", mixing.word_count("text"))
    at = {"__i": F.coalesce("doc_id", F.lit(0)), "__z": F.col("doc_id").isNull(), "__s": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "__n": F.col("size")}
    left = here.select(*COLUMNS, *[c.alias(k) for k, c in at.items()])
    right = decided.where("copies > 0").select(*[c.alias(k) for k, c in at.items()], F.col("dup").alias("__d"), F.col("copies").cast("int").alias("__copies"))
    by = [*at]
    if again:
        left, by = left.withColumn("__d", F.row_number().over(Window.partitionBy(*at).orderBy("text")) - 1), [*at, "__d"]
    return left.join(right, by).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and digests of the ids, of their spans and of what they decode to. A null text has no ids."""
    return piece_codec.round_trip(docs, queries.piece_model(), keep=("doc_id", "source", "lang"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: toxicity scores and pivotal rounding can't be told in SQL; tests/llm compares the pipeline with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
