"""The queries of this subpackage, one for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import doc_hash_mod
    from lodestone.llm.lang_id import fit, identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", doc_hash_mod("doc_id", 4) == 2)
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model, keep=("doc_id", "held_out"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.llm.html_render import extract

    return extract(table(spark, sf_dir, "pages"), keep=("page_id", "url")).withColumn("n_chars", F.length("text").cast("long"))


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), top=20, every=20)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secret_scan import digest, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *digest())


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash_dedup import hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", hex16().alias("fingerprint"), "component_id")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """Fitted on the labelled documents that are not held out."""
    from lodestone.llm.common import doc_hash_mod
    from lodestone.llm.toxicity import fit

    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(doc_hash_mod("doc_id", 3) != 1)
    return fit(docs, labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.llm.common import doc_hash_mod
    from lodestone.llm.toxicity import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, toxicity_model(spark, sf_dir, docs), keep=("doc_id",))
    return scored.select("doc_id", (doc_hash_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.piece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"), piece_model())


def op8_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.doc_fingerprints import report
    from lodestone.llm.simhash_dedup import hex16

    found = report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "n_within")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from lodestone.llm.sharding import shard

    found = shard(table(spark, sf_dir, "documents"), 40)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_size")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express. XXH64 bits, trained models, automata, tokenizers and draws can't be told in SQL; tests/llm/test_registered.py calls each query and holds it against a plain version, or what chance leaves open (op6, op9, op10) against the contract's rules."""
    from lodestone.llm import sql

    return {"op11_source_divergence": sql.DIVERGENCE, "op13_vector_codes": sql.vector_codes()}
