"""The registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import document_queries, index_queries, result_queries, search_queries, source_queries, table_queries, text_queries  # noqa: F401
from lodestone.plans.registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.vector_topk(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
