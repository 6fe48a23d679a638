"""Where queries are registered: name -> (function of spark and sf_dir, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_any(text: str, words: list[str]) -> str:
    """SQL: whether the text holds any of the words."""
    return "(" + " or ".join("contains(%s, '%s')" % (text, w.replace("'", "''")) for w in words) + ")"


def sql_count(text: str, words: list[str]) -> str:
    return "(" + " + ".join("contains(%s, '%s')::int" % (text, w.replace("'", "''")) for w in words) + ")"


def sql_times(text: str, part: str) -> str:
    part = part.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{part}', ''))) // length('{part}'))"


def preview_sql(text: str, most: int) -> str:
    head = f"{text}[1:{most - 3}]"
    back = f"strpos(reverse({head}), ' ')"
    return f"case when length({text}) <= {most} then {text} when {back} > 0 and length({head}) - {back} > {most - 3} * 0.8 then {head}[1:length({head}) - {back}] || '...' else {head} || '...' end"
