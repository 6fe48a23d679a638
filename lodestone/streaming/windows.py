"""Streams of documents and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int | None = 16) -> DataFrame:
    """A batch takes that many files at most, or all that are there."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).load(path)


def write_arrivals(df: DataFrame, path: str, batches: int) -> int:
    """Write df as the files of a stream, at least as many as tasks read it, so that none is larger than what a task reads; how many of them make a batch, so that there are that many batches, and more where one would be over 16 files."""
    each = -(-df.rdd.getNumPartitions() // batches)
    df.repartition(each * batches).write.mode("append").parquet(path)
    return min(each, 16)


def tumbling(df: DataFrame, at: str, every: str, *by: str, late: str | None = None) -> DataFrame:
    """Counts by window; works on tables and, with a bound for late rows, on streams."""
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.window(at, every).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sliding(df: DataFrame, at: str, size: str, step: str, *by: str, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.window(at, size, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(df: DataFrame, at: str, gap: str, *by: str, late: str | None = None) -> DataFrame:
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def keep_first_stream(df: DataFrame, at: str, late: str, text: str = "text") -> DataFrame:
    """The first of equal texts (in lower case, trimmed), remembered for as long as rows may be late."""
    keyed = df.withColumn("__key", F.md5(F.lower(F.trim(text))))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def ingest_stream(df: DataFrame, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], problem: Column | None = None) -> StreamingQuery:
    """Each batch without faulty documents goes through step and is appended to the sink; all that is there is taken, then the query ends."""
    rows = df if problem is None else df.where(problem.isNull())

    def write(batch: DataFrame, number: int) -> None:
        step(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number:012d}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
