"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it. Where the session names none, a local master (tests) gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lodestone-')}")
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def cut(df: DataFrame, **measures: Column) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning. measures: aggregates that are taken while writing, into its attribute `measured`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    (df.observe(seen, *[c.alias(k) for k, c in measures.items()]) if seen else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    out.measured = {k: None for k in measures} | seen.get if seen else {}
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete tables that cut has written and no later step reads."""
    for df in cuts:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df; the session's Arrow batches are lowered to 8 MB, so that long texts don't fill the memory beside the heap."""
    conf, key, most = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
    said = str(conf.get(key, "64m")).lower().rstrip("b")
    size = int(float(said.rstrip("kmgt")) * 1024 ** " kmgt".index(said[-1] if said[-1] in "kmgt" else " "))
    if not 0 < size <= most:
        conf.set(key, f"{most}b")
    return df


def keyed(df: DataFrame) -> DataFrame:
    """cut for the right side of spread_join: one row a key, with n, how many rows of the left side hold it."""
    return cut(df, total=F.sum("n"), most=F.max("n"))


def spread_join(left: DataFrame, right: DataFrame, key: str | list[str], share: int = 1000) -> DataFrame:
    """left joined with right (from keyed) on key, without one task that meets a hot key. Columns of key hold no nulls.

    A key that holds over 1 / share of left's rows is joined by a broadcast, of at most `share` rows by their counts; the
    others are shuffled.
    """
    total, most = right.measured["total"] or 0, right.measured["most"] or 0
    if most * share <= total:
        return left.join(right, key)
    hot = F.broadcast(right.where(F.col("n") * share > total))
    rest = left.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(right.where(F.col("n") * share <= total), key)
    return left.join(hot, key).unionByName(rest)


def doc_hash_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def unit_hash(*cols: Column | str) -> Column:
    """A deterministic value in [0, 1) from the columns."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*cols), 11), F.lit(1 << 53)).cast("double") / float(1 << 53)


def ranked(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Give each row its position (from 0) in the order of the columns, without one task that sees all rows.

    Range partitions are sorted apart and written down, so the partition numbers stay as they are; only one count a
    partition meets in one place. Columns in order should tell rows apart, so that equal keys spread over partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = "__mid"
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(mid, 33)
    counts = rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()  # one row a partition
    starts, total = [], 0
    for r in sorted(counts, key=lambda r: r["p"]):
        starts.append((r["p"], total))
        total += r["n"]
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "__p long, __first long"))
    at = F.col("__first") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(first, part == F.col("__p")).withColumn(out, at).drop(mid, "__p", "__first")


def utf8(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null as empty) and the offsets of its values in them."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    big = arr.cast(pa.large_string())
    _, off, data = big.buffers()
    off = np.frombuffer(off, np.int64, len(big) + 1, big.offset * 8) if off is not None and len(big) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 16 << 20):
    """Slices of a batch whose texts have about most_bytes together (a longer text makes its own slice)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)
