"""Reading and writing documents and collections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.scoring import source_type


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; where the session names none, a temporary one for a local master, else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written below scratch and read again, for what several steps read."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def read_folder(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Whole files: path, title (file name without ending), kind, size, modified, content."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return r.select("path", F.regexp_replace(name, "\\.[^.]*$", "").alias("title"), source_type("path").alias("kind"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("content"))


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """One folder for each value of `by`, which its rows hold too: a folder can't tell null from empty, nor name every text. Plain values name their folder, others do by their digest."""
    if by:
        value = F.col(by).cast("string")
        plain = value.rlike("(?U)\\A[\\w .-]{1,60}\\z") & (value != "__HIVE_DEFAULT_PARTITION__")
        df, folder = df.withColumn(f"{by}_folder", F.when(plain, value).otherwise(F.md5(value))), [f"{by}_folder"]
    (df.write.partitionBy(*folder) if by else df.write).mode("overwrite").json(path)


#: how CSV files are written and read: texts may hold quotes, commas, lines and any control character, and keep the white space around them. Lines end as the header does
CSV = {"header": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON texts. A null is nothing between commas, an empty text two quotes."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").options(**CSV).csv(path)


def markdown_text(title: str = "title", content: str = "content", collection: str = "collection") -> Column:
    """A report text for a document."""
    return F.concat(F.lit("## "), F.coalesce(F.col(title).cast("string"), F.lit("Untitled")), F.lit("\n\n*Collection:* "), F.col(collection), F.lit("\n\n"), F.col(content), F.lit("\n"))


def markdown_rows(df: DataFrame, title: str = "title", content: str = "content", collection: str = "collection") -> DataFrame:
    return df.select(markdown_text(title, content, collection).alias("value"))


def write_markdown(df: DataFrame, path: str, **names: str) -> None:
    markdown_rows(df, **names).write.mode("overwrite").text(path)


def read_any(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """json, csv or parquet, by kind or by the ending of the path; a column `metadata` of CSV files that is no JSON is wrapped as raw_metadata."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        # Spark takes "" for null where it has no other name, so it gets one that no text has
        empty = uuid.uuid4().hex
        df = spark.read.schema(schema).options(**CSV, emptyValue=empty).csv(path)
        df = df.select(*[F.when(F.col(f"`{c}`") == empty, "").otherwise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
        if "metadata" in df.columns:
            wrapped = F.to_json(F.struct(F.col("metadata").alias("raw_metadata")))
            df = df.withColumn("metadata", F.when(F.col("metadata").isNull() | F.try_parse_json("metadata").isNotNull(), F.col("metadata")).otherwise(wrapped))
        return df
    if kind in ("json", "parquet"):
        # texts of any length: beyond the usual bound of JSON strings a row would be read as nulls
        return spark.read.schema(schema).format(kind).option("maxStringLen", (1 << 31) - 1).load(path).select(*[f"`{c}`" for c in StructType.fromDDL(schema).names])
    raise ValueError(f"unknown format: {kind}")


def merge_import(df: DataFrame, new: DataFrame, how: str, id: str = "id") -> DataFrame:
    """skip: known ids stay; overwrite: new rows replace them; merge: their non-null values do."""
    from lodestone.operators.catalog import upsert

    if how == "skip":
        return df.unionByName(new.join(df.select(id), id, "left_anti").select(*df.columns))
    if how == "overwrite":
        return df.join(new.select(id), id, "left_anti").unionByName(new.select(*df.columns))
    if how == "merge":
        return upsert(df, new, id)
    raise ValueError(f"unknown strategy: {how}")


def snapshot(df: DataFrame, path: str) -> dict:
    """Write a copy with a manifest; returns the manifest."""
    from lodestone.operators.catalog import checksum

    df.write.mode("overwrite").parquet(f"{path}/rows")
    manifest = checksum(df.sparkSession.read.parquet(f"{path}/rows"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest.first().asDict()


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot, after its checksum was compared."""
    from lodestone.operators.catalog import checksum

    df = spark.read.parquet(f"{path}/rows")
    want, got = spark.read.schema("n_rows long, checksum string").json(f"{path}/manifest").first(), checksum(df).first()
    if (want["n_rows"], want["checksum"]) != (got["n_rows"], got["checksum"]):
        raise ValueError(f"the snapshot in {path} does not match its manifest")
    return df


def archive(projects: DataFrame, links: DataFrame, path: str) -> None:
    """Projects with their links as JSON, one folder each."""
    write_json(projects, f"{path}/projects")
    write_json(links, f"{path}/links")


def unarchive(spark: SparkSession, path: str, projects: str, links: str) -> tuple[DataFrame, DataFrame]:
    """The projects and links of an archive, of the given schemas; links of projects that it lacks are left out."""
    found = spark.read.schema(projects).json(f"{path}/projects")
    return found, spark.read.schema(links).json(f"{path}/links").join(found.select("project"), "project", "left_semi")
