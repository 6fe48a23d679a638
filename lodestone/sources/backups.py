"""Chains of full, incremental and differential backups of a keyed table.

Rows are dealt to buckets by a hash of their id. A backup holds a digest of each bucket (number of rows and the sum of
their hashes, so that rows that occur twice count twice), and above these a tree of digests of `fan` nodes each. Two
trees are compared from the root down: below a node that agrees nothing is looked at. An incremental backup writes the
buckets that differ from the backup before it, a differential one those that differ from the last full one; its
catalogue says for every bucket which backup holds its rows. So a restore reads each bucket once, from where it is, and
never replays a chain. With rows changed at random a backup writes about one bucket a changed row, until all are hit;
`buckets` sets how fine that is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.catalog import row_hash
from lodestone.sources.commits import Files

KINDS = ("full", "incremental", "differential")


def digests(df: DataFrame, id: str, buckets: int) -> DataFrame:
    """(node, n, digest) of the buckets that have rows."""
    return df.groupBy(bucket_of(id, buckets).alias("node")).agg(F.count("*").alias("n"), F.sum(row_hash(df.columns)).alias("digest"))


def bucket_of(id: str, buckets: int):
    return F.pmod(F.xxhash64(id), F.lit(buckets)).cast("long")


def tree(leaves: DataFrame, buckets: int, fan: int = 16) -> DataFrame:
    """(level, node, n, digest): level 0 are the leaves; a node's digest is made of its children's places and digests."""
    levels, now, width, level = [leaves.select(F.lit(0).alias("level"), "node", "n", "digest")], leaves, buckets, 0
    while width > 1:
        width, level = -(-width // fan), level + 1
        part = F.xxhash64("node", F.col("n"), F.col("digest")).cast("decimal(38,0)")
        now = now.groupBy(F.floor(F.col("node") / fan).alias("node")).agg(F.sum("n").alias("n"), F.sum(part).alias("digest"))
        levels.append(now.select(F.lit(level).alias("level"), "node", "n", "digest"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def changed(old: DataFrame, new: DataFrame, fan: int = 16) -> DataFrame:
    """(node): buckets in which two trees differ, from the root down."""
    top = new.agg(F.max("level")).first()[0] or 0  # the number of levels
    differ = None
    for level in range(top, -1, -1):
        pick = lambda t, name: t.where(F.col("level") == level).select("node", F.struct("n", "digest").alias(name))  # noqa: B023, E731
        both = pick(old, "a").join(pick(new, "b"), "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if differ is not None:
            both = both.withColumn("up", F.floor(F.col("node") / fan)).join(differ.withColumnRenamed("node", "up"), "up", "left_semi").select("node")
        differ = both
    return differ


class BackupChain:
    def __init__(self, spark: SparkSession, path: str, schema, id: str, buckets: int = 4096, fan: int = 16):
        self.spark, self.base, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.schema, self.id, self.buckets, self.fan = schema, id, buckets, fan

    def names(self) -> list[tuple[int, str]]:
        """(number, kind) of the finished backups, oldest first."""
        return sorted((int(n.split("-")[0]), n.split("-")[1]) for n in self.files.names(self.base) if self.files.names(f"{self.base}/{n}/catalogue"))

    def _at(self, number: int) -> str:
        return next(f"{self.base}/{n:06d}-{k}" for n, k in self.names() if n == number)

    def _tree(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._at(number)}/tree")

    def catalogue(self, number: int) -> DataFrame:
        """(node, held_by): which backup holds the rows of a bucket."""
        return self.spark.read.schema("node long, held_by int").parquet(f"{self._at(number)}/catalogue")

    def backup(self, df: DataFrame, kind: str = "incremental") -> dict:
        """Write what differs from the backup that this kind builds on (a full one where there is none); {number, kind, buckets, bytes} of what was written."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind: {kind}")
        known = self.names()
        basis = {"full": [], "incremental": known, "differential": [x for x in known if x[1] == "full"]}[kind]
        kind = kind if basis else "full"
        number = max((n for n, _ in known), default=0) + 1
        at = f"{self.base}/{number:06d}-{kind}"
        self.files.delete(at)  # what a backup that died left here
        digests(df, self.id, self.buckets).write.parquet(f"{at}/leaves")
        below = self.spark.read.parquet(f"{at}/leaves")
        tree(below, self.buckets, self.fan).coalesce(1).write.parquet(f"{at}/tree")  # as many rows as buckets, and a fifteenth more
        mine, leaves = self.spark.read.parquet(f"{at}/tree"), below.select("node")
        if basis:
            last = basis[-1][0]
            nodes = changed(self._tree(last), mine, self.fan)
            nodes.coalesce(1).write.parquet(f"{at}/changed")
            nodes = self.spark.read.schema("node long").parquet(f"{at}/changed")
            kept = self.catalogue(last).join(nodes, "node", "left_anti")
            fresh = nodes.join(leaves, "node", "left_semi")  # others have lost all their rows
        else:
            kept, fresh = None, leaves
        rows = df.withColumn("__bucket", bucket_of(self.id, self.buckets))
        rows = rows if not basis else rows.join(fresh.withColumnRenamed("node", "__bucket"), "__bucket", "left_semi")
        rows.repartition("__bucket").sortWithinPartitions("__bucket").write.parquet(f"{at}/rows")
        own = fresh.select("node", F.lit(number).alias("held_by"))
        (own if kept is None else own.unionByName(kept)).coalesce(1).write.parquet(f"{at}/catalogue")  # comes last: without it there is no backup
        return {"number": number, "kind": kind, "buckets": fresh.count(), "bytes": self.files.size(f"{at}/rows")}

    def restore(self, number: int | None = None) -> DataFrame:
        """The table as it was, after its digests were compared."""
        known = [n for n, _ in self.names()]
        number = known[-1] if number is None else number
        where = self.catalogue(number)
        holders = [r["held_by"] for r in where.select("held_by").distinct().collect()]  # backups, not rows
        fields = self.spark.createDataFrame([], self.schema)
        out = fields
        for h in sorted(holders):
            rows = self.spark.read.schema(fields.withColumn("__bucket", F.lit(0).cast("long")).schema).parquet(f"{self._at(h)}/rows")
            mine = where.where(F.col("held_by") == h).select(F.col("node").alias("__bucket"))
            out = out.unionByName(rows.join(mine, "__bucket", "left_semi").select(*fields.columns))
        want = self.spark.read.parquet(f"{self._at(number)}/leaves").select("node", "n", "digest")
        got = digests(out, self.id, self.buckets)
        if want.exceptAll(got).unionByName(got.exceptAll(want)).limit(1).count():
            raise ValueError(f"backup {number} does not match its digests")
        return out

    def forget(self, keep: int) -> list[int]:
        """Delete the oldest backups that none of the newest `keep` needs."""
        known = [n for n, _ in self.names()]
        needed = set(known[-keep:])
        for n in known[-keep:]:
            needed |= {r["held_by"] for r in self.catalogue(n).select("held_by").distinct().collect()}
        gone = [n for n in known if n not in needed]
        for n in gone:
            self.files.delete(self._at(n))
        return gone
