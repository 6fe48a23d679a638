"""Tables of parquet folders whose versions are the entries of a commit log: a batch is seen whole or not at all.

A batch is written to a folder of its own that no version names yet. It is checked there, and only then an entry is put
into the log that names it; entries have numbers, and of two writers who want the same number one succeeds (a rename that
doesn't overwrite). The other one looks at what was committed meanwhile: if that doesn't touch its ids or folders, it takes
the next number, else its batch is taken back. A job that dies leaves folders that no entry names; `clean` removes them.

An entry holds the list of the folders that make up its version, so reading a version reads one entry. Folders are many
batches large at most, and `compact` joins them; rows never pass the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """The wanted version exists already."""


class Rejected(Exception):
    """Why a batch was taken back: how many rows have which problem."""

    def __init__(self, problems: dict[str, int]):
        super().__init__(", ".join(f"{k}: {n}" for k, n in problems.items()))
        self.problems = problems


class Files:
    """What the log needs of the file system that a path is on."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.jvm = spark, spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(base).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        lines = self.spark.read.text(name, wholetext=True).first()
        return lines[0] if lines else ""

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; false if there was one, which stays."""
        new = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(new), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.FileContext.getFileContext(self.path(name).toUri(), self.conf)
        once = self.spark.sparkContext._gateway.new_array(self.jvm.Options.Rename, 0)
        try:
            context.rename(self.path(new), self.path(name), once)
            return True
        except Exception as e:
            self.delete(new)
            if "FileAlreadyExists" in str(e) or self.fs.exists(self.path(name)):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self.path(folder)).getLength()


@dataclass
class Entry:
    version: int
    kind: str
    folders: list[str]
    added: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


class CommitTable:
    def __init__(self, spark: SparkSession, path: str, schema):
        """schema: that of its rows, a StructType or DDL."""
        self.spark, self.base, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.schema = schema

    def _log(self, version: int) -> str:
        return f"{self.base}/_log/{version:012d}.json"

    def version(self) -> int:
        """The latest one; 0 is the empty table before any commit."""
        return max((int(n[:-5]) for n in self.files.names(f"{self.base}/_log") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def entry(self, version: int | None = None) -> Entry:
        version = self.version() if version is None else version
        return Entry(**json.loads(self.files.read(self._log(version)))) if version else Entry(0, "empty", [])

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows_of(self.entry(version).folders)

    def rows_of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.base}/{x}" for x in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def stage(self, df: DataFrame, **measures: Column) -> tuple[str, dict]:
        """Write rows to a folder that no version names; (the folder, what was measured while writing)."""
        folder = f"data/{uuid.uuid4().hex}"
        seen = Observation()
        rows = df.select(*self.rows_of([]).columns, *[c for c in df.columns if c.startswith("__")])
        marked = rows.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()])
        try:
            marked.drop(*[c for c in rows.columns if c.startswith("__")]).write.parquet(f"{self.base}/{folder}")
        except Exception:
            self.files.delete(f"{self.base}/{folder}")
            raise
        return folder, seen.get

    def drop_staged(self, *folders: str) -> None:
        for x in folders:
            self.files.delete(f"{self.base}/{x}")

    def commit(self, before: Entry, add: list[str], drop: list[str], kind: str) -> Entry:
        """The version after `before`; a Conflict if another one has that number."""
        gone = set(drop)
        entry = Entry(before.version + 1, kind, [x for x in before.folders if x not in gone] + add, add, drop)
        if not self.files.create(self._log(entry.version), json.dumps(entry.__dict__)):
            raise Conflict(f"version {entry.version} exists")
        return entry

    def insert_batch(self, df: DataFrame, problem: Column | None = None, id: str = "id", before: Entry | None = None) -> int:
        """The version in which all rows of df are, or Rejected and no trace of them: rows with a problem, without an id, of an id that occurs twice or is in the table. before: the entry that the writer has read, if it isn't the latest."""
        why = F.coalesce(problem, F.when(F.col(id).isNull(), "no id")) if problem is not None else F.when(F.col(id).isNull(), "no id")
        before = before or self.entry()
        folder, seen = self.stage(df.withColumn("__problem", why), problems=F.count("__problem"))
        try:
            self._reject({"faulty rows": seen["problems"]})
            staged = self.rows_of([folder]).select(id)
            self._reject({"ids twice": staged.groupBy(id).count().where("count > 1").count()})
            look_at = before.folders
            while True:
                known = self.rows_of(look_at).select(id)
                self._reject({"known ids": staged.join(known, id, "left_semi").count() if look_at else 0})
                try:
                    return self.commit(before, [folder], [], "insert").version
                except Conflict:  # only what came meanwhile can stand against it
                    latest = self.entry()
                    look_at, before = [x for x in latest.folders if x not in set(before.folders)], latest
        except Exception:
            self.drop_staged(folder)
            raise

    def _reject(self, problems: dict[str, int]) -> None:
        found = {k: n for k, n in problems.items() if n}
        if found:
            raise Rejected(found)

    def change_batch(self, changes: DataFrame | None = None, remove: DataFrame | None = None, id: str = "id", before: Entry | None = None) -> int:
        """Rows of changes replace those of their ids (or are new), rows of the ids in remove go. Only folders that hold such rows are written again; a Conflict if another writer has changed one of these meanwhile."""
        before = before or self.entry()
        ids = [x.select(id) for x in (changes, remove) if x is not None]
        touched = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
        at = F.regexp_extract("_metadata.file_path", "/(data/[^/]+)/[^/]*$", 1)
        hit = [r["folder"] for r in self.rows_of(before.folders).select(id, at.alias("folder")).join(touched, id, "left_semi").select("folder").distinct().collect()] if before.folders else []  # folders, not rows
        kept = self.rows_of(hit).join(touched, id, "left_anti")
        fresh = kept if changes is None else kept.unionByName(changes.select(*kept.columns))
        folder, _ = self.stage(fresh)
        while True:
            try:
                return self.commit(before, [folder], hit, "change").version
            except Conflict:
                latest = self.entry()
                came = [x for x in latest.folders if x not in set(before.folders)]
                if not set(hit) <= set(latest.folders) or (came and self.rows_of(came).join(touched, id, "left_semi").limit(1).count()):
                    self.drop_staged(folder)
                    raise
                before = latest

    def compact(self) -> int:
        """All rows in one folder."""
        before = self.entry()
        folder, _ = self.stage(self.rows_of(before.folders))
        try:
            return self.commit(before, [folder], before.folders, "compact").version
        except Conflict:
            self.drop_staged(folder)
            raise

    def clean(self, keep: int = 1) -> list[str]:
        """Delete folders that none of the newest `keep` versions names, and entries before these. No writer may be at work."""
        last = self.version()
        named = {x for v in range(max(1, last - keep + 1), last + 1) for x in self.entry(v).folders}
        gone = sorted(x for x in (f"data/{n}" for n in self.files.names(f"{self.base}/data")) if x not in {"/".join(n.split("/")[:2]) for n in named})
        self.drop_staged(*gone)
        for v in range(1, last - keep + 1):
            self.files.delete(self._log(v))
        return gone
