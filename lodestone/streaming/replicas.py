"""One stream written to several sinks, each batch once in each, and sinks that missed batches brought up again.

A sink is a folder: `batch=<number>` holds the rows of a batch, and an empty file of that number in `_marks` says that
they are all there. A batch that is run again after a failure overwrites its folder or, where it has its mark, is passed
over, so a sink has it once. Readers see marked batches only. If a sink fails, the others go on; what it missed is copied
later from one that has it, batch by batch, so a copy that dies goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.commits import Files


class Sink:
    def __init__(self, spark: SparkSession, path: str, schema, write: Callable[[DataFrame, str, int], None] | None = None):
        """write(rows, folder, number) puts a batch into a folder, as parquet if not given."""
        self.spark, self.base, self.schema, self.files = spark, path.rstrip("/"), schema, Files(spark, path)
        self._write = write or (lambda rows, folder, number: rows.write.mode("overwrite").parquet(folder))

    def _folder(self, number: int) -> str:
        return f"{self.base}/batch={number:012d}"

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.base}/_marks") if n.isdigit())

    def put(self, rows: DataFrame, number: int) -> bool:
        """Whether the batch was written; false if it was there."""
        if number in self.batches():
            return False
        self._write(rows, self._folder(number), number)
        return self.files.create(f"{self.base}/_marks/{number:012d}", "")

    def read(self, numbers: list[int] | None = None) -> DataFrame:
        found = self.batches() if numbers is None else numbers
        return self.spark.read.schema(self.schema).parquet(*map(self._folder, found)) if found else self.spark.createDataFrame([], self.schema)


def replicate(stream: DataFrame, sinks: list[Sink], checkpoint: str, failures: list | None = None, files_left: bool = True) -> StreamingQuery:
    """Write each batch of the stream to all sinks. A failing sink is noted in failures as (batch, sink, why) while another one takes the batch; if none does, the batch fails and is run again with the stream."""

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            failed = []
            for k, sink in enumerate(sinks):
                try:
                    sink.put(rows, number)
                except Exception as e:  # whatever a sink's own writer raises
                    failed.append((number, k, f"{type(e).__name__}: {e}"[:200]))
            if len(failed) == len(sinks):
                raise RuntimeError(f"no sink took batch {number}: {failed[0][2]}")
            if failures is not None:
                failures.extend(failed)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if files_left else writer).start()


def catch_up(source: Sink, target: Sink) -> list[int]:
    """Copy the batches that target lacks; their numbers."""
    missing = sorted(set(source.batches()) - set(target.batches()))
    for number in missing:
        target.put(source.read([number]), number)
    return missing


def first_healthy(sinks: list[Sink]) -> Sink:
    """The sink to read from: the first of those that have most batches."""
    return max(sinks, key=lambda s: len(s.batches()))
