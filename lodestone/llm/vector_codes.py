"""Vector code compression: product codebooks refined by k-means whose assignment is an Exponion search.

Each part of a vector starts at the entry it had in the round before. With d its squared distance to that entry, an entry
at least as near as the best one found so far (squared distance b) lies within sqrt(d) + sqrt(b) of the start, so within
the square root of 2 * (d + b): the other entries are visited in the order of their distance to the start, and the walk
ends at the first one outside that radius, which shrinks as b falls. All distances are exact integers and an entry that is
as near as the best one wins if its index is lower, so the result is that of a search through all entries.

Each round is one pass: every task writes its rows with their new codes, and as one more row its sums and counts for each
entry. These are added up by an aggregation, so the driver sees the codebooks alone. Tables of spent rounds are deleted.

Integers: floor(scale * x), of a float or double x without rounding. Where all are below 2^27 in absolute value (and
parts have at most 64 components) numpy's 64 bits hold every distance; else the same steps run on Python's integers.
Sums travel in digits of 40 bits and are added as decimals, so they are exact too.

Defined results: rows whose vector is null, empty, of another length than most (the shorter of equally common ones
stays) or holds null or non-finite components are dropped; a length that the number of parts doesn't divide is filled up
with zeros; null ids stay and are the last to start a codebook, and rows of equal id start in the order of their vectors;
with fewer rows than entries there are as many entries as rows; repeated rows are rows of their own; entries that no part
has stay as they are; null labels are one label; errors beyond 64 bits are the largest long; an empty table gives an
empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard, keyed, small_batches, spread_join

DIGIT = 40
SMALL = 1 << 27
MOST_LONG = (1 << 63) - 1


def integers(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of doubles. Scaling by a power of two is exact; wide values become Python's integers."""
    if not wide:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        top, bottom = float(v).as_integer_ratio()
        out[at] = top * scale // bottom
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


class Neighbours:
    """The entries of one codebook, each with all entries in the order of their distance to it (ties by index), itself first."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k = len(entries)
        between = squared(entries[:, None], entries[None])
        self.order = np.array([sorted(range(k), key=lambda j: (j != a, between[a, j], j)) for a in range(k)], np.int64).reshape(k, k)
        self.distance = np.take_along_axis(between, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, its squared distance) for each row of x, and how many distances were taken."""
        code, first = start.copy(), squared(x, self.entries[start])
        best, taken = first.copy(), len(x)
        walking = np.arange(len(x))
        for step in range(1, len(self.entries)):
            near = self.distance[start[walking], step] <= 2 * (first[walking] + best[walking])
            walking = walking[near.astype(bool)]
            if not len(walking):
                break
            j = self.order[start[walking], step]
            d = squared(x[walking], self.entries[j])
            taken += len(walking)
            wins = ((d < best[walking]) | ((d == best[walking]) & (j < code[walking]))).astype(bool)
            at = walking[wins]
            code[at], best[at] = j[wins], d[wins]
        return code, best, taken


def digits(value: int, n: int) -> list[int]:
    """value in n digits of 40 bits, lowest first; the last one has the sign."""
    out = []
    for _ in range(n - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def refined(books: list[np.ndarray], sums: list[int], width: int) -> list[np.ndarray]:
    """Entries replaced by floor(sum / count). sums: for each part and entry its components' sums, then the count."""
    out, at = [], 0
    for book in books:
        fresh = book.copy()
        for e in range(len(book)):
            *totals, count = sums[at : at + width + 1]
            at += width + 1
            if count:
                fresh[e] = [t // count for t in totals]
        out.append(fresh)
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(vec_id, label, code: two hex digits a part, error, label_error, codebooks_sha256) of each row that is kept."""
    kind = dict(df.dtypes)[label]
    v = F.col(embedding)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    base = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.cast("array<double>").alias("v")).where(F.coalesce(fine, F.lit(False)))
    lengths = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], f"vec_id bigint, label {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    dim = lengths[0]["d"]
    width = -(-dim // parts)
    wide = lengths[0]["most"] * scale >= SMALL or width > 64
    size = max(2, math.ceil((math.log2(max(lengths[0]["most"], 1)) + math.log2(scale) + 31) / DIGIT) + 1) if wide else 2
    base = base.where(F.size("v") == dim)
    first = base.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()  # as many rows as a codebook has entries

    def cut_up(x: np.ndarray) -> np.ndarray:
        return integers(np.pad(x, ((0, 0), (0, parts * width - dim))), scale, wide).reshape(len(x), parts, width)

    start = cut_up(np.array([r["v"] for r in first], float))
    books = [start[:, p] for p in range(parts)]
    k = len(first)

    def assign(books: list[np.ndarray], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = [Neighbours(b) for b in books]
            totals = np.zeros((parts, k, width + 1), object)
            labels = None
            for batch in batches:
                labels = batch.schema.field("label").type
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                    x = cut_up(flat.reshape(part.num_rows, dim))
                    old = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, parts).astype(np.int64)
                    found = [s.nearest(x[:, p], old[:, p]) for p, s in enumerate(searches)]
                    codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
                    columns = [part.column(c) for c in ("vec_id", "label")]
                    if last:
                        error = [min(int(e), MOST_LONG) for e in sum(f[1].astype(object) for f in found)]
                        hexes = [c.tobytes().hex() for c in codes]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(hexes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])
                        continue
                    for p, (code, _, _) in enumerate(found):
                        if wide:
                            np.add.at(totals[p], code, np.concatenate([x[:, p], np.ones((len(x), 1), object)], 1))
                        else:
                            one = np.zeros((k, width + 1), np.int64)
                            np.add.at(one, code, np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], 1))
                            totals[p] += one
                    none = pa.nulls(part.num_rows, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*columns, part.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), none], names=["vec_id", "label", "v", "code", "sums"])
            if labels is not None and not last:
                sums = [d for t in totals.ravel() for d in digits(int(t), size)]
                schema = {"vec_id": pa.int64(), "label": labels, "v": pa.list_(pa.float64()), "code": pa.binary()}
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in schema.values()], pa.array([sums], pa.list_(pa.int64()))], names=[*schema, "sums"])

        return run

    rows = base.withColumn("code", F.lit(bytes(parts)))
    spent = None
    for _ in range(rounds):
        now = cut(small_batches(rows).mapInArrow(assign(books, False), f"vec_id bigint, label {kind}, v array<double>, code binary, sums array<bigint>"))
        if spent is not None:
            discard(spent)
        added = now.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # as many rows as the codebooks have numbers
        flat = [0] * (parts * k * (width + 1))
        for r in added:
            flat[r["at"] // size] += int(r["x"]) << DIGIT * (r["at"] % size)
        books = refined(books, flat, width)
        rows, spent = now.where("sums is null").drop("sums"), now
    coded = cut(small_batches(rows).mapInArrow(assign(books, True), f"vec_id bigint, label {kind}, code string, error bigint"))
    if spent is not None:
        discard(spent)
    named = coded.withColumn("__null", F.col("label").isNull()).withColumn("__label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    by = ["__null", "__label"]
    sums = named.groupBy(*by).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("n"))
    joined = spread_join(named, keyed(sums), by)
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
