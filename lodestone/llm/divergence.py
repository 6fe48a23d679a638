"""Source divergence audit: how far each source's chances of words are from those of other sources and of its language.

One pass over the texts counts the words of each (lang, source) in its task, with the number of documents that hold them,
and adds these to a count-min sketch of document frequencies a language. The sketches of all tasks are merged. A cell
stops at the least frequency that is asked for, so it takes two bits and never says less than what is true up to that
limit: a term of which some cell says less is in too few documents, and its rows go no further. What passes is shuffled
once, by language and term, and counted exactly.

Sums over pairs of sources are sparse. With z the chance of a term that a source doesn't have, the sum over all terms is
what it would be if both sources never shared one (which the number of terms a count tells), plus a correction for each
shared term, found by joining the counts on language and term with the smaller source on one side.

All arithmetic is on integers: chances by divisions of longs, or of decimals where a product would pass 64 bits.

Memory: a task's tables are written out when they hold `most_terms` entries; a sketch has a cell for every `bytes_a_cell`
bytes of text, in three rows, at most `most_cells` a row (12 MB broadcast at 2^24). Beyond that it lets more terms pass to the
exact count, which gives the same result.

Defined results: null texts, languages and sources are empty strings; texts of any length are read whole; repeated rows
and null ids are documents of their own; ties go to the item that is smaller in UTF-8; a language without kept terms
gives pairs of value 0; a language of one source gives no pairs; an empty table gives an empty table; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard, keyed, pieces, small_batches, spread_join, utf8

DEPTH = 3
#: bytes of a block of packed cells
BLOCK = 1 << 14
_SEPARATORS = [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: separators become spaces, A to Z small letters
_FOLD = bytes(32 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each 64-bit hash in each row of the sketch."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return [((low + np.uint64(d) * high) % np.uint64(width)).astype(np.int64) for d in range(DEPTH)]


class Sketch:
    """Count-min over `width` cells a row; cells stop at `most` (3 or less)."""

    def __init__(self, width: int, most: int):
        self.most, self.width = most, width
        self.count = np.zeros((DEPTH, width), np.uint8)

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        for row, at in zip(self.count, cells(h, self.width), strict=True):
            some, where = np.unique(at, return_inverse=True)
            row[some] = np.minimum(row[some] + np.bincount(where, weights=n), self.most)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        flat = packed(self.count.ravel())
        for k in range(0, len(flat), BLOCK):
            part = flat[k : k + BLOCK]
            if part.any():
                yield k // BLOCK, part.tobytes()


def packed(x: np.ndarray) -> np.ndarray:
    """Four cells of two bits a byte."""
    x = np.pad(x, (0, -len(x) % 4)).reshape(-1, 4)
    return x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6


def merged(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Sum of packed cells, each stopped at `most`."""
    out = np.zeros_like(a)
    for s in (0, 2, 4, 6):
        out |= np.minimum((a >> s & 3) + (b >> s & 3), most) << s
    return out


def _partial(df: DataFrame, lang: str, source: str, text: str, width: int, least: int, most_terms: int) -> DataFrame:
    """(lang, source, term, n, df) of each task, a row of the empty term for each group, and the blocks (block, cells) of its sketch."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = df.select(words(lang).alias("lang"), words(source).alias("source"), words(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(width, least)
        count: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            frequency: dict[bytes, Counter] = {}
            for (la, so), (n, docs) in count.items():
                for terms in batched(n, 1 << 16):
                    string = pa.array([b"", *terms], pa.binary()).view(pa.string())
                    size = len(string)
                    made = [pa.array([x] * size, pa.binary()).view(pa.string()) for x in (la, so)]
                    yield pa.RecordBatch.from_arrays([*made, string, pa.array([0, *map(n.__getitem__, terms)], pa.int64()), pa.array([0, *map(docs.__getitem__, terms)], pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=NAMES)
                frequency.setdefault(la, Counter()).update(docs)
            for la, docs in frequency.items():
                if docs:
                    seed = xxhash.xxh64_intdigest(la, 42)
                    h = np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in docs), np.uint64, len(docs))
                    sketch.add(h, np.fromiter(docs.values(), np.int64, len(docs)))
            count.clear()

        for batch in batches:
            for part in pieces(batch, "__text", 4 << 20):
                langs, sources = (part.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source"))
                raw, off = utf8(part.column("__text"))
                data = raw.tobytes().translate(_FOLD)
                for k in range(part.num_rows):
                    terms = data[off[k] : off[k + 1]].split()
                    n, docs = count.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                    n.update(terms)
                    docs.update(set(terms))
                held = sum(len(n) for n, _ in count.values())
                if held >= most_terms:
                    yield from rows()
        yield from rows()
        for some in batched(sketch.blocks(), 64):
            blank = [pa.nulls(len(some), t) for t in (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array([k for k, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=NAMES)

    return small_batches(base).mapInArrow(run, "lang string, source string, term string, n bigint, df bigint, block int, cells binary")


NAMES = ["lang", "source", "term", "n", "df", "block", "cells"]


def batched(items, size: int) -> Iterator[list]:
    """Lists of up to size items; one empty list where there are none."""
    it = iter(items)
    yield list(itertools.islice(it, size))
    while some := list(itertools.islice(it, size)):
        yield some


def merge_sketches(parts: DataFrame, width: int, least: int) -> np.ndarray:
    """Packed cells of all rows of parts (block, cells), merged in the tasks that read them, then by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                one = np.frombuffer(raw, np.uint8)
                held[k] = merged(held[k], one, least) if k in held else one
        for some in batched(held.items(), 64):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([b.tobytes() for _, b in some], pa.binary())], names=["block", "cells"])

    schema = "block int, cells binary"
    found = parts.mapInArrow(run, schema).repartition("block").mapInArrow(run, schema).collect()  # at most the sketch's own size
    flat = np.zeros(-(-DEPTH * width // 4), np.uint8)
    for r in found:
        flat[r["block"] * BLOCK : r["block"] * BLOCK + len(r["cells"])] = np.frombuffer(r["cells"], np.uint8)
    return flat


def possible(flat: np.ndarray, width: int, least: int):
    """A column function: whether the sketch allows a term of this hash in `least` documents."""

    @F.pandas_udf("boolean")
    def test(h):
        import pandas as pd

        at, fine = cells(h.to_numpy(), width), np.ones(len(h), bool)
        for d in range(DEPTH):
            k = at[d] + d * width
            fine &= (flat[k >> 2] >> (2 * (k & 3)).astype(np.uint8) & 3) >= least
        return pd.Series(fine)

    return test


def chance(n: Column, total: Column, v: Column, unit: int = 1_000_000_000) -> Column:
    """1 + floor(unit * (n + 1) / (total + v)), exact."""
    more, by = n + 1, total + v
    wide = F.call_function("div", F.lit(unit).cast("decimal(10,0)") * more.cast("decimal(20,0)"), by.cast("decimal(20,0)"))
    return F.when(more <= ((1 << 63) - 1) // unit, F.call_function("div", F.lit(unit).cast("long") * more, by)).otherwise(wide) + 1


def far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, top: int = 200, bytes_a_cell: int = 256, most_cells: int = 1 << 24, most_terms: int = 1 << 19) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has all other sources of the lang, `term` the `top` terms that are more likely in the source than in the lang."""
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    width = 1 << min(max(size // bytes_a_cell, 1 << 12), most_cells).bit_length() - 1
    stop = min(least, 3)
    partial = cut(_partial(df, lang, source, text, width, stop, most_terms))
    flat = merge_sketches(partial.where("block is not null").select("block", "cells"), width, stop)
    found = partial.where("block is null and term <> ''").select("lang", "source", "term", "n", "df")
    passed = found.where(possible(flat, width, stop)(F.xxhash64("lang", "term")))
    # one shuffle: a term's rows of all sources are together
    summed = passed.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("times"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term").orderBy("source")
    whole = of_term.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact = summed.select("lang", "source", "term", "times", F.sum("df").over(whole).alias("df"), F.sum("times").over(whole).alias("all_times"), (F.row_number().over(of_term) == 1).alias("first"))
    counts = cut(exact.where(F.col("df") >= least).drop("df"))

    places = partial.where("block is null").select("lang", "source").distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("times").alias("total"), F.count("*").alias("n"))
    langs = counts.groupBy("lang").agg(F.sum("times").alias("all_total"), F.count_if("first").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    named = places.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *map(zero, ("total", "n", "all_total", "v")))
    rare = F.when(F.col("v") > 0, chance(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(1)
    groups = keyed(named.withColumn("z", rare).withColumn("g", F.monotonically_increasing_id()))
    discard(partial)

    rows = spread_join(counts, groups, ["lang", "source"]).select(
        "lang", "source", "term", "g", "z", chance(F.col("times"), F.col("total"), F.col("v")).alias("p"), chance(F.col("all_times"), F.col("all_total"), F.col("v")).alias("q")
    )
    ranks = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    more = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far(F.col("p"), F.col("q")).alias("value"))
    terms = ranks(more).where(F.col("rank") <= top)
    pairs = ranks(_pairs(rows, groups))
    return terms.unionByName(pairs).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) for every two sources of a language."""
    c, tasks = F.col, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = lambda own, other, value: F.struct(c(own).alias("own"), c(other).alias("other"), value.alias("value"))
    # the other sources of a language, copied for each slice, so that a language's rows spread over all tasks
    others = groups.select("lang", c("source").alias("item"), c("g").alias("h"), c("z").alias("y"), c("n").alias("n_item"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("slice"))
    sliced = lambda x, *by: x.withColumn("slice", F.pmod(F.xxhash64(*by), F.lit(tasks)).cast("int"))

    none = sliced(groups, "g").join(others, ["lang", "slice"]).where("g <> h").select(
        c("g").alias("own"), c("h").alias("other"), "lang", "source", "item", F.when(c("v") > 0, (c("v") - c("n") - c("n_item")) * far(c("z"), c("y"))).otherwise(0).alias("value")
    )
    alike = rows.groupBy("lang", "g", "p").agg(F.count("*").alias("m"))
    alone = sliced(alike, "g", "p").join(others, ["lang", "slice"]).where("g <> h").select(F.explode(F.array(both("g", "h", c("m") * far(c("p"), c("y"))), both("h", "g", c("m") * far(c("y"), c("p"))))).alias("x"))
    right = rows.select("lang", "term", c("g").alias("h"), c("z").alias("y"), c("p").alias("r"))
    added = lambda p, z, r, y: F.sum(far(p, r) - far(p, y) - far(z, r) + far(z, y))
    shared = rows.select("lang", "term", "g", "z", "p").join(right, ["lang", "term"]).where("g < h").groupBy("g", "h").agg(
        added(c("p"), c("z"), c("r"), c("y")).alias("there"), added(c("r"), c("y"), c("p"), c("z")).alias("back")
    )
    shared = shared.select(F.explode(F.array(both("g", "h", c("there")), both("h", "g", c("back")))).alias("x"))
    sums = none.unionByName(alone.unionByName(shared).select("x.*"), allowMissingColumns=True).groupBy("own", "other")
    names = [F.max(x).alias(x) for x in ("lang", "source", "item")]  # one row of a pair has them
    total = sums.agg(*names, F.sum(c("value").cast("decimal(20,0)")).cast("long").alias("value"))
    return total.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
