"""Document fingerprints by SimHash, with DataFrame operations only.

Terms are pairs of neighbouring lower-cased words, and the last word by itself; each weighs its characters (24 at
most), so that pairs of function words say little. A term's XXH64 hash votes with its weight for or against each bit. The 64 counts of a
text travel as 32 sums of two 32-bit lanes, so a text is one row in the aggregation however long it is.

`within_radius` finds all fingerprints within a Hamming radius: the 64 bits are cut into blocks, and for each choice of
blocks that could stay equal a table is keyed by those blocks (the permutation that puts them first); queries look into
each table, and a pair is counted in the first table that holds it. Keys of many fingerprints are dealt out on both sides.

`with_next` deals rows into buckets of neighbouring ids. Their number and their size grow with the square root of the
table, so that bounds (and first rows) of buckets are few enough to be literals; an id that more rows hold than a few
buckets is dealt out further by a hash of the text.

Defined results: a null text counts as empty and has fingerprint zero; texts of any length are read whole; equal texts
have equal fingerprints; repeated rows and repeated ids get their own rows, ordered by id, then by a hash of the text;
a null id comes first; the only document is its own next one; an empty table gives an empty table; other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, keyed, spread_join

LANES = 32


def _terms(text: str) -> Column:
    words = F.array_remove(F.split(F.lower(text), "[ \\t-\\r]+"), "")
    return words


def add_fingerprints(df: DataFrame, text: str, keys: list[str], out: str = "fp") -> DataFrame:
    """(keys, out) for each row; keys must tell rows apart. No shuffle if df is partitioned by some of the keys."""
    words = df.select(*keys, _terms(text).alias("__w"))
    follows = F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0)))
    terms = words.select(*keys, F.inline_outer(F.arrays_zip(F.col("__w").alias("a"), follows.alias("b"))))
    weight = F.least(F.coalesce(F.length("a"), F.lit(0)) + F.coalesce(F.length("b"), F.lit(0)), F.lit(24)).cast("long")
    hashed = terms.select(*keys, F.xxhash64("a", "b").alias("__h"), weight.alias("__n"))

    def pair(k: int) -> Column:
        x = F.shiftrightunsigned("__h", 2 * k)
        return x.bitwiseAND(F.lit(1)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(2)), 31)) * F.col("__n")

    sums = hashed.groupBy(*keys).agg(F.sum("__n").alias("__all"), *[F.sum(pair(k)).alias(f"__{k}") for k in range(LANES)])

    def bits(k: int) -> Column:
        low, high = F.col(f"__{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"__{k}", 32)
        one = lambda count, bit: F.when(count * 2 > F.col("__all"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))
        return one(low, 2 * k).bitwiseOR(one(high, 2 * k + 1))

    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), [bits(k) for k in range(LANES)]).alias(out))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long. Rows of the same id and text are told apart by nothing, so they share one row."""
    base = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = base.withColumn("k", F.xxhash64("text")).withColumn("k2", F.crc32(F.col("text").cast("binary")))
    return add_fingerprints(keyed, "text", ["doc_id", "k", "k2"]).select("doc_id", "fp")


def likeness(a: Column | str, b: Column | str) -> Column:
    """The cosine that the differing bits stand for, at least 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.greatest(F.lit(0.0), F.when(a == b, 1.0).otherwise(F.cos(F.bit_count(a.bitwiseXOR(b)) * (math.pi / 64))))


def _bucket(value: str, bounds: list[int]) -> Column:
    """Number of bounds that are smaller, looked up in two levels."""
    if not bounds:
        return F.lit(0)
    wide = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    literal = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)  # noqa: E731  one literal, however many values
    smaller = lambda arr: F.size(F.filter(arr, lambda x: x < F.col(value)))
    outer = smaller(literal([g[0] for g in groups], "array<bigint>"))  # groups that begin below the value
    inner = smaller(F.element_at(literal(groups, "array<array<bigint>>"), F.greatest(outer, F.lit(1))))
    return F.when(outer == 0, 0).otherwise((outer - 1) * wide + inner)


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = 1000) -> DataFrame:
    """(bucket, rn, guest, doc_id, text, next_text): the text of the next document in ascending id, the first's after the last.

    bucket_rows: least rows a bucket; the square root of their number where that is more. The first row of each bucket is
    also a guest (to be left out of results) at the end of the bucket before, so one shuffle brings all neighbours together.
    """
    spark = df.sparkSession
    base = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("h", F.xxhash64("text"))
    count = base.count()
    size = max(bucket_rows, math.isqrt(count))
    buckets = max(1, count // size)
    bounds: set[int] = set()
    if buckets > 1:
        shares = F.from_json(F.lit(json.dumps([i / buckets for i in range(1, buckets)])), "array<double>")  # one literal
        bounds = set(base.agg(F.percentile_approx("at", shares, max(20_000, 10 * buckets))).first()[0] or [])
    # ids that fill over four buckets: a quarter as many as buckets at most
    hot = {r["at"]: -(-r["n"] // size) for r in base.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > 4 * size).collect()}
    bounds |= {x for at in hot for x in (at, max(at, 1 - (1 << 63)) - 1)}
    placed = base.withColumn("bucket", F.shiftleft(_bucket("at", sorted(bounds)).cast("long"), 24))
    if hot:
        parts = F.broadcast(spark.createDataFrame(list(hot.items()), "at long, parts int"))
        share = (F.shiftrightunsigned(F.col("h").bitwiseXOR(_signed(1 << 63)), 11)).cast("double") / float(1 << 53)
        placed = placed.join(parts, "at", "left").withColumn("bucket", F.col("bucket") + F.coalesce(F.floor(share * F.col("parts")), F.lit(0))).drop("parts")
    firsts = sorted((r["bucket"], *r["f"]) for r in placed.groupBy("bucket").agg(F.min(F.struct("at", "h")).alias("f")).collect())  # one row a bucket
    if not firsts:
        return placed.select("bucket", F.lit(1).alias("rn"), F.lit(False).alias("guest"), "doc_id", "text", F.col("text").alias("next_text"))
    homes = F.broadcast(spark.createDataFrame([(at, h, firsts[k - 1][0]) for k, (_, at, h) in enumerate(firsts)], "at long, h long, home long"))
    guests = placed.join(homes, ["at", "h"]).dropDuplicates(["home"]).select(F.col("home").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text", "at", "h")
    rows = placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text", "at", "h").unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", "at", "h", "text")
    return rows.select("bucket", F.row_number().over(order).alias("rn"), "guest", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def compare_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next).

    The edited text has its last quarter of code points replaced by the first as many of the next document.
    """
    rows = with_next(df, doc_id, text)
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - k), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), k))
    rows = rows.select("bucket", "rn", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = rows.select("bucket", "rn", "guest", "doc_id", "n_chars", "edited_sha256", F.posexplode(F.array("text", "edited")).alias("which", "t"))
    about = ["bucket", "rn", "guest", "doc_id", "n_chars", "edited_sha256"]
    prints = add_fingerprints(both, "t", [*about, "which"])
    of = lambda w: F.max(F.when(F.col("which") == w, F.col("fp")))
    one = prints.groupBy(*about).agg(of(0).alias("fp"), of(1).alias("edited_fp"))
    order = Window.partitionBy("bucket").orderBy("rn")
    one = one.withColumn("next_fp", F.lead("fp").over(order)).where("not guest")
    return one.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks - radius blocks: two fingerprints within the radius agree on at least one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(c) for c in combinations(own, blocks - radius)]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None, part_rows: int = 4096) -> DataFrame:
    """queries (fp), prints (fp) -> (fp, n_within): how many rows of prints differ in at most radius bits, for distinct query fingerprints.

    blocks: so many that a table's key has about as many bits as there are fingerprints. A key of over part_rows
    fingerprints on either side is dealt out by parts of both.
    """
    counts = cut(prints.groupBy("fp").agg(F.count("*").alias("n")))
    asks = cut(queries.select("fp").distinct())
    if blocks is None:
        need = math.log2(max(2, counts.count()))
        blocks = next((b for b in range(radius + 1, radius + 5) if 64 * (b - radius) / b >= need), radius + 4)
    masks = block_masks(radius, blocks)
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(_signed(m)) for m in masks])).alias("table", "key")
    at = ["table", "key"]

    def dealt(rows: DataFrame, here: str, there: str) -> DataFrame:
        """rows in their own part of `here` and in all parts of `there`, both 1 but for large keys."""
        keyed = rows.select("*", tables)
        own = F.pmod(F.xxhash64("fp"), F.ceil(F.col(here) / part_rows))
        all_ = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(there) / part_rows) - 1))
        zero = F.lit(0).cast("long")
        few = keyed.join(large, at, "left_anti").select(*rows.columns, *at, zero.alias(here), zero.alias(there))
        many = keyed.join(F.broadcast(hot), at).unionByName(keyed.join(F.broadcast(hot.select(*at)), at, "left_anti").join(rest, at))
        return few.unionByName(many.select(*rows.columns, *at, own.alias(here), all_.alias(there)))

    sizes = lambda rows, name: rows.select(tables).groupBy(*at).agg(F.count("*").alias(name))
    either = sizes(counts, "held").join(sizes(asks, "asked"), at).where(f"greatest(held, asked) > {part_rows}")
    large = cut(either)
    total = large.agg(F.sum(F.col("held") + F.col("asked"))).first()[0] or 0
    hot = large.where((F.col("held") + F.col("asked")) * 1000 > total)  # at most 1000 keys by their counts
    rest = large.where((F.col("held") + F.col("asked")) * 1000 <= total)
    a = dealt(asks, "asked", "held").withColumnRenamed("fp", "q")
    b = dealt(counts, "held", "asked")
    differ = F.col("fp").bitwiseXOR(F.col("q"))
    first = [F.when(F.col("table") > t, differ.bitwiseAND(_signed(m)) != 0).otherwise(True) for t, m in enumerate(masks)]
    near = reduce(lambda x, y: x & y, first, F.bit_count(differ) <= radius)
    pairs = a.join(b, [*at, "held", "asked"]).where(near).groupBy("q").agg(F.sum("n").alias("n_within"))
    return asks.join(pairs, asks["fp"] == pairs["q"], "left").select("fp", F.coalesce("n_within", F.lit(0).cast("long")).alias("n_within"))


def report(df: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """compare_edited with n_within: for ids divisible by every, how many documents have a fingerprint within the radius (null for others)."""
    found = cut(compare_edited(df))
    is_asked = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    asked = cut(found.where(is_asked))
    near = within_radius(asked, found, radius).join(asked.groupBy("fp").agg(F.count("*").alias("n")), "fp")
    told = spread_join(asked, keyed(near), "fp").drop("n")
    return found.where(~is_asked).withColumn("n_within", F.lit(None).cast("long")).unionByName(told)
