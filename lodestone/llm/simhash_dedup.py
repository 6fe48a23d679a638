"""Near-duplicates by SimHash over word shingles, linked by a self-join of binary tries.

Fingerprints: lower-cased (A-Z) words, shingles of `width` words with repeats, XXH64 (seed 42) of each; a bit is set if
more than half of the hashes set it. A text without words has fingerprint zero.

Links: two fingerprints are linked if at most `radius` bits differ. Node pairs of a trie descend together, differing bits
add up, and a pair over its budget is dropped with all below. A subtree pair that is one component already is not walked
again, so a dense ball of near copies does not cost all its pairs. Only distinct fingerprints take part.

Small radius (`near_duplicates`): radius + 1 tries are walked, each over the bits turned to another of radius + 1 blocks.
Some turn has all running sums of its blocks' differing bits at or below their even share (the cycle lemma), so a trie's
budget is 0 in its first block, and the work is dealt out by the prefix inside it: a fingerprint goes to radius + 1 homes,
each the subtree of one prefix, up to 2^(64 / (radius + 1)) subtrees of 32,768. Beyond (over 134 million distinct
fingerprints at radius 4) a deeper prefix is taken, and a fingerprint also goes to the homes that the budget lets it
meet: 25 homes at radius 4 and depth 16, 65 at depth 25.

Wide radius (`verified_duplicates`): a similarity of 0.8 means about a sixth of all bits, for which prefixes are dealt
out to ever more homes as the table grows (hundreds a row from a few million on). There homes are dealt by min-wise keys
of the same shingles instead: `bands` keys a text, whatever the size of the table. Two texts of similarity 0.8 share none
of 24 keys of 5 hashes with a chance of 7e-5. Inside its homes each text meets the others in one trie walk with the whole
budget, over 256 bits (a 64-bit fingerprint and three further ones of remixed hashes); what that puts together is
compared on the shingles.

A home, or a group to compare, of any size is taken in blocks (`group_links`), so no task holds an unbounded group.

Defined results: a null text counts as empty, and texts without words are equal to each other; texts of any length are
read whole; an empty table gives an empty table; ties (equal fingerprints, equal texts) are one class; rows with the same
id each get their own row; other columns of the input are not read by near_duplicates and pass through
verified_duplicates, whatever their names; the result does not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard, keyed, pieces, small_batches, spread_join
from lodestone.llm.graph import Forest, components


def simhash(data: bytes, width: int) -> np.ndarray:
    """XXH64 values of all shingles of a text."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    n = max(1, len(words) - width + 1)
    ends = ends.tolist()
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(joined[s:e], 42) for s, e in zip(starts[:n], ends, strict=True)], np.uint64, n)


def votes(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint (uint64) for each array of hashes."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    for block in np.array_split(full, max(1, int(sizes.sum()) // 200_000)):
        if len(block):
            bits = np.unpackbits(np.concatenate([hashes[i] for i in block]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            starts = np.cumsum(sizes[block]) - sizes[block]
            counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[block] = np.packbits(counts * 2 > sizes[block][:, None], axis=1).view(">u8").reshape(-1)
    return out


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes under the k-th further hash function."""
    h = (h ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def least_hashes(hashes: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """texts x bands: a key of `rows` least values under as many further hash functions; texts without hashes share one key a band."""
    odd = np.random.default_rng(11).integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(hashes), bands), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([hashes[i] for i in full])
        flat ^= flat >> np.uint64(31)
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k, m in enumerate(odd):
            mixed = flat * m
            mixed ^= mixed >> np.uint64(29)
            out[full, k // rows] += np.minimum.reduceat(mixed, starts) * odd[k % rows]
    return (out ^ np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def fingerprints(df: DataFrame, text: str = "text", width: int = 5, wide: int = 0, distinct: bool = False, bands: int = 0, rows: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, fp, w1, ... (further fingerprints) and k0, ... (min-wise keys), each 64 bits as a signed long. distinct: a repeated shingle votes once."""
    base = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    names = ["fp", *[f"w{k}" for k in range(1, wide + 1)], *[f"k{k}" for k in range(bands)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", 4 << 20):
                hashes = [simhash(x or b"", width) for x in part.column("__text").cast(pa.binary()).to_pylist()]
                if distinct:
                    hashes = [np.unique(h) for h in hashes]
                made = [votes([remixed(h, k) for h in hashes] if k else hashes).view(np.int64) for k in range(wide + 1)]
                made += [np.ascontiguousarray(c) for c in least_hashes(hashes, bands, rows).T]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *map(pa.array, made)], names=[*keep, *names])

    fields = ", ".join([f"`{c}` {t}" for c, t in base.dtypes if c != "__text"] + [f"{n} long" for n in names])
    return small_batches(base).mapInArrow(run, fields)


def text_key(text: str = "text"):
    """128 bits that tell texts apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _wide_range(forest: Forest, alo: int, ahi: int, blo: int, bhi: int, compare, most: int) -> None:
    """All pairs of two ranges, at most `most` at once, without those that are one component already."""
    a, b = np.arange(alo, ahi), np.arange(blo, bhi)
    while len(a):
        here = forest.label[a[0]]
        other = b[forest.label[b] != here]
        for at in range(0, len(other), most):
            compare(np.full(len(other[at : at + most]), a[0]), other[at : at + most])
        a = a[1:]
        if len(other) and len(a):  # rows that are one component with everything they could meet have nothing to add
            labels = np.unique(forest.label[b])
            if len(labels) == 1:
                a = a[forest.label[a] != labels[0]]
        elif len(a) and not len(other):
            a = a[forest.label[a] != here]


def blocks_of(turns: int, turn: int) -> list[int]:
    """Where the blocks of a fingerprint end once it is turned so that block `turn` comes first."""
    edges = [64 * k // turns for k in range(turns + 1)]
    sizes = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    return np.cumsum(sizes[turn:] + sizes[:turn]).tolist()


def budgets(radius: int, ends: list[int]) -> list[int]:
    """Differing bits allowed down to each depth from 0 to 64: each block's even share once it has begun."""
    return [radius * sum(d > e for e in [0, *ends[:-1]]) // len(ends) for d in range(65)]


def trie_links(keys: np.ndarray, group: np.ndarray, allowed: list[int], wide: np.ndarray | None = None, wide_radius: int = 0, most: int = 1 << 17, forest: Forest | None = None) -> np.ndarray:
    """Component labels of uint64 keys, sorted by (group, key), by links inside each group: at most allowed[d] bits differ down to each depth d, 64 the last.

    wide: keys x further fingerprints, which with the first may differ in wide_radius bits together. All groups' tries are
    walked at once. Pairs of ranges are taken from a stack in chunks of at most `most`, and pairs of keys compared about
    four times as many at once, also inside a range of equal keys, so memory stays bounded.
    """
    forest = forest or Forest(len(keys))
    if not len(keys):
        return forest.label
    radius = allowed[64]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.append(starts[1:], len(keys))
    stack = [(0, np.stack([starts, ends, starts, ends, np.zeros(len(starts), int)]).astype(np.int32))]
    ones = {}

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        near = (np.bitwise_count(keys[i] ^ keys[j]) <= radius) & (i != j)
        i, j = i[near], j[near]
        if wide is not None and len(i):
            near = np.bitwise_count(keys[i] ^ keys[j]) + np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= wide_radius
            i, j = i[near], j[near]
        if len(i):
            forest.join(i, j)

    while stack:
        d, (alo, ahi, blo, bhi, err) = stack.pop()
        own = alo == blo
        keep = ~(forest.one(alo, ahi, blo, bhi) & ((ahi - alo > 1) | ~own)) & ~(own & (ahi - alo < 2))
        alo, ahi, blo, bhi, err, own = (x[keep] for x in (alo, ahi, blo, bhi, err, own))
        few = (ahi - alo).astype(np.int64) * (bhi - blo) <= 32
        if d == 64:
            few[:] = True
        if few.any():
            size = (ahi - alo).astype(np.int64) * (bhi - blo)
            for k in np.flatnonzero(few & (size > 4 * most)):
                _wide_range(forest, int(alo[k]), int(ahi[k]), int(blo[k]), int(bhi[k]), compare, 4 * most)
            part_of = few & (size <= 4 * most)
            a0, b0, nb, n = alo[part_of], blo[part_of], (bhi - blo)[part_of], size[part_of]
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // (4 * most))) + 1):
                which = np.repeat(part, n[part])
                k = np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                compare(a0[which] + k // nb[which], b0[which] + k % nb[which])
            alo, ahi, blo, bhi, err, own = (x[~few] for x in (alo, ahi, blo, bhi, err, own))
        if not len(alo):
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum(keys >> np.uint64(63 - d) & np.uint64(1))]).astype(np.int32)
        c = ones[d]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        cross = ~own
        parts = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            (amid[cross], ahi[cross], blo[cross], bmid[cross], err[cross] + 1),
        ]
        down = np.concatenate([np.array(p, np.int32) for p in parts], axis=1)
        down = down[:, (down[1] > down[0]) & (down[3] > down[2]) & (down[4] <= allowed[d + 1])]
        for x in np.array_split(down, max(1, -(-down.shape[1] // most)), axis=1):
            if x.shape[1]:
                stack.append((d + 1, x.copy()))
    return forest.label


def group_links(members: DataFrame, payload: DataFrame, link: Callable, block: int, bucket_rows: int = 1 << 16) -> DataFrame:
    """members (g, id): rows of one group may be linked; payload (id, ...) -> (node, component) over all groups.

    link(pdf, same): component labels of pdf's rows (g, home, id, the payload's columns; sorted by g, whose values number
    the groups), by links inside each value of g; same holds what is known, equal values for rows of one component. home
    is g as given in members.

    A group of up to `block` rows is linked in one task. A larger one is dealt into blocks by a hash, then, with what
    that has joined, into others by another hash, which makes a dense group one component. What is outside its largest
    component then meets all of the group, in pairs of blocks: no link is lost, and pairs inside a dense group are not
    taken all.
    """
    members = cut(members)
    sizes = keyed(members.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(spread_join(members, sizes, "g"))
    about = cut(payload.join(shared.select("id").distinct(), "id", "left_semi"))
    parts = max(4 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), (sizes.measured["total"] or 0) // bucket_rows)
    spent = [members, sizes, shared, about]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "deal", "id"], ignore_index=True)
        g = pdf.groupby(["g", "deal"], sort=False).ngroup().to_numpy()
        same = pdf.assign(g=g).groupby(["g", "same"], sort=False).ngroup().to_numpy()
        label = link(pdf.drop(columns=["deal", "same", "bucket"]).rename(columns={"g": "home"}).assign(g=g), same)
        i, ids = np.flatnonzero(label != np.arange(len(label))), pdf["id"].to_numpy()
        return pd.DataFrame({"a": ids[i], "b": ids[label[i]]})

    def linked_in(dealt: DataFrame) -> DataFrame:
        """dealt (g, deal, id, same) -> (a, b). Groups of one bucket are linked at once."""
        rows = dealt.join(about, "id").withColumn("bucket", F.pmod(F.xxhash64("g", "deal"), F.lit(parts)))
        out = cut(rows.groupBy("bucket").applyInPandas(run, "a long, b long"))
        spent.append(out)
        return out

    blocks = F.ceil(F.col("n") / block)
    number = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n)
    edges = linked_in(shared.select("g", number(1, blocks).alias("deal"), "id", F.col("id").alias("same")))
    large = shared.where(F.col("n") > block)
    if (sizes.measured["most"] or 0) > block:
        edges = edges.unionByName(linked_in(large.select("g", number(2, blocks).alias("deal"), "id", F.col("id").alias("same"))))
    found = components(edges)
    if (sizes.measured["most"] or 0) > block:
        named = cut(large.join(found, F.col("id") == F.col("node"), "left").select("g", "id", "n", F.coalesce("component", "id").alias("same")))
        sums = named.groupBy("g", "n", "same").agg(F.count("*").alias("m")).groupBy("g", "n").agg(F.max(F.struct("m", "same")).alias("main"))
        open_ = keyed(sums.where("main.m < n").select("g", "n", F.col("main.same").alias("main"), F.ceil((F.col("n") - F.col("main.m")) / block).alias("outer")))
        spent += [named, open_]
        if open_.measured["total"]:
            rows = cut(spread_join(named.drop("n"), open_, "g"))
            spent.append(rows)
            every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
            inner = rows.select("g", "id", "same", number(3, blocks).alias("x"), every(F.col("outer")).alias("y"))
            outer = rows.where("same <> main").select("g", "id", "same", every(blocks).alias("x"), number(4, F.col("outer")).alias("y"))
            last = linked_in(inner.unionByName(outer).distinct().select("g", F.xxhash64("x", "y").alias("deal"), "id", "same"))
            found = components(edges.unionByName(last))
    discard(*spent)
    return found


def _walk(g: np.ndarray, same: np.ndarray, keys: np.ndarray, allowed: list[int], wide: np.ndarray | None = None, wide_radius: int = 0) -> np.ndarray:
    """trie_links for rows sorted by g only."""
    order = np.lexsort((keys, g))
    label = trie_links(keys[order], g[order], allowed, None if wide is None else wide[order], wide_radius, forest=Forest(len(keys), same[order]))
    out = np.empty(len(keys), int)
    out[order] = order[label]
    return out


def linked(prints: DataFrame, radius: int = 3, subtree: int = 32768, block: int = 1 << 18) -> DataFrame:
    """prints (fp; distinct) -> (fp, component: smallest fp of its component), for linked ones only. subtree: about how many share a home; block: how many of a home are walked at once."""
    if not 0 <= radius <= 15:
        raise ValueError("radius must be from 0 to 15")
    turns = radius + 1
    depth = min(59, max(6, int(np.ceil(np.log2(max(1, prints.count()) / subtree)))))
    turned_by = [64 * k // turns for k in range(turns)]
    allowed = [budgets(radius, blocks_of(turns, t)) for t in range(turns)]
    homes = None
    for turn, by in enumerate(turned_by):
        value = F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", 64 - by)) if by else F.col("fp")
        prefix = F.shiftrightunsigned(value, 64 - depth)
        masks = [sum(1 << b for b in bits) for k in range(allowed[turn][depth] + 1) for bits in combinations(range(depth), k)]
        # two prefixes within the budget meet in the home of the larger one
        home = F.explode(F.filter(F.array(*[prefix.bitwiseXOR(F.lit(m).cast("long")) for m in masks]), lambda h: h >= prefix))  # noqa: B023
        part = prints.select(home.alias("home"), F.col("fp").alias("id")).select((F.shiftleft("home", 4) + turn).alias("g"), "id")
        homes = part if homes is None else homes.unionByName(part)

    def link(pdf: pd.DataFrame, same: np.ndarray) -> np.ndarray:
        g, keys, of = pdf["g"].to_numpy(), pdf["id"].to_numpy().view(np.uint64), pdf["home"].to_numpy() & 15
        label = np.arange(len(g))
        for turn, by in enumerate(turned_by):
            rows = np.flatnonzero(of == turn)
            if len(rows):
                own = keys[rows] << np.uint64(by) | keys[rows] >> np.uint64(64 - by) if by else keys[rows]
                label[rows] = rows[_walk(g[rows], same[rows], own, allowed[turn])]
        return label

    return group_links(homes, prints.select(F.col("fp").alias("id")), link, block).withColumnRenamed("node", "fp")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): for each row its fingerprint and the smallest id that links lead to, its own included. A null id is never the smallest unless all are null."""
    docs = cut(fingerprints(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", width))
    classes = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    groups = linked(classes.select("fp"), radius)
    named = cut(classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = keyed(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    final = keyed(spread_join(named.drop("least").withColumnRenamed("n", "rows"), least, "component").select("fp", "component_id", F.col("rows").alias("n")))
    return spread_join(docs, final, "fp").select("doc_id", "fp", "component_id")


def alike(sets: list[np.ndarray], threshold: float, forest: Forest) -> np.ndarray:
    """Component labels of sets of shingles linked from the Jaccard threshold up."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, at = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(values), bool)
    for i in range(len(sets)):
        ask = forest.label != forest.label[i]
        ask[:i] = False
        if ask.any():
            own = at[starts[i] : starts[i] + sizes[i]]
            marked[own] = True
            shared = np.bincount(owner, weights=marked[at], minlength=len(sets))
            marked[own] = False
            total = sizes + sizes[i] - shared
            j = np.flatnonzero(ask & (shared >= threshold * total))  # two texts without words are alike
            if len(j):
                forest.join(np.full(len(j), i), j)
    return forest.label


def verified_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 5, radius: int = 22, wide_radius: int = 62, block: int = 256, home_block: int = 1 << 16) -> DataFrame:
    """(key, least, n, component) for each distinct text of df: its text_key, the smallest id of its rows, their number, and its component.

    A link is a Jaccard similarity of distinct shingles from the threshold up. Candidates are texts that the trie walks of
    their homes put together; each group of candidates is then compared on its shingles.
    """
    keyed = df.select(text_key(text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    prints = fingerprints(keyed, "text", width, 3, True, bands, rows, keep=("key", "doc_id"))
    further, keys = ["w1", "w2", "w3"], [f"k{k}" for k in range(bands)]
    texts = prints.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("fp", *further, *keys)])
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))

    def near(pdf: pd.DataFrame, same: np.ndarray) -> np.ndarray:
        wide = np.stack([pdf[c].to_numpy().view(np.uint64) for c in further], axis=1)
        return _walk(pdf["g"].to_numpy(), same, pdf["fp"].to_numpy().view(np.uint64), [radius] * 65, wide, wide_radius)

    def verify(pdf: pd.DataFrame, same: np.ndarray) -> np.ndarray:
        label, g = np.arange(len(pdf)), pdf["g"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            sets = [np.unique(simhash((x or "").encode(), width)) for x in pdf["text"].iloc[a:b]]
            label[a:b] = a + alike(sets, threshold, Forest(b - a, same[a:b]))
        return label

    found = group_links(texts.select(F.explode(F.array(*keys)).alias("g"), "id"), texts.select("id", "fp", *further), near, home_block)
    asked = texts.select("id", "key").join(found.select(F.col("node").alias("id")), "id", "left_semi")
    whole = keyed.groupBy("key").agg(F.first("text").alias("text")).join(asked, "key").select("id", "text")
    groups = group_links(found.select(F.col("component").alias("g"), F.col("node").alias("id")), whole, verify, block, 4096)
    return texts.select("key", "least", "n", "id").join(groups, F.col("id") == F.col("node"), "left").select("key", "least", "n", F.coalesce("component", "id").alias("component"))


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
