"""Filtered top-k search over collections of vectors, for a batch of queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.operators.postings import BOOSTS, TITLE, dealt, head_of, small_batches


#: (queries) -> a function from batches of rows to the rows found; it is made once a task, so what it keeps of the queries is built once
Search = Callable[[pa.Table], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]


def meet_all(rows: DataFrame, queries: DataFrame, search: Search, schema: str, most_queries: int = 4096, block_queries: int = 1 << 14, part_rows: int = 1 << 16) -> DataFrame:
    """search(queries)(batches of rows) for all rows (with an id) and queries (with a qid). Up to most_queries go to each task with its rows unshuffled; more are dealt into blocks, and each block meets all rows, part by part."""
    spark = rows.sparkSession
    first = queries.limit(most_queries + 1).toArrow()
    if len(first) <= most_queries:
        shared = spark.sparkContext.broadcast(first)
        return rows.mapInArrow(lambda batches: search(shared.value)(batches), schema)
    blocks = -(-queries.count() // block_queries)
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-tasks // blocks), -(-rows.count() // part_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("__b", deal("qid", blocks)).withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("__p", deal("id", parts)).withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def both(q: pa.Table, r: pa.Table) -> pa.Table:
        found = list(search(q.drop_columns(["__b", "__p"]))(r.drop_columns(["__b", "__p"]).to_batches(max_chunksize=1 << 14))) if len(q) and len(r) else []  # an empty side has no match
        return pa.Table.from_batches(found, found[0].schema) if found else kind.empty_table()

    return left.groupBy("__b", "__p").cogroup(right.groupBy("__b", "__p")).applyInArrow(both, schema)


def meet(rows: DataFrame, queries: DataFrame, step: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, most_queries: int = 4096) -> DataFrame:
    """step(queries, a batch of rows) for all rows and queries, as in meet_all."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def search(asked: pa.Table):
        q = asked.to_pandas()
        return lambda batches: (pa.RecordBatch.from_pandas(step(q, b.to_pandas()), kind, preserve_index=False) for b in batches)

    return meet_all(rows, queries, search, schema, most_queries, most_queries)


class Best:
    """The k of smallest value of each query, ties to the smaller id, of all rows added; `least`: the k-th value so far, infinite before there are k."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts, self.fresh = k, np.full(n, np.inf), [], False

    def add(self, query: np.ndarray, value: np.ndarray, **more: np.ndarray) -> None:
        if len(query):
            self.parts.append(pd.DataFrame({"query": query, "value": value, **more}))
            self.fresh = True

    def rows(self) -> pd.DataFrame | None:
        """What is kept, in order."""
        if self.fresh:
            all_of = pd.concat(self.parts, ignore_index=True).sort_values(["query", "value", "id"], kind="stable")
            q = all_of["query"].to_numpy()
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            n = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
            last = n == self.k - 1
            self.least[q[last]] = all_of["value"].to_numpy()[last]
            self.parts, self.fresh = [all_of[n < self.k]], False
        return self.parts[0] if self.parts else None


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """queries x rows, each sum taken from the first component to the last, so that equal vectors get equal distances."""
    out = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        out += (q[:, k, None] - x[None, :, k]) ** 2 if metric == "l2" else q[:, k, None] * x[None, :, k]
    return out if metric == "l2" else 1 - out


def _stacked(vectors: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _measured(x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(vectors that can be measured, which these are): for cosine over their lengths, which are summed from the first component to the last."""
    if metric != "cosine":
        return x, np.arange(len(x))
    n = np.zeros(len(x))
    for t in range(x.shape[1]):
        n += x[:, t] * x[:, t]
    good = np.flatnonzero(n > 0)
    return x[good] / np.sqrt(n[good])[:, None], good


def _near(best: Best, q: np.ndarray, x: np.ndarray, metric: str, own: np.ndarray | None, ids: np.ndarray, rows: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows, distances) of all pairs that may be among the best.k of a query. Matrix products name them, with room for what their rounding can change; their distances are then summed as in _distances. own: rows of this id are left out."""
    d = x.shape[1]
    qn, xn = (q * q).sum(1), (x * x).sum(1)
    # the error of a sum of d products stays below (d + 2) roundings of the product of lengths
    room = 4 * (d + 8) * 2.3e-16 * (np.sqrt(qn) + np.sqrt(xn.max(initial=0.0)) + 1) ** 2
    same = pd.DataFrame({"id": own, "q": np.arange(len(q))}).merge(pd.DataFrame({"id": ids, "x": np.arange(len(x))}), on="id")[["q", "x"]].to_numpy() if own is not None else np.zeros((0, 2), int)
    with np.errstate(all="ignore"):
        for a in range(0, len(q), 256):
            b = min(a + 256, len(q))
            in_a = same[(same[:, 0] >= a) & (same[:, 0] < b)]
            for c in range(0, len(x), rows):
                e = min(c + rows, len(x))
                far = q[a:b] @ x[c:e].T
                far = qn[a:b, None] + xn[c:e] - 2 * far if metric == "l2" else 1 - far
                mine = in_a[(in_a[:, 1] >= c) & (in_a[:, 1] < e)] - (a, c)
                far[mine[:, 0], mine[:, 1]] = np.inf
                limit = best.least[a:b] + room[a:b]
                maybe = ~(far > limit[:, None])
                if maybe.sum() > 4 * best.k * (b - a) and best.k < e - c:
                    limit = np.fmin(limit, (np.fmin.reduce(far, axis=1) if best.k == 1 else np.partition(far, best.k - 1, axis=1)[:, best.k - 1]) + 2 * room[a:b])
                    maybe = ~(far > limit[:, None])
                maybe[mine[:, 0], mine[:, 1]] = False
                i, j = np.nonzero(maybe)
                for m in range(0, len(i), 1 << 16):
                    u, v = a + i[m : m + (1 << 16)], c + j[m : m + (1 << 16)]
                    exact = np.zeros(len(u))
                    for t in range(d):
                        exact += (q[u, t] - x[v, t]) ** 2 if metric == "l2" else q[u, t] * x[v, t]
                    exact = exact if metric == "l2" else 1 - exact
                    keep = np.isfinite(exact) & (exact <= best.least[u])
                    yield u[keep], v[keep], exact[keep]


def top_k(chunks: DataFrame, queries: DataFrame, k: int, per_collection: bool = False, metric: str = "cosine", where: Column | None = None, not_self: bool = False, id: str = "id", collection: str = "collection", embedding: str = "embedding") -> DataFrame:
    """queries (qid, query_embedding[, self_id]) x chunks -> (qid, id, collection, distance, rank), k nearest for each query, or for each query and collection.

    Batches of rows meet the queries as matrix products; what these leave possible is measured in a fixed order of sums,
    and each task passes on its k nearest only, so neither vectors nor distances are shuffled. Ties go to the smaller id. Vectors of another length than the query's, null and zero (for
    cosine) ones and those that hold nulls take no part. not_self leaves out rows whose id is the query's self_id.
    """
    if metric not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown metric: {metric}")
    rows = chunks if where is None else chunks.where(F.coalesce(where, F.lit(False)))
    ready = lambda df, c: F.col(c) if dict(df.dtypes)[c] in ("array<float>", "array<double>") else F.col(c).cast("array<double>")
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    rows = rows.select(F.col(id).alias("id"), F.col(collection).alias("collection"), ready(rows, embedding).alias("__e"))
    asked = queries.select("qid", ready(queries, "query_embedding").alias("__q"), *(["self_id"] if not_self else []))
    fields = dict(rows.dtypes) | dict(asked.dtypes)
    schema = f"qid {fields['qid']}, id {fields['id']}, collection {fields['collection']}, distance double"
    kind = to_arrow_schema(StructType.fromDDL(schema))
    by = ["qid", "collection"] if per_collection else ["qid"]

    def search(asked: pa.Table):
        vectors, size = asked["__q"], pc.list_value_length(asked["__q"]).to_numpy()
        groups = {}
        for d in set(size.tolist()) - {0}:
            some = np.flatnonzero(size == d)
            q, good = _measured(_stacked(vectors.take(some), d), metric)
            own = asked["self_id"].to_pandas().to_numpy()[some[good]] if not_self else None
            groups[d] = (some[good], q, own)
        qids = asked["qid"]

        def out(pools: dict) -> Iterator[pa.RecordBatch]:
            for (d, name), pool in pools.items():
                rows = pool.rows()
                if rows is not None:
                    n = len(rows)
                    which = qids.take(groups[d][0][rows["query"].to_numpy()]).combine_chunks()
                    names = pa.array(rows["collection"], kind.field("collection").type, from_pandas=True) if not per_collection else pa.array([name] * n, kind.field("collection").type)
                    yield pa.RecordBatch.from_arrays([which, pa.array(rows["id"], kind.field("id").type, from_pandas=True), names, pa.array(rows["value"])], schema=kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pools: dict = {}
            for batch in batches:
                length = pc.list_value_length(batch["__e"]).to_numpy(zero_copy_only=False)
                for d, (_, q, own) in groups.items():
                    here = np.flatnonzero(length == d)
                    if not len(here):
                        continue
                    x, good = _measured(_stacked(batch["__e"].take(here), d), metric)
                    here = here[good]
                    ids, names = batch["id"].take(here).to_pandas().to_numpy(), batch["collection"].take(here).to_pandas()
                    codes, kinds = pd.factorize(names, use_na_sentinel=False) if per_collection else (np.zeros(len(here), int), [None])
                    for c, name in enumerate(kinds):
                        at = np.flatnonzero(codes == c)
                        name = None if pd.isna(name) else name
                        pool = pools.setdefault((d, name), Best(len(q), k))
                        for qi, xi, far in _near(pool, q, x[at], metric, own, ids[at]):
                            pool.add(qi, far, id=ids[at][xi], **({} if per_collection else {"collection": names.to_numpy()[at][xi]}))
                        pool.rows()
                if sum(len(p.rows()) for p in pools.values() if p.parts) > 1 << 21:  # of many collections: passed on, so that a task holds few
                    yield from out(pools)
                    pools = {}
            yield from out(pools)

        return run

    pairs = meet_all(rows.where(F.coalesce(whole("__e"), F.lit(False))), asked.where(F.coalesce(whole("__q"), F.lit(False))), search, schema, 1 << 14)
    order = Window.partitionBy(*by).orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_by_id(chunks: DataFrame, ids: list, k: int, id: str = "id", collection: str = "collection", embedding: str = "embedding") -> DataFrame:
    """The k nearest to each of the given rows, themselves left out."""
    asked = chunks.where(F.col(id).isin(ids)).select(F.col(id).alias("qid"), F.col(embedding).alias("query_embedding"), F.col(id).alias("self_id"))
    return top_k(chunks, asked, k, not_self=True, id=id, collection=collection, embedding=embedding)


def similarity_search(chunks: DataFrame, queries: DataFrame, k: int, weights: dict | None = None, threshold: float = 0.0, where: Column | None = None, id: str = "id", collection: str = "collection", embedding: str = "embedding") -> DataFrame:
    """k per collection, similarity = 1 - distance, times the collection's weight (1 if not named), kept from the threshold up, best first."""
    hits = top_k(chunks, queries, k, per_collection=True, where=where, id=id, collection=collection, embedding=embedding)
    similarity = 1 - F.col("distance")
    if weights:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        similarity = similarity * F.coalesce(F.element_at(table, F.col("collection")), F.lit(1.0))
    hits = hits.withColumn("similarity", similarity).drop("rank")
    if threshold > 0:
        hits = hits.where(F.col("similarity") >= threshold)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")))


def limited(hits: DataFrame, strategy: str, k: int, threshold: float = 0.8, factor: float = 0.5) -> DataFrame:
    """top_k; threshold_based: similarity from the threshold up, then k; diversified: every floor(1/factor)-th row, then k."""
    if strategy == "top_k":
        return hits.where(F.col("rank") <= k)
    if strategy == "threshold_based":
        return hits.where((F.col("similarity") >= threshold) & (F.col("rank") <= k))
    if strategy == "diversified":
        step = max(1, int(1 / factor))
        return hits.where(((F.col("rank") - 1) % step == 0) & ((F.col("rank") - 1) / step < k))
    raise ValueError(f"unknown strategy: {strategy}")


def page(hits: DataFrame, number: int = 1, size: int = 20, cursor: str | None = None) -> DataFrame:
    """Rows of a page with totals; a cursor is the offset as text, anything else than digits is 0."""
    offset = (int(cursor) if cursor.isdigit() else 0) if cursor is not None else (number - 1) * size
    total = F.count("*").over(Window.partitionBy("qid"))
    rows = hits.withColumn("total", total).where((F.col("rank") > offset) & (F.col("rank") <= offset + size))
    return rows.withColumn("has_next", F.col("total") > offset + size).withColumn("has_previous", F.lit(offset > 0))


def _ranked(scores: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scores.select("qid", "id", F.col("score").alias(f"{name}_score"), (F.row_number().over(order) - 1).alias(f"{name}_rank"))


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = 60, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """dense and sparse (qid, id, score) -> (qid, id, score): w / (k + rank + 1) summed, ranks from 0."""
    both = _ranked(dense, "dense").join(_ranked(sparse, "sparse"), ["qid", "id"], "full_outer")
    part = lambda name, w: F.coalesce(F.lit(w) / (k + F.col(f"{name}_rank") + 1), F.lit(0.0))
    return both.select("qid", "id", (part("dense", weights[0]) + part("sparse", weights[1])).alias("score"))


def weighted_fusion(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    both = _ranked(dense, "dense").join(_ranked(sparse, "sparse"), ["qid", "id"], "full_outer")
    part = lambda name, w: F.coalesce(w * F.col(f"{name}_score"), F.lit(0.0))
    return both.select("qid", "id", (part("dense", weights[0]) + part("sparse", weights[1])).alias("score"))


def tokens(text: Column | str) -> Column:
    """Distinct lower-cased tokens between white space."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), "\\s+"), ""))


class _QueryBlock:
    """Of a block of queries, which queries hold a word: of common words as a matrix, of the others as lists."""

    def __init__(self, n: int, query: np.ndarray, word: np.ndarray, column: np.ndarray, columns: int, words: int):
        common = column[word] >= 0
        self.n, self.matrix = n, np.zeros((columns, n), np.float32)
        self.matrix[column[word[common]], query[common]] = 1
        query, word = query[~common], word[~common]
        self.query = query[np.argsort(word, kind="stable")].astype(np.int32)
        self.held = np.bincount(word, minlength=words).astype(np.int32)
        self.start = np.cumsum(self.held) - self.held

    def shared(self, common: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
        """rows x queries: how many of a row's words a query holds. common: rows x columns; (row, word): the other words, without repetition."""
        out = common @ self.matrix
        n = self.held[word]
        some = n > 0
        row, word, n = row[some], word[some], n[some]
        end = np.cumsum(n)
        a = 0
        while a < len(n):
            before = end[a] - n[a]
            b = max(a + 1, int(np.searchsorted(end, before + (1 << 20), side="right")))
            m = n[a:b]
            at = np.repeat(self.start[word[a:b]] - (end[a:b] - m - before), m) + np.arange(end[b - 1] - before)
            out += np.bincount(np.repeat(row[a:b] * self.n, m) + self.query[at], minlength=out.size).reshape(out.shape)
            a = b
        return out


class _QueryWords:
    """The words of queries (qid, words, terms) as an index."""

    def __init__(self, asked: pa.Table, block_queries: int):
        self.n, self.qids = len(asked), asked["qid"]
        lists = asked["words"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        self.vocabulary = coded.dictionary
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        query, word = np.repeat(np.arange(self.n), size), coded.indices.to_numpy(zero_copy_only=False)
        held = np.bincount(word, minlength=len(self.vocabulary))
        # words that many queries hold are columns of a matrix, of 64 MB at most
        most = np.argsort(-held, kind="stable")[: (1 << 24) // max(self.n, 1)]
        most = most[held[most] * 16 >= self.n]
        self.column, self.columns = np.full(len(held), -1), len(most)
        self.column[most] = np.arange(len(most))
        self.sizes = size.astype(float)
        self.wants = np.array(asked["terms"].to_pylist(), bool).reshape(self.n, len(BOOSTS))
        self.most = self.wants @ np.array([*BOOSTS.values()]) + TITLE
        self.blocks = []
        for a in range(0, self.n, block_queries):
            here = slice(*np.searchsorted(query, [a, a + block_queries]))
            self.blocks.append((a, _QueryBlock(min(block_queries, self.n - a), query[here] - a, word[here], self.column, self.columns, len(held))))
        order = np.argsort(word, kind="stable")
        self.query, self.start = query[order].astype(np.int32), np.r_[0, np.cumsum(held)].tolist()
        self.at = {w: i for i, w in enumerate(self.vocabulary.to_pylist())}
        self.lengths = sorted({len(w) for w in self.at})
        self.inside: dict[str, int] = {}
        self.holders: dict[int, int] = {}

    def words(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the words of lower-cased texts that queries hold, rows in order; repeated."""
        lists = pc.ascii_split_whitespace(text)
        word = pc.index_in(lists.flatten(), self.vocabulary)
        row = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return row[word.is_valid().to_numpy(zero_copy_only=False)], word.drop_null().to_numpy(zero_copy_only=False)

    def _holders(self, i: int) -> int:
        """Bits of the queries that hold the i-th word."""
        bits = self.holders.get(i)
        if bits is None:
            has = np.zeros(self.n, bool)
            has[self.query[self.start[i] : self.start[i + 1]]] = True
            bits = self.holders[i] = int.from_bytes(np.packbits(has, bitorder="little").tobytes(), "little")
        return bits

    def _inside(self, word: str) -> int:
        """Bits of the queries of which a word lies within this one."""
        bits = self.inside.get(word)
        if bits is None:
            if (len(self.inside) + len(self.holders)) * (self.n // 8 + 100) > 1 << 26:  # kept within 64 MB a task
                self.inside, self.holders = {}, {}
            bits = 0
            for part in {word[a : a + n] for n in self.lengths if n <= len(word) for a in range(len(word) - n + 1)}:
                if (i := self.at.get(part)) is not None:
                    bits |= self._holders(i)
            self.inside[word] = bits
        return bits

    def title(self, head: str) -> np.ndarray:
        """Bits of the queries of which a word lies within the head. No word holds a space, so it lies within one of the head's."""
        bits = 0
        for word in set(head.split(" ")):
            bits |= self._inside(word)
        return np.frombuffer(bits.to_bytes(-(-self.n // 8), "little"), np.uint8)

    def found(self, batch: pa.RecordBatch, pools: list[Best], rows: int = 1024) -> None:
        """Adds to the pool of each block the rows of a batch that may be among the best of a query. What a row scores by its words and all bonuses of the query bounds it; only those that this leaves possible get their own bonuses."""
        all_rows, all_words = self.words(batch["text"])
        ids, heads = batch["id"].to_pandas().to_numpy(), batch["head"].to_pylist()
        terms = np.array(batch["terms"].to_pylist(), bool).reshape(len(ids), len(BOOSTS))
        for c in range(0, len(ids), rows):
            some = slice(*np.searchsorted(all_rows, [c, c + rows]))
            row, word = all_rows[some] - c, all_words[some]
            r = min(rows, len(ids) - c)
            column = self.column[word]
            common = np.zeros((r, self.columns), np.float32)
            common[row[column >= 0], column[column >= 0]] = 1
            key = np.sort(row[column < 0] * len(self.column) + word[column < 0])
            key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
            row, word = key // len(self.column), key % len(self.column)
            title, known = np.zeros((r, -(-self.n // 8)), np.uint8), np.zeros(r, bool)
            for (a, block), pool in zip(self.blocks, pools, strict=True):
                size, most, wants = self.sizes[a : a + block.n], self.most[a : a + block.n], self.wants[a : a + block.n]
                n = block.shared(common, row, word)
                least = -pool.least
                need = (least - most) * size
                new = np.flatnonzero(~np.isfinite(least))
                if len(new) and pool.k < r:
                    need[new] = np.partition(n[:, new], r - pool.k, axis=0)[r - pool.k] - most[new] * size[new]
                i, j = np.nonzero(n >= (need - 0.01).astype(np.float32))
                score = n[i, j] / size[j]
                for t, boost in enumerate(BOOSTS.values()):
                    if wants[:, t].any():
                        score += np.where(terms[c + i, t] & wants[j, t], boost, 0.0)
                for x in np.unique(i[~known[i]]):
                    title[x], known[x] = self.title(heads[c + x]), True
                q = a + j
                score = np.minimum(score + np.where(title[i, q >> 3] >> (q & 7) & 1, TITLE, 0.0), 1.0)
                keep = (score > 0) & (score >= least[j])
                if len(new) and keep.sum() > 4 * pool.k * block.n and pool.k < r:
                    scores = np.zeros(n.shape)
                    scores[i, j] = score
                    keep &= score >= np.partition(scores, r - pool.k, axis=0)[r - pool.k][j]
                pool.add(j[keep], -score[keep], id=ids[c + i[keep]])
                if sum(map(len, pool.parts)) > 4 * pool.k * block.n or not np.isfinite(pool.least).any():
                    pool.rows()


def lexical_search(docs: DataFrame, queries: DataFrame, k: int, id: str = "doc_id", text: str = "text", block_queries: int = 1024) -> DataFrame:
    """queries (qid, query) -> (qid, id, score, rank): share of query words in the text, with boosts for shared domain terms and for a query word within the first ten words; at most 1, above 0 only.

    One pass over the documents: the words of the queries are an index that each task makes once, in which a document's
    words are looked up once for all queries. Documents come in batches of 8 MB; 1,024 of them at a time meet
    `block_queries` queries, so a task holds that many counts of shared words. Only pairs that could be among the k best with
    all bonuses get their score, and a task passes on its k best. For searches that come again and again see
    lodestone.operators.postings, where the documents are indexed.
    """
    low = lambda c: F.lower(c)
    shared = lambda c: F.array(*[F.contains(low(c), F.lit(t)) for t in BOOSTS])
    # whether there is a word is asked without splitting: this filter goes below joins, to texts that are no queries
    q = queries.where(F.col("query").rlike("\\S")).select("qid", tokens("query").alias("words"), shared("query").alias("terms"))
    docs = dealt(docs.select(id, text))
    d = docs.select(F.col(id).alias("id"), low(text).alias("text"), head_of(text).alias("head"), shared(text).alias("terms")).where(F.col(text).isNotNull())
    schema = f"qid {dict(q.dtypes)['qid']}, id {dict(d.dtypes)['id']}, score double"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def search(asked: pa.Table):
        index = _QueryWords(asked, block_queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pools = [Best(block.n, k) for _, block in index.blocks]
            for batch in batches:
                index.found(batch, pools)
            for (a, _), pool in zip(index.blocks, pools, strict=True):
                rows = pool.rows()
                if rows is not None:
                    which = index.qids.take(a + rows["query"].to_numpy()).combine_chunks()
                    yield pa.RecordBatch.from_arrays([which, pa.array(rows["id"], kind.field("id").type, from_pandas=True), pa.array(-rows["value"])], schema=kind)

        return run

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return meet_all(small_batches(d), q, search, schema, 8 * block_queries, 8 * block_queries, 1 << 13).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of the token sets; both empty 1, one empty 0."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def rerank(hits: DataFrame, score: Column, candidates: int = 100, top: int | None = None, least: float | None = None) -> DataFrame:
    """The first candidates by rank get a new score, best first with ties by old rank; with least, lower ones go but the best always stays."""
    rows = hits.where(F.col("rank") <= candidates).withColumn("original_score", F.col("similarity")).withColumn("rerank_score", score)
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    rows = rows.withColumn("new_rank", F.row_number().over(order))
    if top is not None:
        rows = rows.where(F.col("new_rank") <= top)
    if least is not None:
        rows = rows.where((F.col("rerank_score") >= least) | (F.col("new_rank") == 1))
    return rows.withColumn("improvement", F.col("rerank_score") - F.col("original_score"))


def rerank_fallback(hits: DataFrame) -> DataFrame:
    """Without a scorer: by distance, each with score 0.5."""
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return hits.withColumn("rerank_score", F.lit(0.5)).withColumn("new_rank", F.row_number().over(order)).withColumn("improvement", 0.5 - F.col("similarity"))


def sigmoid_score(logit: Column, temperature: float = 1.0) -> Column:
    """A scorer's logit as a score; a failed (null) one is 0.5."""
    return F.coalesce(1 / (1 + F.exp(-logit / temperature)), F.lit(0.5))


def packed_context(hits: DataFrame, budget: int, text: str = "content") -> DataFrame:
    """Hits in rank order whose lengths still fit the budget together with those before."""
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("used", F.sum(F.length(text)).over(order)).where(F.col("used") <= budget)
