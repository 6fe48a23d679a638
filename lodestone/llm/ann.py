"""Approximate maximum inner product search with score-aware anisotropic quantisation.

Vectors are cut into short subvectors, each coded in four bits. What matters for the largest inner products is the part
of the residual along the vector itself, so the loss weighs that part `eta` times the part across it. Codes are chosen
by coordinate descent under that loss (the subvectors share the parallel part, so they are not independent), and the
code words solve its normal equations over all subvectors together. The codebooks are fitted on a bounded sample (about
`sample_rows` distinct rows of smallest hash); every row is coded, once.

Scan: blocks of rows (codes of 16 bytes for 64 dimensions, and their vectors) meet blocks of queries. For each query the
inner products with all code words are tabled, two codes to a byte, and looked up for each row; the best `rerank` of a
block and all tied with the last are scored in double precision. The `top`-th of these scores is a bound: a row is left
out only if its code says so, that is, if the looked up product and the length of the row's residual times that of the
query stay below the bound. All others are scored too. So the result is exact on any rows, also where many of them differ
by less than the codes can tell, and each block passes on `top` rows a query.

Of equal vectors only the top + 1 of smallest id can be in any result, so only these are candidates: one very common
vector costs nothing. Rows are told apart by a number of their own, so a query meets every row but itself.

Defined results: vectors that are null, zero, of another length than most (the shorter of equally common ones stays), or
hold null or non-finite components, and rows without an id take no part; ties go to the smaller id; repeated ids are rows
of their own, as queries (each ranks its own list) and as candidates; an empty table gives an empty table; other columns
of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, unit_hash

WORDS = 16
#: of original vectors in a block, in double precision
BUCKET_BYTES = 16 << 20


@dataclass
class Codebook:
    #: subspaces x 16 x dimensions of a subspace
    words: np.ndarray
    eta: float

    @property
    def dim(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))


def encode(book: Codebook, x: np.ndarray, sweeps: int = 3) -> np.ndarray:
    """rows x subspaces codes: nearest words, then coordinate descent on |r|^2 + (eta - 1) * (r . x / |x|)^2 for residual r."""
    x = book.padded(x)
    m, _, d = book.words.shape
    parts = x.reshape(len(x), m, d)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(len(x), m, d)
    plain = np.stack([((parts[:, j, None, :] - book.words[j]) ** 2).sum(-1) for j in range(m)], axis=1)
    along = np.stack([(parts[:, j] * unit[:, j]).sum(-1)[:, None] - unit[:, j] @ book.words[j].T for j in range(m)], axis=1)
    codes = plain.argmin(-1)
    rows = np.arange(len(x))
    total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (plain[:, j] + (book.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(-1)
            total = rest + along[rows, j, codes[:, j]]
    return codes.astype(np.uint8)


def fit(x: np.ndarray, sub: int = 2, eta: float = 4.0, rounds: int = 8, seed: int = 0) -> Codebook:
    """Code words for the rows of x."""
    m = -(-x.shape[1] // sub)
    x = np.pad(x, ((0, 0), (0, m * sub - x.shape[1])))
    r = np.random.default_rng(seed)
    picks = r.integers(0, len(x), (m, WORDS))
    book = Codebook(np.stack([x[picks[j], j * sub : (j + 1) * sub] for j in range(m)]) + r.normal(0, 1e-4, (m, WORDS, sub)), eta)
    size = m * WORDS * sub
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for _ in range(rounds):
        codes = encode(book, x)
        # x is approximated by B c with c all words in a row; minimise (x - B c)' (I + (eta - 1) u u') (x - B c)
        at = ((np.arange(m) * WORDS + codes)[:, :, None] * sub + np.arange(sub)).reshape(len(x), -1)
        add = lambda w: np.bincount(at.ravel(), weights=w.ravel(), minlength=size)  # noqa: B023, E731
        right = add(x + (eta - 1) * (x * unit).sum(1, keepdims=True) * unit) + 1e-6 * book.words.ravel()
        count = np.bincount(at.ravel(), minlength=size) + 1e-6
        times = lambda z: count * z + (eta - 1) * add((unit * z[at]).sum(1, keepdims=True) * unit)  # noqa: B023, E731
        book = Codebook(solved(times, right, count + (eta - 1) * add(unit * unit), book.words.ravel()).reshape(m, WORDS, sub), eta)
    return book


def solved(times, right: np.ndarray, diagonal: np.ndarray, start: np.ndarray, most: int = 500, close: float = 1e-9) -> np.ndarray:
    """Conjugate gradients for a positive definite system that is known by its products, so memory grows with the unknowns and not with their square."""
    z = start.copy()
    left = right - times(z)
    step = left / diagonal
    way = step.copy()
    now = left @ step
    goal = close * np.linalg.norm(right)
    for _ in range(most):
        if np.linalg.norm(left) <= goal:
            break
        image = times(way)
        share = now / (way @ image)
        z += share * way
        left -= share * image
        step = left / diagonal
        before, now = now, left @ step
        way = step + now / before * way
    return z


def paired(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes in each byte: pairs x rows."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)


def tables(book: Codebook, q: np.ndarray) -> np.ndarray:
    """queries x pairs x 256: inner products with both words of a byte."""
    m, _, d = book.words.shape
    one = np.einsum("qmd,mwd->qmw", book.padded(q).reshape(len(q), m, d), book.words)
    if m % 2:
        one = np.pad(one, ((0, 0), (0, 1), (0, 0)))
    return (one[:, 1::2, :, None] + one[:, ::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last so that equal vectors get equal scores."""
    out = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for k in range(x.shape[-1]):
        out += q[..., k] * x[..., k]
    return out


def looked_up(book: Codebook, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """queries x rows: inner products of the queries with what the codes stand for."""
    lut = tables(book, q)
    rough = lut[:, 0].take(codes[0], axis=1)
    for j in range(1, len(codes)):
        rough += lut[:, j].take(codes[j], axis=1)
    return rough


def scan(book: Codebook, q: np.ndarray, codes: np.ndarray, keep: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, position of the row, approximate score) of the best `keep` rows for each query and all tied with the last. own: position of the query's own row, -1 if it is not here."""
    found: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))]
    for a in range(0, len(q), 64):
        for i, rough in enumerate(looked_up(book, q[a : a + 64], codes)):
            if own is not None and own[a + i] >= 0:
                rough[own[a + i]] = -np.inf
            best = _most(rough, keep)
            found.append((np.full(len(best), a + i), best, rough[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _most(rough: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the best `keep` and all tied with the last."""
    least = np.partition(rough, len(rough) - keep)[len(rough) - keep] if keep < len(rough) else np.float32(-np.inf)
    return np.flatnonzero((rough >= least) & (rough > -np.inf))  # equal codes are not equal vectors


def residuals(book: Codebook, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lengths of what the paired codes leave of the rows of x."""
    m, _, d = book.words.shape
    four = np.stack([codes & 15, codes >> 4], axis=1).reshape(-1, codes.shape[1])[:m].T
    out = np.zeros(len(x))
    for a in range(0, len(x), 4096):
        known = book.words[np.arange(m), four[a : a + 4096]].reshape(-1, m * d)
        out[a : a + 4096] = np.linalg.norm(book.padded(x[a : a + 4096]) - known, axis=1)
    return out


def nearest(book: Codebook, q: np.ndarray, codes: np.ndarray, x: np.ndarray, ids: np.ndarray, top: int, keep: int, own: np.ndarray, pair_rows: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, position of the row, score) of the `top` rows of largest inner product for each query, ties to the smaller id and then to the earlier row."""
    off = residuals(book, x, codes) * (1 + 1e-6)
    # looked up products are summed in single precision, the matrix product in another order than exact
    length, longest = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1).max(initial=0.0)
    found: list[tuple] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    with np.errstate(all="ignore"):
        for a in range(0, len(q), 64):
            some = q[a : a + 64]
            rough = looked_up(book, some, codes)
            here = np.flatnonzero(own[a : a + 64] >= 0)
            for i in range(len(some)):
                if own[a + i] >= 0:
                    rough[i, own[a + i]] = -np.inf
            first = [_most(r, keep) for r in rough]
            i, j = np.repeat(np.arange(len(some)), [len(f) for f in first]), np.concatenate(first)
            score = np.concatenate([exact(some[i[b : b + pair_rows]], x[j[b : b + pair_rows]]) for b in range(0, len(i), pair_rows)] or [np.zeros(0)])
            least = np.full(len(some), -np.inf)
            for r in range(len(some)):
                mine = score[i == r]
                if len(mine) >= top:
                    least[r] = np.partition(mine, len(mine) - top)[len(mine) - top]
            # of the rows that their codes don't rule out, a product leaves those that are not below the bound
            may = ~(rough + (length[a : a + 64, None] * (off + 2e-5 * longest)).astype(np.float32) * np.float32(1 + 1e-6) < least[:, None])
            may |= ~np.isfinite(rough)
            may &= ~(some @ x.T < (least - 1e-12 * length[a : a + 64] * longest)[:, None])
            may[here, own[a + here]] = False
            i, j = np.nonzero(may)
            score = np.concatenate([exact(some[i[b : b + pair_rows]], x[j[b : b + pair_rows]]) for b in range(0, len(i), pair_rows)] or [np.zeros(0)])
            by = np.lexsort((j, ids[j], -score, i))
            i, j, score = i[by], j[by], score[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            found.append((a + i[rank < top], j[rank < top], score[rank < top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, except for the length."""
    v = F.col(embedding)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def coded(rows: DataFrame, book: Codebook) -> DataFrame:
    """rows (row, vec_id, v) with code: two four-bit codes a byte."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                codes = paired(encode(book, _matrix(part["v"])))
                yield part.assign(code=[c.tobytes() for c in np.ascontiguousarray(codes.T)])

    some = rows.select("row", "vec_id", "v")
    return some.mapInPandas(run, f"row long, vec_id long, v {dict(some.dtypes)['v']}, code binary")


def search(df: DataFrame, top: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", rerank: int = 512, sub: int = 2, eta: float = 4.0, sample_rows: int = 6000, block_rows: int = 1 << 18, query_rows: int = 1 << 14, bucket_rows: int | None = None, pair_rows: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every`, the `top` rows of largest inner product other than the row itself."""
    spark = df.sparkSession
    fine = usable(df, vec_id, embedding)
    sizes = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = cut(fine.where(F.size("v") == sizes[0]["d"]).withColumn("row", F.monotonically_increasing_id()))
    count = sizes[0]["n"]
    drawn = rows.where(unit_hash("vec_id", "v", F.lit("ann")) < min(1.0, sample_rows / count)).select("vec_id", "v").distinct().collect()
    sample = np.array([r["v"] for r in sorted(drawn, key=lambda r: (r["vec_id"], r["v"]))] or [rows.first()["v"]], float)
    book = fit(sample, sub, eta)

    same = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).orderBy("vec_id", "row")
    held = cut(rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= top + 1).drop("__n"))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n_held, n_asked = held.count(), asked.count()
    # no larger blocks of rows than a task holds, and 16 of small tables, whatever the tasks: each passes on `top` rows a query. A block is copied for each block of queries
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(block_rows, bucket_rows or max(1, BUCKET_BYTES // (8 * book.dim)))
    blocks = max(1, -(-n_held // most), min(16, n_held // 64))
    askers = max(1, -(-n_asked // query_rows), min(tasks // blocks, n_asked // 512))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = cut(coded(held, book)).select("row", "vec_id", "v", "code", deal(blocks, 1).alias("block")).select("*", all_of(askers).alias("asker"))
    queries = asked.select("row", "vec_id", "v", deal(askers, 2).alias("asker")).select("*", all_of(blocks).alias("block"))

    def look(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return NONE
        held = held.sort_values("row")
        table = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), -1).T
        rows, ids = held["row"].to_numpy(), held["vec_id"].to_numpy()
        own = pd.Index(rows).get_indexer(asked["row"])
        i, j, score = nearest(book, _matrix(asked["v"]), np.ascontiguousarray(table), _matrix(held["v"]), ids, top, rerank, own, pair_rows)
        return pd.DataFrame({"q": asked["row"].to_numpy()[i], "query_id": asked["vec_id"].to_numpy()[i], "c": rows[j], "vec_id": ids[j], "score": score})

    found = queries.groupBy("block", "asker").cogroup(codes.groupBy("block", "asker")).applyInPandas(look, "q long, query_id long, c long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "c")
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranks.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


NONE = pd.DataFrame({"q": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
