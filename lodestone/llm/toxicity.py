"""Toxicity by weak supervision.

Many weak voters look at a text: one for each entry of a lexicon (a short built-in list, and words and
beginnings of words that labelled toxic texts hold far more often than others), density voters, voters for halves of the lexicon being absent, and pattern
voters (shouting, exclamations, symbol runs, shortness). A generative label model treats the true label as hidden: each
voter says yes, no or nothing with chances that depend on it (its accuracy), voters that err together (their
correlations) share one voice, so that who repeats another does not count twice, and the given labels are one more,
fallible, voter. It is fitted by expectation
maximisation. A linear classifier is then trained on its posterior labels and scores every whole text.

Bound of the fit: labelled ids of smallest hash, about max_positive and max_negative of them and max_bytes of text
together; the label counts that set the prior are taken over all labelled ids. Of rows that share an id the one of
smallest text is learned from, and an id with both labels counts with each. Ids, labels, languages and sources are never
inputs of a score.

Defined results: a null or empty text is scored like a text without hits; texts of any length are scored whole; without
labelled rows every score is 0; ties (equal texts, repeated rows) get equal scores; empty tables give empty tables; other
columns of the input are not read by the fit and pass through the scoring, where one that is called like the score is
replaced by it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, pieces, small_batches, unit_hash

#: fixed values: mild words of insult, a starting lexicon
SEEDS = ("idiot", "moron", "stupid", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "dumb", "imbecile", "idiota", "imbécile", "dummkopf", "estúpido", "abschaum")

_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
_UPPER, _LETTER = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_NOT_UPPER, _NOT_LETTER = (bytes(b for b in range(256) if b not in s) for s in (_UPPER, _LETTER))


def words(raw: bytes) -> list[bytes]:
    """Lower-cased runs of letters; bytes outside ASCII count as letters."""
    return raw.translate(_KEEP).split()


@dataclass
class Model:
    #: whole words, then beginnings of words (ending in *)
    lexicon: list[bytes] = field(default_factory=list)
    #: weights of the features, then of the intercept
    weights: np.ndarray | None = None
    #: voters' names with their estimated mean votes on toxic and other texts
    accuracies: dict[str, tuple[float, float]] = field(default_factory=dict)
    correlations: np.ndarray | None = None

    def __post_init__(self):
        self.at = {w: k for k, w in enumerate(self.lexicon) if not w.endswith(b"*")}
        self.begins = {w[:-1]: k for k, w in enumerate(self.lexicon) if w.endswith(b"*")}
        self.lengths = sorted({len(w) for w in self.begins})

    def hits(self, found: list[bytes]) -> list[int]:
        """Lexicon entries met, a word at most once as itself and once by a beginning."""
        at, begins = self.at, self.begins
        out = [at[w] for w in found if w in at]
        seen = set()
        for n in self.lengths:
            for w in found:
                if len(w) > n and w[:n] in begins and w not in seen:
                    out.append(begins[w[:n]])
                    seen.add(w)
        return out


def features(model: Model, texts: list[bytes]) -> np.ndarray:
    """A row for each text: presence of each lexicon word, then log hits, log distinct, hits per 100 words, share of capitals, exclamations per 100 words, symbol runs per 100 words, few words."""
    v = len(model.lexicon)
    out = np.zeros((len(texts), v + 7))
    for i, raw in enumerate(texts):
        found = words(raw)
        hits = model.hits(found)
        n = max(len(found), 1)
        row = out[i]
        if hits:
            row[hits] = 1
            row[v : v + 3] = np.log1p(len(hits)), np.log1p(len(set(hits))), min(100 * len(hits) / n, 20)
        capitals, letters = len(raw.translate(None, _NOT_UPPER)), len(raw.translate(None, _NOT_LETTER))
        row[v + 3 :] = capitals / max(letters, 1), min(100 * raw.count(b"!") / n, 20), min(100 * (raw.count(b"###") + raw.count(b"$$$") + raw.count(b"***")) / n, 20), len(found) < 20
    return out


def ballots(x: np.ndarray, v: int) -> tuple[np.ndarray, list[str]]:
    """Votes in {-1, 0, 1} (0: abstains) of all voters on feature rows."""
    lex, hits, distinct, density = x[:, :v], x[:, v], x[:, v + 1], x[:, v + 2]
    votes = [*lex.T]
    names = [f"word {k}" for k in range(v)]
    for name, yes, no in (
        ("two words", distinct >= np.log1p(2), None),
        ("three hits", hits >= np.log1p(3), None),
        ("dense", density >= 0.5, None),
        ("very dense", density >= 2, None),
        ("no even word", None, lex[:, ::2].sum(1) == 0),
        ("no odd word", None, lex[:, 1::2].sum(1) == 0),
        ("no hit", None, hits == 0),
        ("shouting", x[:, v + 3] > 0.4, x[:, v + 3] < 0.01),
        ("exclaiming", x[:, v + 4] > 3, None),
        ("symbols", x[:, v + 5] > 3, None),
        ("short", x[:, v + 6] > 0, None),
    ):
        vote = np.zeros(len(x))
        if yes is not None:
            vote[yes] = 1
        if no is not None:
            vote[no] = -1
        votes.append(vote)
        names.append(name)
    return np.stack(votes, axis=1), names


def label_model(votes: np.ndarray, given: np.ndarray, weight: np.ndarray, rounds: int = 25, smooth: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label for each row, voters' mean votes on either class, their correlations within a class.

    given: labels 0/1 (a further voter that errs); weight: how many rows of the population a row stands for.
    """
    weight = weight / weight.mean()
    kinds = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    post = np.where(given == 1, 0.9, 0.02)
    corr = np.eye(votes.shape[1])
    for k in range(rounds):
        w1, w0 = weight * post, weight * (1 - post)
        p1, p0 = ((w @ kinds + smooth) / (w.sum() + 3 * smooth) for w in (w1, w0))
        m1, m0 = p1[2] - p1[0], p0[2] - p0[0]
        if k == 0:  # voters who err together, judged by the given labels; later rounds would explain it away
            r = votes - np.where(given[:, None] == 1, m1, m0)
            cov = (r * weight[:, None]).T @ r / weight.sum()
            s = np.sqrt(np.diag(cov)) + 1e-9
            corr = cov / np.outer(s, s)
            np.fill_diagonal(corr, 1.0)
            share = 1 / np.clip(corr, 0, 1).sum(axis=1)  # alike voters share one voice
        said = np.einsum("kij,kj->ij", kinds, np.log(p1) - np.log(p0))
        hit, false = np.clip(w1 @ given / w1.sum(), 0.05, 0.995), np.clip(w0 @ given / w0.sum(), 0.001, 0.5)
        told = np.where(given == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        prior = np.clip(w1.sum() / weight.sum(), 1e-4, 1 - 1e-4)
        fresh = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + said @ share + told, -30, 30)))
        moved, post = np.abs(fresh - post).max(), np.clip(fresh, 1e-6, 1 - 1e-6)
        if moved < 1e-4:
            break
    return post, m1, m0, corr


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear classifier for soft labels by damped Newton steps; the last is the intercept, which has no penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-6
    weight = weight / weight.mean()

    def loss(b):
        z = np.clip(x @ b, -30, 30)
        return float(weight @ (np.log1p(np.exp(z)) - target * z) + 0.5 * penalty @ b**2)

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - target)) + penalty * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-4 and (fresh := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - fresh < 1e-7 * abs(now):
            break
        beta, now = beta - size * step, fresh
    return beta


def _originals(texts: list[bytes]) -> list[int]:
    """Positions of texts of which no earlier one is a copy or near copy: none of three least hashes of word triples agrees."""
    seen: set = set()
    out = []
    for i, t in enumerate(texts):
        w = words(t)
        grams = np.array([zlib.crc32(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], np.uint64)
        keys = {(k, int((grams * np.uint64(m) % np.uint64(4294967291)).min())) for k, m in enumerate((1, 2654435761, 40503 * 65537))}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def lexicon(texts: list[bytes], given: np.ndarray, most: int, least_z: float) -> list[bytes]:
    """Words, and true beginnings of longer words of 4 to 8 characters (marked *), that toxic texts hold far more often than others."""
    first = _originals(texts)
    n1, n0 = int((given[first] == 1).sum()), int((given[first] == 0).sum())
    if not n1 or not n0:
        return []

    def entries(i: int) -> set[bytes]:
        own = set(words(texts[i]))
        return own | {u[:k].encode() + b"*" for w in own for u in [w.decode("utf-8", "ignore")] for k in range(4, min(9, len(u)))}

    where: dict[bytes, set[int]] = {}
    for i in first:
        if given[i] == 1:
            for w in entries(i):
                where.setdefault(w, set()).add(i)
    where = {w: v for w, v in where.items() if len(v) >= max(4, 0.02 * n1)}
    df0: Counter = Counter()
    for i in first:
        if given[i] == 0:
            df0.update(w for w in entries(i) if w in where)
    scored = []
    for w, v in where.items():
        a, b = len(v), df0.get(w, 0)
        p1, p0, p = a / n1, b / n0, (a + b) / (n1 + n0)
        z = (p1 - p0) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        if len(w) >= 3 and z >= least_z and p1 >= 10 * p0:
            scored.append((-round(z, 6), w.endswith(b"*"), -len(w), w))
    out: list[bytes] = []
    for *_, w in sorted(scored):
        # a beginning that stands for the same words as one already taken is no further voter
        if not any((x.rstrip(b"*").startswith(w.rstrip(b"*")) or w.rstrip(b"*").startswith(x.rstrip(b"*"))) and 10 * len(where[w] & where[x]) > 9 * len(where[w] | where[x]) for x in out):
            out.append(w)
        if len(out) == most:
            break
    return out


def learn(texts: list[bytes], given: np.ndarray, weight: np.ndarray, most_words: int = 64, least_z: float = 4.5) -> Model:
    if not len(texts) or given.min() == given.max():
        return Model()
    learned = lexicon(texts, given, most_words, least_z)
    model = Model(learned + [s.encode() for s in SEEDS if s.encode() not in learned])
    x = features(model, texts)
    votes, names = ballots(x, len(model.lexicon))
    post, m1, m0, corr = label_model(votes, given, weight)
    model.accuracies = {n: (float(a), float(b)) for n, a, b in zip(names, m1, m0, strict=True)}
    model.correlations = corr
    model.weights = logistic(x, post, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_positive: int = 4000, max_negative: int = 8000, max_bytes: int = 48_000_000) -> Model:
    """docs (key, text) and labels (key, label 0 or 1; other values and nulls are left out).

    Only ids, labels and sizes meet in the join; the texts of the sample are then picked out of docs by its bounded list of ids.
    """
    sized = docs.groupBy(F.col(key).alias("k")).agg(F.max(F.coalesce(F.octet_length(text), F.lit(0))).alias("b"))
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and k is not null").distinct().join(sized, "k")
    rows = cut(rows.withColumn("u", unit_hash(F.col("k").cast("string"), F.lit("toxicity"))))
    sums = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum("b").alias("b")).collect()}
    if len(sums) < 2:
        return Model()
    share = {y: min(1.0, most / sums[y]["n"], max_bytes / 2 / max(1, sums[y]["b"])) for y, most in ((1, max_positive), (0, max_negative))}
    taken = rows.where(F.when(F.col("y") == 1, F.col("u") < share[1]).otherwise(F.col("u") < share[0])).select("k", "y", "u")
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    ids = F.broadcast(taken.select("k").distinct())  # about max_positive + max_negative
    found = texts.join(ids, "k").groupBy("k").agg(F.min("t").alias("t")).join(taken, "k").select("t", "y", "u").toArrow()
    if not found.num_rows:
        return Model()
    found = found.take(pc.sort_indices(found, [("u", "ascending"), ("t", "ascending"), ("y", "ascending")]))
    given = found.column("y").to_numpy().astype(float)
    have = {y: max(1, int((given == y).sum())) for y in (0, 1)}
    weight = np.where(given == 1, sums[1]["n"] / have[1], sums[0]["n"] / have[0])
    return learn([bytes(t) for t in found.column("t").to_pylist()], given, weight)


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    if model.weights is None:
        return np.zeros(len(texts))
    x = features(model, texts)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -700, 700)))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all, if None) with the probability of being toxic in column out (which replaces one of that name)."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most most_words and the seeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", 4 << 20):
                raw = [x or b"" for x in part.column(len(kept)).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(probabilities(shared.value, raw))], names=[*kept, out])

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes[:-1])
    return small_batches(base).mapInArrow(run, ", ".join(filter(None, [fields, f"`{out}` double"])))
