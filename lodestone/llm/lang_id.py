"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed from left to right into the longest
phrases that the automaton holds; few phrases mean that the language explains the text well. A phrase points into a
reference of R symbols, so it costs log2(R) bits, and the language with the fewest bits a symbol wins.

Symbols are the bytes of lower-cased letters in UTF-8, with one symbol for a run of anything else, so every letter of
every script is told apart. The automata share one dense transition array, and all windows of a batch are parsed in step
for all languages. A window starts a new phrase, which adds at most one phrase a window and language; whole texts are
parsed.

Bound of the fit: the most_langs languages of most rows are learned; from each at most docs_per_lang labelled rows, those
of smallest hash that fit whole into total_bytes / languages bytes of UTF-8 together. Only where a language has no such row
its shortest one is cut, to about as many bytes. The automata have at most two states a byte. The bound is the same at every size; ids, sources and labels are never inputs of a
prediction.

Defined results: a null text, one without letters, or a model without languages gives `und` with score 0; ties go to
the smaller language name; very long texts are parsed whole, in windows; empty tables give empty tables; repeated rows
get their own results; other columns are not read, and the kept ones may have any name but those of the results
and __text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import pieces, small_batches, unit_hash, utf8

UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    #: byte -> symbol: 0 for what is no letter, 1.. for bytes met, the last for others
    symbols: np.ndarray
    #: state row offset + symbol -> next row offset << 2 | phrases that end here
    step: np.ndarray
    #: row offset of each language's start
    roots: np.ndarray
    #: bits a phrase costs
    bits: np.ndarray


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """code point -> its lower-case letter, or a space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def letters_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the lower-cased letters of all texts, with one space for a run of anything else, and the offsets of the texts in them."""
    try:
        text = raw.tobytes().decode()
    except UnicodeDecodeError:  # mended text by text, so that offsets stay right
        mended = [raw[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off, off[1:], strict=False)]
        raw, off = np.frombuffer(b"".join(mended), np.uint8), np.cumsum([0, *map(len, mended)])
        text = raw.tobytes().decode()
    points = lowered()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    begin = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])[off]  # where texts begin, in code points
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[begin[:-1][begin[:-1] < len(points)]] = True
    width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)) * keep
    at = np.concatenate([[0], np.cumsum(width)])[begin]
    return np.frombuffer(points[keep].tobytes().decode("utf-32-le").encode(), np.uint8), at


def symbols_of(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, and the offsets of the texts in them."""
    data, at = letters_of(raw, off)
    return table[data], at


def suffix_automaton(text: list[int], width: int) -> np.ndarray:
    """states x width, -1 where the text has no such continuation; state 0 is the empty string. At most two states a symbol, four bytes a transition."""
    none = array("i", [-1]) * width
    flat, link, length = array("i", none), array("i", [-1]), array("i", [0])
    last = 0
    for c in text:
        now = len(link)
        flat.extend(none)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and flat[p * width + c] == -1:
            flat[p * width + c] = now
            p = link[p]
        if p != -1:
            q = flat[p * width + c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(link)
                flat.extend(flat[q * width : (q + 1) * width])
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and flat[p * width + c] == q:
                    flat[p * width + c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return np.frombuffer(flat, np.int32).reshape(-1, width)


def build(texts: dict[str, list[str]]) -> Model:
    """A model from texts by language."""
    langs = sorted(texts)
    read = {lang: letters_of(*utf8(pa.array(texts[lang], pa.string())))[0] for lang in langs}
    met = sorted(set().union(*(np.unique(x).tolist() for x in read.values())) - {32}) if langs else []
    width = len(met) + 2
    table = np.full(256, width - 1, np.uint8)
    table[32], table[met] = 0, np.arange(1, width - 1)
    steps, roots, bits, base = [], [], [], 0
    for lang in langs:
        seq = table[read[lang]]
        rows = suffix_automaton(seq.tolist(), width)
        first = rows[0]
        # without a continuation: the phrase ends, and this symbol begins the next, or is one itself if unknown
        restart = np.where(first >= 0, (np.maximum(first, 0).astype(np.int64) * width + base) << 2 | 1, base << 2 | 2)
        step = np.where(rows >= 0, (np.maximum(rows, 0).astype(np.int64) * width + base) << 2, restart[None, :])
        step[0, first < 0] = base << 2 | 1
        steps.append(step.astype(np.int32).ravel())
        roots.append(base)
        bits.append(np.log2(max(2, len(seq))))
        base += rows.size
    return Model(langs, table, np.concatenate(steps) if steps else np.zeros(0, np.int32), np.array(roots, np.int32), np.array(bits))


def phrases(model: Model, sym: np.ndarray, off: np.ndarray, window: int = 2048) -> np.ndarray:
    """texts x languages: numbers of phrases."""
    size = np.diff(off)
    parts = -(-size // window)
    owner = np.repeat(np.arange(len(size)), parts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = off[:-1][owner] + k * window
    length = np.minimum(window, off[1:][owner] - start)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    state = np.tile(model.roots, (len(order), 1))
    count = np.zeros(state.shape, np.int32)
    live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for t, n in enumerate(live):
        v = model.step[state[:n] + sym[start[:n] + t][:, None]]
        count[:n] += v & 3
        state[:n] = v >> 2
    count += state != model.roots
    out = np.zeros((len(size), len(model.langs)), np.int64)
    np.add.at(out, owner[order], count)
    return out


def predict(model: Model, arr: pa.Array) -> tuple[list[str], np.ndarray]:
    raw, off = utf8(arr)
    sym, at = symbols_of(raw, off, model.symbols)
    n = np.diff(at)
    letters = np.concatenate([[0], np.cumsum(sym != 0)])
    known = letters[at[1:]] > letters[at[:-1]]
    if not model.langs:
        return [UNKNOWN] * len(n), np.zeros(len(n))
    cost = phrases(model, sym, at) * model.bits
    best = cost.argmin(axis=1)
    gap = (cost - cost.min(axis=1, keepdims=True)) / 8
    score = np.where(known, 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1), 0.0)
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 96, total_bytes: int = 200_000, most_langs: int = 500) -> Model:
    """train: rows to learn from; those with a null text or lang are left out."""
    rows = train.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    langs = [r["l"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_langs).collect()]
    if not langs:
        return build({})
    each = total_bytes // len(langs)
    n = F.octet_length("t")
    order = Window.partitionBy("l").orderBy(F.greatest(n, F.lit(each)), unit_hash(F.coalesce("k", F.lit("")), "t"), "t")
    known = F.broadcast(train.sparkSession.createDataFrame([(x,) for x in langs], "l string"))
    # docs_per_lang rows a language leave each task
    best = rows.join(known, "l").where(F.col("t").rlike("\\p{L}")).select("l", F.row_number().over(order).alias("r"), F.when(n <= each, F.col("t")).otherwise(F.substring("t", F.lit(1), F.floor(F.lit(each).cast("double") * F.length("t") / n).cast("int"))).alias("t")).where(F.col("r") <= docs_per_lang)
    texts = {}
    for r in sorted(best.collect(), key=lambda r: (r["l"], r["r"])):
        kept = texts.setdefault(r["l"], [])
        if not kept or sum(len(x.encode()) for x in kept) + len(r["t"].encode()) <= each:
            kept.append(r["t"])
    return build({k: [" ".join(v)] for k, v in texts.items()})


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score."""
    base = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by total_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", 8 << 20):
                lang, score = predict(shared.value, part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes if c != "__text")
    return small_batches(base).mapInArrow(run, f"{fields}, lang_pred string, score double")
