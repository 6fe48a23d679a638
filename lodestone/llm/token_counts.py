"""Token counts by heap-and-linked-list byte-pair merging: how many tokens a text has, without making their ids.

A text is cut at special tokens (in the raw text) and at ASCII white space, which the tokenizer drops. Each distinct run
between is normalised and cut into words by the tokenizer's own pattern, and a word's symbols (its bytes) are merged: a
linked list holds the symbols that are left, a heap the adjacent pairs with their ranks. The pair of lowest rank, of
equal ranks the leftmost, is popped again and again; pairs whose symbols have changed meanwhile are passed over. A
word's count is its symbols less its merges, so a word of n bytes takes O(n log n). Counts of short runs and words
are remembered in tables of bounded size, since a corpus repeats its words.

Works on each row alone: no shuffle, and memory for one text at a time beside the batch.

Defined results: null and empty texts and texts of white space have 0 tokens; texts of any length are counted whole;
repeated rows and null ids are rows of their own; special tokens in a text count one each, as the library counts them;
an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pieces, small_batches

#: longer runs and words are not remembered; a table is emptied when it holds so many
LONGEST_KEPT, MOST_KEPT = 64, 1 << 19
PLACE = (1 << 40) - 1


class Merger:
    """Symbols are numbers; word ends have symbols of their own where the tokenizer has a suffix for them."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str, alphabet: list[str]):
        """alphabet: the symbol of each byte."""
        number: dict[str, int] = {}

        def of(symbol: str) -> int:
            return number.setdefault(symbol, len(number))

        self.inner = [of(c) for c in alphabet]
        self.last = [of(c + suffix) for c in alphabet]
        #: rank of a pair of symbols (left << 32 | right), and the symbol that the pair of a rank makes
        self.ranks = {of(a) << 32 | of(b): rank for rank, (a, b) in enumerate(merges)}
        self.made = [of(a + b) for a, b in merges]

    def count(self, word: bytes) -> int:
        """Symbols of the word less its merges."""
        n = left = len(word)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank_of, made_by = self.ranks.get, self.made
        # an entry is rank << 40 | place, so the lowest rank comes first, and of equal ranks the leftmost pair
        heap = [r << 40 | i for i in range(n - 1) if (r := rank_of(symbol[i] << 32 | symbol[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 40, entry & PLACE
            j = after[i]
            # the pair may be gone: its left symbol merged away, or one of both is another by now
            if j < 0 or symbol[i] < 0 or rank_of(symbol[i] << 32 | symbol[j]) != rank:
                continue
            made = symbol[i] = made_by[rank]
            symbol[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(made << 32 | symbol[k])) is not None:
                    heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbol[h] << 32 | made)) is not None:
                heappush(heap, r << 40 | h)
        return left


class TokenCounter:
    """For a tokenizer file whose model is byte-level BPE and whose pattern drops white space."""

    def __init__(self, model_file: str):
        from tokenizers import Tokenizer

        with open(model_file, encoding="utf-8") as f:
            said = json.load(f)
        model, added = said["model"], said["added_tokens"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [a["content"] for a in added if a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a tokenizer this counts for: {model['type']} {odd}")
        whole = Tokenizer.from_file(model_file)
        self.normalise = whole.normalizer.normalize_str if whole.normalizer else str
        self.splitter = whole.pre_tokenizer
        if [w for w, _ in self.splitter.pre_tokenize_str("a  b")] != ["a", "b"]:
            raise ValueError("the tokenizer keeps white space")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        # visible bytes stand for themselves, the others for the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.bytes_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        alphabet = [c for c, _ in sorted(self.bytes_of.items(), key=lambda x: x[1])]
        self.merger = Merger(merges, model["end_of_word_suffix"] or "", alphabet)
        longest_first = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in longest_first)) if added else None
        self.runs: dict[bytes, int] = {}
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.merger.count(bytes(map(self.bytes_of.__getitem__, word)))
            remember(self.words, word, n)
        return n

    def run(self, run: bytes) -> int:
        """Tokens of a run without ASCII white space. Normalising a run alone is the same as in its text: nothing composes with a space."""
        n = self.runs.get(run)
        if n is None:
            normal = self.normalise(run.decode("utf-8", "replace"))
            n = sum(self.word(word) for word, _ in self.splitter.pre_tokenize_str(normal))
            remember(self.runs, run, n)
        return n

    def count(self, text: bytes) -> int:
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            for run, times in Counter(part.split()).items():
                total += times * self.run(run)
        return total


def remember(table: dict, key: bytes | str, n: int) -> None:
    if len(key) <= LONGEST_KEPT:
        if len(table) >= MOST_KEPT:
            table.clear()
        table[key] = n


@lru_cache(maxsize=2)
def counter(model_file: str) -> TokenCounter:
    return TokenCounter(model_file)


def count_tokens(df: DataFrame, model_file: str, text: str = "text", limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row."""
    base = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).count
        for batch in batches:
            for part in pieces(batch, "__text", 4 << 20):
                raw = [x or b"" for x in part.column(len(keep)).cast(pa.binary()).to_pylist()]
                n = list(map(count, raw))
                made = [pa.array(list(map(len, raw)), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    fields = "".join(f"`{c}` {t}, " for c, t in base.dtypes[: len(keep)])
    return small_batches(base).mapInArrow(run, fields + "n_bytes bigint, n_tokens bigint, over_limit boolean")
