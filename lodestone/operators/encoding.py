"""Embedding texts. An encoder is any object with `dimension` and `encode(list of texts) -> list of lists of floats`; the one built in hashes words and is a stand-in for a model, which the offline box lacks."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.postings import small_batches

WORD = re.compile(r"\w+")


class Encoder(Protocol):
    dimension: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class _Hashes(dict):
    """crc32 of words, each computed once while there is room."""

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        if len(self) < 1 << 18:
            self[word] = h
        return h


class HashingEncoder:
    """Words and pairs of words hashed to signed places, as a unit vector; the same text always gives the same vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.hashes = _Hashes()

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        hashes = self.hashes
        h = np.array([hashes[w] for w in WORD.findall(text.lower())], np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0x85EBCA77C2B2AE63)
        h = np.concatenate([h, pairs >> np.uint64(32)])
        v = np.bincount((h % np.uint64(self.dimension)).astype(np.int64), np.where(h >> np.uint64(16) & np.uint64(1), 1.0, -1.0), self.dimension)
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).tolist()


class RemoteEncoder:
    """An encoder behind a transport: send(texts) -> (status, vectors). Texts go in batches; a status from 500 on is tried again after 1, 2, 4, ... seconds, 401 and 429 (and what is left after the last try) end the job at once."""

    def __init__(self, send: Callable[[list[str]], tuple[int, list[list[float]]]], dimension: int, batch: int = 100, tries: int = 3, wait: Callable[[float], None] = time.sleep):
        self.send, self.dimension, self.batch, self.tries, self.wait = send, dimension, batch, tries, wait

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [v for a in range(0, len(texts), self.batch) for v in self._one(texts[a : a + self.batch])]

    def _one(self, texts: list[str]) -> list[list[float]]:
        for k in range(self.tries):
            status, vectors = self.send(texts)
            if status == 200:
                if [len(v) for v in vectors] != [self.dimension] * len(texts):
                    raise ValueError("the answer does not fit the texts")
                return vectors
            if status < 500 or k + 1 == self.tries:
                break
            self.wait(2.0**k)
        raise ConnectionError(f"the encoder answered with status {status}")


def embed(df: DataFrame, encoder: Encoder, text: str = "content", out: str = "embedding", batch: int = 32) -> DataFrame:
    """df with the embedding; a null or empty text gives null and an error text instead of a zero vector."""
    kept = [c for c in df.columns if c not in (out, "embedding_error")]
    base = df.select(*kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            good = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            vectors: list = [None] * len(texts)
            for a in range(0, len(good), batch):
                for i, v in zip(good[a : a + batch], encoder.encode([texts[i] for i in good[a : a + batch]]), strict=True):
                    vectors[i] = v
            yield pdf.assign(**{out: vectors, "embedding_error": [None if v is not None else "empty text" for v in vectors]})

    fields = ", ".join(f"`{c}` {t}" for c, t in base.dtypes)
    return small_batches(base).mapInPandas(run, f"{fields}, `{out}` array<double>, embedding_error string")


def provider(document_type: Column, table: dict[str, str], fallback: str) -> Column:
    """Which encoder a document goes to."""
    return F.coalesce(*[F.when(document_type == k, v) for k, v in table.items()], F.lit(fallback))
