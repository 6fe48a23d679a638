"""Scores of (query, text) pairs by a model that each task loads once.

A scorer is an object that pickles: `load()` returns a function from two lists of texts to a list of logits. Pairs are
scored in batches of about equal length, so that a model that pads wastes little. A batch that fails is halved until the
pairs that fail stand alone; these get 0.5, as does a logit that is null or no number. So a score doesn't depend on which
pairs share a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEUTRAL = 0.5


class Scorer(Protocol):
    def load(self) -> Callable[[list[str], list[str]], list[float | None]]: ...


class WordShareScorer:
    """Stands in for a cross encoder: slope times the share of query words that the text holds, less a bias. Texts above `most` characters fail, as they do in a model with a bounded window."""

    def __init__(self, slope: float = 6.0, bias: float = 2.0, most: int | None = None):
        self.slope, self.bias, self.most = slope, bias, most

    def load(self) -> Callable[[list[str], list[str]], list[float | None]]:
        def logits(queries: list[str], texts: list[str]) -> list[float | None]:
            if self.most is not None and any(len(t) > self.most for t in texts):
                raise ValueError("a text is longer than the window")
            out = []
            for q, t in zip(queries, texts, strict=True):
                words = {w for w in q.lower().split(" ") if w}
                held = set(t.lower().split(" "))
                out.append(self.slope * len(words & held) / len(words) - self.bias if words else None)
            return out

        return logits


def _scored(model, queries: list[str], texts: list[str]) -> list[float | None]:
    try:
        found = model(queries, texts)
        if len(found) != len(texts):
            raise ValueError("the scorer gave another number of logits")
        return list(found)
    except Exception:  # whatever a model raises
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return _scored(model, queries[:half], texts[:half]) + _scored(model, queries[half:], texts[half:])


def model_score(scorer: Scorer, query: Column, text: Column, batch: int = 32, temperature: float = 1.0) -> Column:
    """The scorer's logit through a sigmoid, 0.5 where it failed or a text is null."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = scorer.load()
        for queries, texts in parts:
            out = [NEUTRAL] * len(texts)
            known = [i for i, (q, t) in enumerate(zip(queries, texts, strict=True)) if q is not None and t is not None]
            known.sort(key=lambda i: len(texts.iloc[i]))
            for a in range(0, len(known), batch):
                some = known[a : a + batch]
                for i, x in zip(some, _scored(model, [queries.iloc[i] for i in some], [texts.iloc[i] for i in some]), strict=True):
                    if x is not None and not math.isnan(x):
                        out[i] = 1 / (1 + math.exp(-max(min(x / temperature, 700.0), -700.0)))
            yield pd.Series(out)

    return score(query, text)


def rerank_by_model(hits: DataFrame, scorer: Scorer, top: int | None = None, batch: int = 32, temperature: float = 1.0, query: str = "query", text: str = "content") -> DataFrame:
    """hits (qid, id, rank, query, content, ...) with rerank_score and new_rank, best first, ties by old rank."""
    rows = hits.withColumn("rerank_score", model_score(scorer, F.col(query), F.col(text), batch, temperature))
    order = Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank")
    rows = rows.withColumn("new_rank", F.row_number().over(order))
    return rows if top is None else rows.where(F.col("new_rank") <= top)
