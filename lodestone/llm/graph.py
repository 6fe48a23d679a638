"""Connected components by iterated joins, without one task or the driver ever holding an unbounded component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, discard, keyed, spread_join


class Forest:
    """Components of the positions 0..n-1; label: the smallest position of the component."""

    def __init__(self, n: int, same: np.ndarray | None = None):
        """same: values that rows of one known component share."""
        self.label = np.arange(n) if same is None else np.unique(same, return_index=True)[1][np.unique(same, return_inverse=True)[1]]
        self._jumps()

    def _jumps(self) -> None:
        self.same = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])]) if len(self.label) else np.zeros(0, int)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            go = x != y
            if not go.any():
                break
            a, b, x, y = a[go], b[go], x[go], y[go]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label
        self._jumps()

    def one(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Whether both ranges lie in one component."""
        s, label = self.same, self.label
        return (s[ahi - 1] == s[alo]) & (s[bhi - 1] == s[blo]) & (label[alo] == label[blo])


def _in_one_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = [b.to_numpy() for b in batches]
    if edges:
        nodes, at = np.unique(np.concatenate(edges), return_inverse=True)
        at = at.reshape(-1, 2)
        forest = Forest(len(nodes))
        forest.join(at[:, 0], at[:, 1])
        yield pd.DataFrame({"node": nodes, "component": nodes[forest.label]})


def components(edges: DataFrame, few: int = 1 << 20) -> DataFrame:
    """edges (a long, b long) -> (node, component: smallest node reachable), for nodes with an edge.

    Alternates two steps until nothing changes: each node sends its larger neighbours to its smallest one, then its
    smaller neighbours and itself. Smallest neighbours come from a partial aggregation; a node with over a thousandth of
    all edges is joined by broadcast (spread_join), so a star of any size spreads over all tasks. Each step's tables are
    deleted once the next ones are written. As soon as no more than `few` edges are left (16 MB), one task joins them,
    which gives the same result.
    """

    def finished(rows: DataFrame) -> DataFrame:
        out = cut(rows.coalesce(1).mapInPandas(_in_one_task, "node long, component long"))
        discard(rows)
        return out

    marks = {"rows": F.count("*"), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    big, small = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = cut(edges.where("a <> b").select(big, small), **marks)
    while (now.measured["rows"] or 0) > few:
        # larger neighbours go to the smallest of a node's neighbours and itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keyed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")).where("n > 0"))
        grown = spread_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        half = cut(grown.where("a <> b"))
        # smaller neighbours and the node itself go to the smallest neighbour
        lower = keyed(half.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        near = spread_join(half, lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = cut(near.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), **marks)
        same = fresh.measured == now.measured
        discard(now, least, half, lower)
        now = fresh
        if same:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return finished(now)
