"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is how many copies each of its documents should give; the whole part is given at
once, the rest is a probability. Pairs of documents then trade: what one gains in words the other loses, the direction
is drawn so that both keep their probability in expectation, and the trade ends when one of the two is decided. So a
source's words stay what they should be. The one document that is left at the end goes to the nearer side, and a few
others of its group are turned where that brings the source nearer to its target.

Trades run in a reduction tree: each group of a source's documents leaves at most one undecided, and the undecided of
`fan` groups meet in a group of the next level. Groups are dealt by a hash of the id and of the row's number among rows
of equal id, source and size, so a source, or an id, of any number of rows spreads over many tasks; draws come from the
same hashes, so reruns agree. Turning decided documents at the end trades the exact expectation of these few for a source
that comes nearer to its target.

Defined results: a null text has size 0; texts of any length are counted whole; documents of size 0 and sources whose
size is 0 take nothing; null is a source of its own (the last in order), and so is the empty string; repeated rows and
rows with a null id are rounded each by itself; trades of equal size and id go by the draw; empty tables give empty
tables; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, keyed, ranked, spread_join, unit_hash

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)


def word_count(text: str) -> Column:
    """Number of runs of characters other than space and 0x09 to 0x0D; null counts 0."""
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "[ \\t-\\r]+"), "")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sources (source, source_size) -> with target: shares of all sizes by weight, none above `most` times its size.

    Weights repeat in code point order of the sources, null last. Each round sets aside the sources that their limit
    stops and shares the rest anew, until no further one is stopped; a round is one aggregation.
    """
    order = sources.withColumn("last", F.col("source").isNull())
    placed = ranked(order, ["last", "source"], "place", partitions=min(64, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("long")
    placed = cut(placed.select("source", "source_size", w.alias("w")))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    stopped, level = -1, 0.0
    while True:
        # sources stop at this level of words a weight
        stop = F.col("source_size") * most < F.col("w") * F.lit(level)
        r = placed.agg(F.sum(F.when(stop, 1).otherwise(0)).alias("n"), F.sum(F.when(stop, F.col("source_size") * most).otherwise(0)).alias("held"), F.sum(F.when(stop, 0).otherwise(F.col("w"))).alias("w")).first()
        if (r["n"] or 0) == stopped or not r["w"]:
            break
        stopped, level = r["n"], (total - r["held"]) / r["w"]
    return placed.select("source", "source_size", F.least(F.col("source_size").cast("double") * most, F.col("w") * F.lit(level)).alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Trade in order until at most one probability is neither 0 nor 1; sum(p * size) stays as it is."""
    p = p.copy()
    held = -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        up, down = min((1 - p[held]) * a, p[j] * b), min(p[held] * a, (1 - p[j]) * b)
        if u[j] * (up + down) < down:  # the held one gains with a chance that keeps its expectation
            p[held], p[j] = (1.0 if up == (1 - p[held]) * a else p[held] + up / a), (0.0 if up == p[j] * b else p[j] - up / b)
        else:
            p[held], p[j] = (0.0 if down == p[held] * a else p[held] - down / a), (1.0 if down == (1 - p[j]) * b else p[j] + down / b)
        for k in (held, j):  # what rounding leaves over
            p[k] = 0.0 if p[k] < 1e-12 else 1.0 if p[k] > 1 - 1e-12 else p[k]
        held = next((k for k in (held, j) if 0 < p[k] < 1), -1)
    return p


def settled_near(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """p without its last open entry, which goes to the nearer side; then single entries are turned while that brings sum(p * size) nearer to what it was."""
    goal, p = float(p @ size), p.copy()
    one = (p > 0) & (p < 1)
    if not one.any():
        return p
    p[one] = np.rint(p[one])
    while True:  # each turn lessens the distance
        over = float(p @ size) - goal
        fit = np.where((p == (1 if over > 0 else 0)) & (size > 0), np.abs(np.abs(over) - size), np.inf)
        k = int(fit.argmin())
        if not fit[k] < abs(over) - 1e-9:
            break
        p[k] = 1 - p[k]
    return p


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7, group_rows: int = 4096, fan: int = 64) -> DataFrame:
    """(doc_id, dup, source, size, source_size, target, copies, taken) for each row; dup numbers rows of equal id, source and size from 0."""
    base = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"))
    base = cut(base.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))
    again = base.groupBy("doc_id", "s", "size").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    dup = F.row_number().over(Window.partitionBy("doc_id", "s", "size").orderBy("s")) - 1 if again else F.lit(0)
    sums = base.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sums = cut(sums)
    shares = targets(sums.select("source", "source_size"), weights, most)
    named = shares.withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).select("s", "target")
    rows = spread_join(base.withColumn("dup", dup), keyed(sums.drop("source").join(named, "s")), "s").withColumnRenamed("n", "__n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    groups = F.ceil(F.col("__n") / group_rows)
    rows = rows.select(
        F.col("doc_id").cast("string").alias("doc_id"), "dup", "source", "size", "source_size", "target", whole.alias("whole"),  # as text, since pandas has no long that may be null
        F.when(F.col("size") > 0, rate - whole).otherwise(0.0).alias("p"),
        unit_hash("doc_id", "dup", F.lit(seed)).alias("u"),
        F.pmod(F.xxhash64("doc_id", "dup", F.lit(seed + 1)), groups).alias("group"),
        groups.alias("groups"),
    )
    done, left = None, rows.withColumn("level", F.lit(0))
    level = 0
    widest = sums.agg(F.max("n")).first()[0] or 0
    width = -(-widest // group_rows)
    schema = left.schema

    def trade(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "dup"], ascending=False, kind="stable")  # so that a short one is left
        p = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy(float), pdf["u"].to_numpy())
        if pdf["groups"].iloc[0] <= 1:  # the last open one is settled
            p = settled_near(p, pdf["size"].to_numpy(float))
        pdf["p"] = p
        return pdf

    while True:
        now = cut(left.groupBy("source", "group").applyInPandas(trade, schema))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled = now.where(~open_)
        done = settled if done is None else done.unionByName(settled)
        if width <= 1:
            break
        level, width = level + 1, -(-width // fan)
        left = now.where(open_).select(
            "doc_id", "dup", "source", "size", "source_size", "target", "whole", "p",
            unit_hash("doc_id", "dup", F.lit(seed), F.lit(level)).alias("u"),
            F.floor(F.col("group") / fan).alias("group"), F.ceil(F.col("groups") / fan).alias("groups"), F.lit(level).alias("level"),
        )
    copies = (F.col("whole") + F.col("p").cast("long")).cast("long")
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), "dup", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
