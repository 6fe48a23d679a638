"""Ranges: overlaps merged into islands, and what lies inside what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_overlapping(df: DataFrame, by: list[str], low: str, high: str, tie: str) -> DataFrame:
    """(by, low, high, n): ranges of a group that overlap or touch, as one."""
    order = Window.partitionBy(*by).orderBy(low, tie)
    r = df.withColumn("__top", F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("__top").isNull() | (F.col(low) > F.col("__top"))
    r = r.withColumn("__island", F.sum(new.cast("int")).over(order))
    return r.groupBy(*by, "__island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("__island")


def contained(inner: DataFrame, outer: DataFrame, by: str) -> DataFrame:
    """inner (by, start, end, ...) joined to the smallest outer range (by, outer_id, outer_start, outer_end) that holds it; of equally long ones the smallest outer_id. Ranges that nothing holds go.

    A range of outer lies in bins as wide as the least power of two that isn't below its length, so in two at most. A
    range of inner looks into the one bin of each width that its group has, around its start. So it meets only ranges
    about as far away as they are long, whatever the size of the group, and both sides are joined on equal keys.
    """
    c = F.col
    width = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))
    placed = outer.where("outer_start is not null and outer_end >= outer_start").select(by, "outer_id", "outer_start", "outer_end", width(c("outer_end") - c("outer_start")).alias("__w"))
    widths = placed.groupBy(by).agg(F.collect_set("__w").alias("__ws"))  # at most 64 of them
    bins = placed.withColumn("__bin", F.explode(F.sequence(F.floor(c("outer_start") / c("__w")), F.floor(c("outer_end") / c("__w")))))
    ranges = inner.select(by, "start", "end").distinct()
    asked = ranges.join(widths, by).select(by, "start", "end", F.explode("__ws").alias("__w")).withColumn("__bin", F.floor(c("start") / c("__w")))
    met = asked.join(bins, [by, "__w", "__bin"]).where((c("start") >= c("outer_start")) & (c("end") <= c("outer_end")))
    best = F.min(F.struct((c("outer_end") - c("outer_start")).alias("size"), "outer_id", "outer_start", "outer_end")).alias("__o")
    found = met.groupBy(by, "start", "end").agg(best).select(by, "start", "end", "__o.outer_id", "__o.outer_start", "__o.outer_end")
    return inner.join(found, [by, "start", "end"]).select(*inner.columns, "outer_id", "outer_start", "outer_end")


def overlapping(left: DataFrame, right: DataFrame, by: str, width: int) -> DataFrame:
    """Pairs of half-open ranges (by, id, start, end) x (by, other_id, other_start, other_end) that overlap. Both are cut into bins of `width`, and a pair is given in the bin where the later one starts, so once. width: about as long as most ranges."""
    c = F.col
    cut = lambda df, a, b: df.where(c(a) < c(b)).withColumn("__bin", F.explode(F.sequence(F.floor(c(a) / width), F.floor(c(b) / width))))
    both = cut(left, "start", "end").join(cut(right, "other_start", "other_end"), [by, "__bin"])
    met = (c("start") < c("other_end")) & (c("end") > c("other_start")) & (c("__bin") == F.floor(F.greatest("start", "other_start") / width))
    return both.where(met).drop("__bin")
