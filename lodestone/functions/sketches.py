"""Quantiles of groups by mergeable sketches: each task sketches what it has of a group, and sketches are merged, so no group is in one task and nothing is sorted.

The sketches are KLL ones. With the default size of 2,048 the rank of an answer differs from the one asked for by at most
RANK_ERROR of the group's rows, with a chance of over 99 %; groups of fewer rows than the size are exact. Sketches can be
kept as a column and merged later, as for the days of a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 2048
#: of the group's rows, for SIZE
RANK_ERROR = 0.0025


def sketched(df: DataFrame, by: list[str], value: Column | str, size: int = SIZE, out: str = "sketch") -> DataFrame:
    """(by, out): a sketch a group. Nulls and NaN are left out; a group without other values has a null."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(x), x).alias("__x"))
    return rows.groupBy(*by).agg(F.when(F.count("__x") > 0, F.kll_sketch_agg_double("__x", F.lit(size))).alias(out))


def merged(sketches: DataFrame, by: list[str], sketch: str = "sketch") -> DataFrame:
    """Sketches of finer groups as one of each coarser group."""
    return sketches.where(F.col(sketch).isNotNull()).groupBy(*by).agg(F.kll_merge_agg_double(sketch).alias(sketch))


def quantile(sketch: Column | str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def rank(sketch: Column | str, value: Column) -> Column:
    """The share of the group's rows that are not above the value."""
    return F.kll_sketch_get_rank_double(sketch, value)


def count(sketch: Column | str) -> Column:
    return F.kll_sketch_get_n_double(sketch)
