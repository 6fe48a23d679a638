"""Projects and their links to collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_problem(name: Column, description: Column | None = None) -> Column:
    long = F.lit(False) if description is None else F.coalesce(F.length(description) > 1000, F.lit(False))
    return F.when(name.isNull() | (F.trim(name) == ""), "no name").when(F.length(name) > 100, "name too long").when(name.rlike('[<>:"/\\\\|?*]'), "bad sign in name").when(long, "description too long")


def overview(projects: DataFrame, links: DataFrame, collections: DataFrame) -> DataFrame:
    """projects (project), links (project, collection), collections (collection, n_documents) -> linked collections that exist and their documents."""
    j = links.join(collections, "collection").groupBy("project").agg(F.count("*").alias("n_collections"), F.coalesce(F.sum("n_documents"), F.lit(0)).alias("n_documents"))
    return projects.join(j, "project", "left").na.fill(0, ["n_collections", "n_documents"])


def link(links: DataFrame, new: DataFrame, collections: DataFrame) -> DataFrame:
    """links with the new ones whose collection exists and that are not there yet."""
    fine = new.join(collections.select("collection"), "collection", "left_semi").join(links, ["project", "collection"], "left_anti")
    return links.unionByName(fine.select("project", "collection").distinct())


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, ["project", "collection"], "left_anti")


def with_defaults(defaults: Column, wanted: Column, linked: Column, append: bool = False) -> Column:
    """New defaults: a subset of the linked collections, else unchanged; append adds to the old ones."""
    new = F.array_union(defaults, wanted) if append else F.array_distinct(wanted)
    return F.when(F.size(F.array_except(wanted, linked)) == 0, new).otherwise(defaults)


def resolved_collections(explicit: Column, defaults: Column) -> Column:
    return F.coalesce(explicit, defaults, F.array().cast("array<string>"))


def project_of(paths: DataFrame, roots: DataFrame, id: str, path: str) -> DataFrame:
    """paths (id, path), roots (project, root) -> the project of the longest root that the path begins with; of equal roots the smallest project, null where none fits.

    A path is cut at the lengths that roots have (a handful, however many roots there are), and its beginnings are joined
    to the roots on equality. A null root fits nothing, an empty one everything.
    """
    c = F.col
    known = roots.where("root is not null").groupBy("root").agg(F.min("project").alias("project"))
    lengths = known.agg(F.sort_array(F.collect_set(F.length("root"))).alias("x")).scalar()
    fit = F.filter("__lengths", lambda n: n <= F.length(path))
    begins = paths.select(id, path, lengths.alias("__lengths")).withColumn("root", F.explode(F.transform(fit, lambda n: F.substring(path, F.lit(1), n))))
    best = begins.join(known, "root").groupBy(id).agg(F.max(F.struct(F.length("root").alias("n"), "project")).alias("b"))
    return paths.select(id).join(best.select(id, c("b.project").alias("project")), id, "left")


def with_current(projects: DataFrame, name: Column | str | None) -> DataFrame:
    """projects with is_current: true for the named one only, for none if there is no such project."""
    wanted = name if isinstance(name, Column) else F.lit(name)
    return projects.withColumn("is_current", F.coalesce(F.col("project").cast("string") == wanted.cast("string"), F.lit(False)))
