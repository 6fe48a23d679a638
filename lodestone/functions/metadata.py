"""Metadata held as a map of texts, or as JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import snake_case


def clean_map(metadata: Column | str, as_of: Column) -> Column:
    """A map of texts with snake-case keys (the first of equal ones stays), squeezed values, and by the key's ending: missing or bad times become as_of, sizes and sequence numbers whole numbers or 0, other missing values empty."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    now = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")

    def value(k: Column, v: Column) -> Column:
        v = F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), "\\s+", " "))
        return F.when(k.endswith("_at"), F.when(F.try_to_timestamp(v).isNotNull(), v).otherwise(now)).when(k.isin("chunk_sequence_id", "chunk_size"), F.coalesce(v.try_cast("int"), F.lit(0)).cast("string")).otherwise(v)

    named = F.transform(F.map_entries(m), lambda e: F.struct(snake_case(e["key"]).alias("key"), e["value"].alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")
    once = F.aggregate(named, empty, lambda a, e: F.when(F.exists(a, lambda x: x["key"] == e["key"]), a).otherwise(F.concat(a, F.array(e))))
    return F.map_from_entries(F.transform(once, lambda e: F.struct(e["key"].alias("key"), value(e["key"], e["value"]).alias("value"))))


def to_store(tags: Column, created: Column, kind: Column, kinds: list[str]) -> Column:
    """A struct of plain values: lists as texts joined by commas, null if empty; unknown kinds; times in ISO form."""
    return F.struct(F.nullif(F.array_join(tags, ","), F.lit("")).alias("tags"), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.when(kind.isin(kinds), kind).otherwise("unknown").alias("kind"))


def from_store(stored: Column, as_of: Column) -> Column:
    """The struct of to_store as an array, a time (as_of if it is no time) and a kind."""
    tags = F.filter(F.split(F.coalesce(stored["tags"], F.lit("")), ","), lambda t: t != "")
    return F.struct(tags.alias("tags"), F.coalesce(F.try_to_timestamp(stored["created_at"]), as_of).alias("created_at"), F.coalesce(stored["kind"], F.lit("unknown")).alias("kind"))


def with_permissions(permissions: Column, user: Column, granted: Column) -> Column:
    """The map with the user's permissions set."""
    others = F.map_filter(F.coalesce(permissions, F.create_map().cast("map<string,array<string>>")), lambda k, v: k != user)
    return F.map_concat(others, F.map_from_arrays(F.array(user), F.array(granted)))


def deep_merge(*layers: dict) -> dict:
    """Settings by layers: later values win, nested mappings merge."""

    def two(a: dict, b: dict) -> dict:
        return a | {k: two(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return reduce(two, layers, {})


def merged_settings(low: Column, high: Column) -> Column:
    """Two layers of settings (maps of maps) as columns: later values win, inner maps merge."""
    empty = F.create_map().cast("map<string,string>")
    inner = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return F.map_zip_with(low, high, lambda k, a, b: inner(F.coalesce(a, empty), F.coalesce(b, empty)))
