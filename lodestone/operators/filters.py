"""Filters from plain data: a store filter language, typed filter lists and dotted paths, compiled to columns. A missing field or a wrong type is false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(name: str, metadata: str | None = None) -> Column:
    """A column, or a dotted path inside a JSON column of metadata."""
    return F.get_json_object(metadata, f"$.{name}") if metadata else F.col(name)


def _is_text(v) -> bool:
    return isinstance(v, str)


def compare(c: Column, op: str, value) -> Column:
    """One comparison. Text equals text in any case; texts order as timestamps if both are, else as text; other values as numbers."""
    if op in ("eq", "equals"):
        out = F.lower(c.cast("string")) == value.lower() if _is_text(value) else c.try_cast("double") == float(value) if isinstance(value, int | float) and not isinstance(value, bool) else c == value
    elif op in ("gt", "greater_than", "gte", "lt", "less_than", "lte"):
        sign = {"greater_than": "gt", "less_than": "lt"}.get(op, op)
        cmp = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[sign]
        if _is_text(value):
            text = c.cast("string")
            when = lambda x: F.try_to_timestamp(x)
            out = F.coalesce(cmp(when(text), when(F.lit(value))), cmp(text, F.lit(value)))
        else:
            out = cmp(c.try_cast("double"), F.lit(float(value)))
    elif op == "in":
        out = c.isin(list(value))
    elif op == "between":
        out = compare(c, "gte", value[0]) & compare(c, "lte", value[1])
    elif op == "contains":
        out = F.contains(F.lower(c.cast("string")), F.lit(str(value).lower()))
    elif op == "contains_any":
        out = reduce(lambda a, b: a | b, [compare(c, "contains", v) for v in value], F.lit(False))
    elif op == "list_contains":
        out = F.array_contains(c, value)
    else:
        raise ValueError(f"unknown operator: {op}")
    return F.coalesce(out, F.lit(False))


def conjunction(filters: list[tuple[str, str, object]], logic: str = "and", metadata: str | None = None) -> Column:
    """(field, op, value) filters joined by and / or; no filter is true."""
    if not filters:
        return F.lit(True)
    parts = [compare(field(f, metadata), op, v) for f, op, v in filters]
    return reduce((lambda a, b: a & b) if logic.lower() == "and" else (lambda a, b: a | b), parts)


def store_filter(where: dict, metadata: str | None = None) -> Column:
    """The nested store language: {field: value}, {field: {$op: value}}, $and, $or. Several operators on a field are all needed."""
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [store_filter(w, metadata) for w in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner, F.lit(key == "$and")))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator: {key}")
        elif isinstance(value, dict):
            parts += [field(key, metadata).isNotNull() & ~compare(field(key, metadata), "eq", v) if op == "$ne" else compare(field(key, metadata), op.removeprefix("$"), v) for op, v in value.items()]
        else:
            parts.append(compare(field(key, metadata), "eq", value))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tags_match(tags: Column | str, wanted: list[str], every: bool = False) -> Column:
    """Any or all of the tags; an empty wish matches nothing."""
    if not wanted:
        return F.lit(False)
    given = F.array(*[F.lit(t) for t in wanted])
    return F.coalesce(F.size(F.array_except(given, tags)) == 0 if every else F.arrays_overlap(tags, given), F.lit(False))


def has_keys(metadata: str, keys: list[str]) -> Column:
    """All dotted keys are there and not null."""
    return reduce(lambda a, b: a & b, [F.get_json_object(metadata, f"$.{k}").isNotNull() for k in keys], F.lit(True))


def overlaps(start: Column, end: Column, low: int, high: int) -> Column:
    """Half-open ranges."""
    if low >= high:
        raise ValueError("start must be below end")
    return (start < high) & (end > low)
