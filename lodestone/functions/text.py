"""Cleaning and normalising text columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: characters that cleaning removes
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]"

#: fixed values: wrongly decoded sequences and what they stand for; longer ones go first
MOJIBAKE = {
    "â€™": "'", "â€œ": '"', 'â€"': "–", "â€": '"',
    "Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú",
    "Ã ": "à", "Ã¨": "è", "Ã¬": "ì", "Ã²": "ò", "Ã¹": "ù",
}

#: least length and whether copies go, by type of collection
CLEANING = {"general": (10, True), "fundamental": (20, True), "project-specific": (10, False), "temporary": (5, True)}


def _c(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no builtin for it."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def strip_control(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), CONTROL, "")


def fix_mojibake(text: Column | str) -> Column:
    out = _c(text)
    for bad in sorted(MOJIBAKE, key=len, reverse=True):
        out = F.replace(out, F.lit(bad), F.lit(MOJIBAKE[bad]))
    return out


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), "\\s+", " "))


def cut_at_space(text: Column | str, most: int) -> Column:
    """At most so many characters, back to the last space."""
    c = _c(text)
    head = F.substring(c, 1, most)
    back = F.locate(" ", F.reverse(head))
    return F.when(F.length(c) <= most, c).otherwise(F.when(back > 0, F.substring(head, F.lit(1), F.length(head) - back)).otherwise(head))


def clean(text: Column | str, least: int = 10, most: int | None = None, unicode_form: bool = True) -> Column:
    """Control characters out, compatibility form, mojibake mended, white space collapsed; null if shorter than least, cut at a space beyond most."""
    out = strip_control(text)
    out = squeeze(fix_mojibake(nfkc(out) if unicode_form else out))
    if most is not None:
        out = cut_at_space(out, most)
    return F.when(F.length(out) >= least, out)


def keep_first(df: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """One row for each text (in lower case, trimmed): the one first in order. Texts meet by their digest; a hot digest is a window of its own, of which each task passes one row on."""
    order = Window.partitionBy(F.md5(F.lower(F.trim(text)))).orderBy(by)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def snake_case(name: Column | str) -> Column:
    out = F.lower(F.regexp_replace(_c(name), "([A-Z])", "_$1"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9_]", "_"), "_+", "_"), "^_+|_+$", "")


def sanitise_comment(text: Column | str) -> Column:
    """Tags out; beyond 1000 characters cut and marked by dots."""
    plain = F.regexp_replace(_c(text), "<[^>]+>", "")
    return F.trim(F.when(F.length(plain) > 1000, F.concat(F.substring(plain, 1, 1000), F.lit("..."))).otherwise(plain))


def document_key(source: Column | str, content: Column | str) -> Column:
    return F.concat(_c(source), F.lit("_"), F.substring(F.md5(_c(content)), 1, 8))


def bounded_text(c: Column | str, most: int) -> Column:
    return F.substring(F.trim(_c(c)), 1, most)


def bounded_int(c: Column | str, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(_c(c).try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def one_of(c: Column | str, values: list[str], default: str) -> Column:
    low = F.lower(F.trim(_c(c)))
    return F.when(low.isin(values), low).otherwise(default)


def request_problem(query: Column | str, name: Column | str, top_k: Column | str) -> Column:
    """What is wrong with a request: query length 2 to 10000, names of letters, digits, _ and -, no reserved name, top_k 1 to 100, not mostly punctuation; null if nothing."""
    q, n, k = F.trim(_c(query)), _c(name), _c(top_k)
    punctuation = F.length(F.regexp_replace(q, "[\\w\\s]", ""))
    return (
        F.when(q.isNull() | (F.length(q) < 2), "query too short")
        .when(F.length(q) > 10000, "query too long")
        .when(punctuation > F.length(q) * 0.5, "query is mostly punctuation")
        .when(n.isNotNull() & ~n.rlike("^[a-zA-Z0-9_-]+$"), "bad collection name")
        .when(F.lower(n).isin("admin", "system", "root", "default", "null", "undefined"), "reserved collection name")
        .when(k.isNotNull() & ~k.between(1, 100), "top_k out of range")
    )
