"""Cutting documents into chunks: rows (keys, chunk_index, start, end, content, ...). Offsets count characters from 0, ends are exclusive."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lodestone.operators.postings import small_batches


def fixed_size(docs: DataFrame, size: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every `size` characters, inside the JVM."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(size)))
    rows = docs.select(F.col(id), F.col(text).alias("__t"), F.posexplode(starts).alias("chunk_index", "start"))
    content = F.substring("__t", F.col("start") + 1, F.lit(size))
    return rows.select(id, "chunk_index", "start", (F.col("start") + F.length(content)).alias("end"), content.alias("content"))


def _packed(parts: Column, size: int, glue: str, slack: int) -> Column:
    """Parts in order, joined by glue while their lengths (each with its slack) stay within size; an oversized part stands alone."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        full = (a["n"] + F.length(p) > size) & (a["now"] != "")
        done = F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        now = F.when(full | (a["now"] == ""), p).otherwise(F.concat(a["now"], F.lit(glue), p))
        n = F.when(full, F.length(p)).otherwise(a["n"] + F.length(p) + slack)
        return F.struct(done.alias("done"), now.alias("now"), n.alias("n"))

    return F.aggregate(parts, empty, step, lambda a: F.when(a["now"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["now"]))))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")


def _exploded(docs: DataFrame, id: str, chunks: Column) -> DataFrame:
    return docs.select(F.col(id), F.posexplode(chunks).alias("chunk_index", "content"))


def sentences(docs: DataFrame, size: int = 500, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences (ended by a point and a space) packed until size."""
    parts = F.split(text, "\\. ")
    ended = F.transform(parts, lambda p, i: F.when((i < F.size(parts) - 1) & (F.regexp_replace(p, "^\\s+|\\s+$", "") != "") & ~F.rtrim(p).endswith("."), F.concat(F.regexp_replace(p, "\\s+$", ""), F.lit("."))).otherwise(p))
    return _exploded(docs, id, _packed(_trimmed(ended), size, " ", 1))


def sections(docs: DataFrame, target: int = 1000, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Parts between blank lines packed to half the target; a text of one part has its sentences packed to a third."""
    parts = _trimmed(F.split(text, "\\n\\s*\\n"))
    lines = _trimmed(F.split(text, "(?<=\\.)\\s"))
    return _exploded(docs, id, F.when(F.size(parts) > 1, _packed(parts, target // 2, "\n\n", 2)).otherwise(_packed(lines, target // 3, " ", 1)))


def paragraphs(docs: DataFrame, most: int = 25_000, piece: int = 500, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Parts between blank lines; one beyond `most` characters is cut into packed sentences."""
    parts = _trimmed(F.split(text, "\\n\\s*\\n"))
    cut = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > most, _packed(_trimmed(F.split(p, "(?<=\\.)")), piece, " ", 1)).otherwise(F.array(p))))
    return _exploded(docs, id, cut)


def profile(content_type: Column, length: Column) -> Column:
    """struct(size, overlap) by type, else by length."""
    pair = lambda s, o: F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap"))
    return (
        F.when(content_type == "code", pair(1500, 100)).when(content_type == "academic_paper", pair(1200, 200)).when(content_type == "tutorial", pair(800, 150))
        .when(length < 1000, pair(300, 50)).when(length < 10_000, pair(800, 100)).otherwise(pair(1200, 200))
    )


@dataclass(frozen=True)
class Config:
    size: int = 1000
    overlap: int = 200
    least: int = 100
    window: int = 150
    smart: bool = True

    def __post_init__(self):
        if not 0 <= self.overlap < self.size or self.least > self.size:
            raise ValueError("overlap must be below size and least not above it")


#: what may end a chunk: (kind, pattern that ends at the place, quality with its bonus)
ENDS = (("paragraph", re.compile(r"\n\s*\n"), 3.5), ("code", re.compile(r"```\n"), 2.7), ("table", re.compile(r"\|[ \t]*\n(?!\|)"), 2.7), ("sentence", re.compile(r"[.!?]\s"), 2.8), ("line", re.compile(r"\n"), 0.6), ("word", re.compile(r"\s"), 0.4))


def best_end(text: str, at: int, low: int, window: int) -> tuple[int, str]:
    """The place near `at` that ends a chunk best: quality less 0.2 for each 100 characters away; ties go to the nearer, then the smaller."""
    a, b = max(low + 1, at - window), min(len(text), at + window)
    best = (0.0, -window - 1, -at, at, "size")
    for kind, pattern, quality in ENDS:
        for m in pattern.finditer(text, a, b):
            away = abs(m.end() - at)
            best = max(best, (quality - 0.002 * away, -away, -m.end(), m.end(), kind))
    return best[3], best[4]


def spans(text: str, c: Config) -> list[tuple[int, int, str]]:
    """(start, end, kind of its end) of the chunks of a text; a short piece is merged forward, the last one back."""
    if not text.strip():
        return []
    if len(text) <= c.size:
        return [(0, len(text), "complete_text")]
    out, at = [], 0
    while True:
        goal = at + c.size
        if goal >= len(text):
            end, kind = len(text), "text_end"
        else:
            end, kind = best_end(text, goal, at + c.least, c.window)
        out.append((at, end, kind))
        if end >= len(text):
            break
        following = _overlap_start(text, end, c)
        at = following if following > at else end
    if len(out) > 1 and len(text[out[-2][1] :].strip()) < c.least:
        (a, _, _), (_, b, kind) = out[-2], out[-1]
        out[-2:] = [(a, b, kind)]
    return out


def _overlap_start(text: str, end: int, c: Config) -> int:
    goal = end - c.overlap
    if not c.smart or not c.overlap:
        return goal
    reach = min(50, c.overlap // 2)
    a, b = max(0, goal - reach), min(end, goal + reach)
    for pattern in (r"(?<=[.!?]) ", " "):
        if m := re.compile(pattern).search(text, a, b):
            return m.end()
    return goal


def per_document(docs: DataFrame, cut: Callable[[str], list[dict]], schema: str, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each item that cut gives for a document, with the id (a long) and the kept columns, in Arrow batches of 8 MB."""
    rows = docs.select(F.col(id).cast("long").alias(id), *keep, F.col(text).cast("string").alias("__t"))
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__t")
    made_of = _parse_datatype_string(f"{kept}, {schema}")
    names = made_of.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made: list[dict] = []
            for *about, t in zip(pdf[id], *[pdf[c] for c in keep], pdf["__t"], strict=True):
                if isinstance(t, str):
                    own = dict(zip((id, *keep), about, strict=True))
                    made += [own | item for item in cut(t)]
                if len(made) >= 4096:  # what has been made goes on, so that a batch of long texts needs no room for all its items
                    yield pd.DataFrame(made, columns=names)
                    made = []
            yield pd.DataFrame(made, columns=names)

    return small_batches(rows).mapInPandas(run, made_of)


def recursive(docs: DataFrame, config: Config = Config(), id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """Chunks that end at good places and overlap: (id, kept columns, chunk_index, start, end, boundary, content, overlap_previous, overlap_next)."""

    def cut(t: str) -> list[dict]:
        found = spans(t, config)
        ends, starts = [0, *(b for _, b, _ in found)], [*(a for a, _, _ in found[1:]), len(t)]
        return [
            {"chunk_index": k, "start": a, "end": b, "boundary": kind, "content": t[a:b], "overlap_previous": max(0, ends[k] - a), "overlap_next": max(0, b - starts[k])}
            for k, (a, b, kind) in enumerate(found)
        ]

    return per_document(docs, cut, "chunk_index int, start int, end int, boundary string, content string, overlap_previous int, overlap_next int", id, text, keep)


def chunk_problem(text: Column, content: Column, start: Column, end: Column, overlap: Column) -> Column:
    """What is wrong with a chunk, or null."""
    return F.when(end <= start, "empty range").when(F.substring(text, start + 1, end - start) != content, "not a slice").when(overlap > 0.8 * (end - start), "overlap too large")


def hybrid(docs: DataFrame, config: Config = Config(), id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Front matter aside, sections by headers; code, tables, lists and quotes stay whole up to twice the size, other text is cut recursively. Rows carry their header path, depth, content type and number within the section."""
    from lodestone.operators.parsing import section_list, split_frontmatter, unit_list

    def cut(t: str) -> list[dict]:
        try:
            shift = len(t) - len(split_frontmatter(t)[1])
        except ValueError:  # broken front matter is text
            shift = 0
        body, out = t[shift:], []
        for s in section_list(body):
            k = 0
            at, stop = s["start"], s["end"]
            kept = [u for u in unit_list(body[at:stop]) if u["kind"] != "paragraph" and u["end"] - u["start"] <= 2 * config.size]
            marks, place = [], 0
            for u in kept:
                if u["start"] >= place:
                    marks += [(place, u["start"], "prose"), (u["start"], u["end"], u["kind"])]
                    place = u["end"]
            marks.append((place, stop - at, "prose"))
            for a, b, kind in marks:
                piece = body[at + a : at + b]
                for x, y, _ in spans(piece, config) if kind == "prose" else [(0, len(piece), kind)]:
                    if piece[x:y].strip():
                        out.append({"chunk_index": len(out), "sequence": k, "start": shift + at + a + x, "end": shift + at + a + y, "kind": kind, "path": s["path"], "depth": s["level"], "content": piece[x:y]})
                        k += 1
        return out

    return per_document(docs, cut, "chunk_index int, sequence int, start int, end int, kind string, path string, depth int, content string", id, text)


def with_model(chunks: DataFrame, fingerprint: str) -> DataFrame:
    return chunks.withColumn("model_fingerprint", F.lit(fingerprint))


def invalidated(chunks: DataFrame, fingerprint: str) -> DataFrame:
    """Chunks made under another model."""
    return chunks.where(~F.col("model_fingerprint").eqNullSafe(F.lit(fingerprint)))
