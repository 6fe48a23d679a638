"""Reading the structure of documents: front matter, inline tags, headers, and units of code, tables, lists and quotes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: forms of front matter and of inline tags
FRONT = re.compile(r"(---|\+\+\+)\s*\n(.*?\n)\1\s*\n", re.S)
INLINE = {
    "tag": r"@(\w+):(\w+)",
    "bracket": r"\[\[(\w+):([^\]]+)\]\]",
    "brace": r"\{(\w+):([^}]+)\}",
    "comment": r"<!-- @([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*([^>]+?) -->",
}


def split_frontmatter(text: str) -> tuple[dict, str, str]:
    """(values, body, kind: yaml, toml or none); broken front matter raises ValueError."""
    m = FRONT.match(text)
    if not m:
        return {}, text, "none"
    kind = "yaml" if m[1] == "---" else "toml"
    try:
        if kind == "yaml":
            import yaml

            values = yaml.safe_load(m[2]) or {}
        else:
            import tomllib

            values = tomllib.loads(m[2])
    except Exception as e:
        raise ValueError(f"bad {kind} front matter: {e}") from e
    if not isinstance(values, dict):
        raise ValueError(f"bad {kind} front matter: not a mapping")
    return values, text[m.end() :], kind


def frontmatter(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, values as JSON, title, author, tags, body, problem). A document whose front matter is broken has kind none, the whole text as body and the reason as problem; the others go on."""
    from lodestone.operators.chunking import per_document

    def one(t: str) -> list[dict]:
        try:
            values, body, kind = split_frontmatter(t)
        except ValueError as e:
            return [{"kind": "none", "values": "{}", "title": None, "author": None, "tags": [], "body": t, "problem": str(e).split("\n")[0]}]
        tags = values.get("tags") or []
        tags = [x.strip() for x in tags.split(",")] if isinstance(tags, str) else [str(x) for x in tags]
        text_of = lambda k: None if values.get(k) is None else str(values[k])
        return [{"kind": kind, "values": json.dumps(values, default=str, sort_keys=True), "title": text_of("title"), "author": text_of("author"), "tags": tags, "body": body, "problem": None}]

    return per_document(docs, one, "kind string, values string, title string, author string, tags array<string>, body string, problem string", id, text)


def inline_tags(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kind, key, value, json): one row a tag, from built-in expressions; json is set where a comment's value is an object."""
    made = []
    for kind, pattern in INLINE.items():
        keys, values = (F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(g)) for g in (1, 2))
        made.append(_pairs(kind, keys, values))
    rows = docs.select(F.col(id), F.inline(F.concat(*made)))
    return rows.withColumn("json", F.when(F.col("value").startswith("{"), F.col("value")))


def _pairs(kind: str, keys: Column, values: Column) -> Column:
    return F.zip_with(keys, values, lambda k, v: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.trim(v).alias("value")))


def without_inline_tags(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for pattern in INLINE.values():
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    return out


def tag_union(*arrays: Column) -> Column:
    """Tags in order, each once."""
    return F.array_distinct(F.concat(*arrays))


#: fixed values: rules of the small mark-up renderer, in order: (name, pattern, replacement)
MARKDOWN = [
    *[(f"header{n}", f"(?m)^#{{{n}}}\\s+(.+)$", f"<h{n}>$1</h{n}>") for n in range(1, 7)],
    ("bold", "\\*\\*(.*?)\\*\\*", "<strong>$1</strong>"),
    ("italic", "(?<!\\*)\\*(?!\\*)([^*]+?)\\*(?!\\*)", "<em>$1</em>"),
    ("link", "\\[([^\\]]+)\\]\\(([^)]+)\\)", '<a href="$2">$1</a>'),
]


def markdown_to_html(text: Column | str, rules: list[tuple[str, str, str]] | None = None) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for _, pattern, by in rules or MARKDOWN:
        out = F.regexp_replace(out, pattern, by)
    return out


def rule_counts(text: Column | str, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """A map of how often each rule fits, each on the text that those before have rewritten."""
    out, counts = F.col(text) if isinstance(text, str) else text, []
    for name, pattern, by in rules or MARKDOWN:
        counts += [F.lit(name), F.regexp_count(out, F.lit(pattern))]
        out = F.regexp_replace(out, pattern, by)
    return F.create_map(*counts)


def parse_by_kind(kind: Column, text: Column | str, parsers: dict[str, Callable[[Column], Column]]) -> Column:
    """The text as the parser of its kind reads it; kinds without one stay as they are."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.when(kind == k, parse(t)) for k, parse in parsers.items()], t)


HEADER = re.compile(r"(#{1,6})\s+(.+)")
FENCE = re.compile(r"(```|~~~)")


def _lines(text: str):
    """(offset, line, inside a fence or its marks)."""
    at, mark = 0, None
    for line in text.split("\n"):
        s = line.strip()
        m = FENCE.match(s)
        inside = mark is not None or m is not None
        if mark is None and m:
            mark = m[1]
        elif mark is not None and s.startswith(mark):
            mark = None
        yield at, line, inside
        at += len(line) + 1


def section_list(text: str) -> list[dict]:
    """Sections by headers, with what comes before the first as one of level 0: title, level, line, start and end of all of it, parent's number and path of titles. Headers inside fences are text."""
    heads = [(0, 0, "", 0)]
    for n, (at, line, fenced) in enumerate(_lines(text)):
        m = None if fenced else HEADER.fullmatch(line.strip())
        if m:
            heads.append((len(m[1]), at, m[2].strip(), n))
    if len(heads) > 1 and not text[: heads[1][1]].strip():
        heads.pop(0)
    out, open_ = [], []
    for k, (level, at, title, line) in enumerate(heads):
        while open_ and out[open_[-1]]["level"] >= level:
            open_.pop()
        if open_ and out[open_[-1]]["level"] == 0:
            open_.pop()
        path = [out[i]["title"] for i in open_] + [title]
        end = heads[k + 1][1] if k + 1 < len(heads) else len(text)
        out.append({"section": k, "parent": open_[-1] if open_ else None, "level": level, "title": title, "line": line, "start": at, "end": end, "path": " > ".join(path)})
        open_.append(k)
    return out


def sections(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, parent, level, title, line, start, end, path, content), a row a section."""
    from lodestone.operators.chunking import per_document

    def cut(t: str) -> list[dict]:
        return [s | {"content": t[s["start"] : s["end"]]} for s in section_list(t)]

    return per_document(docs, cut, "section int, parent int, level int, title string, line int, start int, end int, path string, content string", id, text)


def outline(sections_: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, outline): titles of a document, indented by level."""
    row = F.struct("section", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), F.col("title")).alias("t"))
    return sections_.where("level > 0").groupBy(id).agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["t"]), "\n").alias("outline"))


def structure_statistics(sections_: DataFrame, id: str = "doc_id") -> DataFrame:
    return sections_.groupBy(id).agg(
        F.count("*").alias("n_sections"), F.max("level").alias("max_level"), F.countDistinct("level").alias("n_levels"), F.avg(F.length("content")).alias("mean_length"),
        F.sum(F.length("content")).alias("total_length"), F.when(F.max("level") > F.min("level"), "hierarchical").otherwise("flat").alias("kind"),
    )


LIST_ITEM = re.compile(r"\s*(?:[-*+]\s+\[[ xX]\]|[-*+]\s|\d+[.)]\s)")


def _kind(line: str, fenced: bool) -> str:
    if fenced:
        return "code_block"
    if not line.strip():
        return "blank"
    if line.count("|") >= 2:
        return "table"
    if line.lstrip().startswith(">"):
        return "blockquote"
    if LIST_ITEM.match(line):
        return "list"
    if line.startswith(("    ", "\t")):
        return "indented"
    return "paragraph"


def unit_list(text: str, handlers: dict[str, Callable[[str], bool]] | None = None) -> list[dict]:
    """Units of a text in order: kind, start, end, and details by kind. Runs of lines of one kind; indented lines go on with a list, else they are code; two fences that touch are two units. handlers: further kinds, each with a test of a line outside fences, which go before the built-in ones."""
    units: list[dict] = []
    mark = None
    for at, line, fenced in _lines(text):
        kind = next((k for k, test in (handlers or {}).items() if not fenced and test(line)), None) or _kind(line, fenced)
        end = at + len(line)
        last = units[-1] if units else None
        opens = fenced and mark is None
        if fenced:
            s = line.strip()
            m = FENCE.match(s)
            mark = (m[1] if m else None) if opens else (None if s.startswith(mark) else mark)
        if kind == "indented":
            kind = "list" if last and last["kind"] == "list" and last["open"] else "code_block"
        if kind == "blank":
            if last:
                last["open"] = last["kind"] == "code_block" and last["indented"]
            continue
        joins = last and last["kind"] == kind and last["open"] and not opens and last["indented"] == (kind == "code_block" and not fenced)
        if joins:
            last["end"] = end
        else:
            units.append({"kind": kind, "start": at, "end": end, "indented": kind == "code_block" and not fenced, "open": True})
        if fenced and mark is None:
            units[-1]["open"] = False
    return [{"kind": u["kind"], "start": u["start"], "end": u["end"], "details": _details(u["kind"], text[u["start"] : u["end"]], u["indented"])} for u in units]


def _details(kind: str, content: str, indented: bool) -> dict[str, str]:
    lines = content.split("\n")
    if kind not in ("code_block", "table", "list", "blockquote", "paragraph"):
        return {"lines": str(len(lines))}
    if kind == "code_block":
        return {"language": "" if indented else lines[0].strip()[3:].strip(), "block_type": "indented" if indented else "fenced", "line_count": str(len(lines)), "has_imports": str(not indented and "import " in content).lower()}
    if kind == "table":
        cells = lambda s: [c.strip() for c in s.strip().strip("|").split("|")]
        separator = len(lines) > 1 and all(c and set(c) <= set("-:") for c in cells(lines[1]))
        align = ["center" if c[0] == c[-1] == ":" else "right" if c[-1] == ":" else "left" for c in cells(lines[1])] if separator else ["left"] * len(cells(lines[0]))
        return {"columns": str(len(cells(lines[0]))), "rows": str(len(lines)), "has_separator": str(separator).lower(), "alignments": ",".join(align)}
    if kind == "list":
        items = [x for x in lines if LIST_ITEM.match(x)]
        tasks = [x for x in items if re.match(r"\s*[-*+]\s+\[", x)]
        done = [x for x in tasks if re.match(r"\s*[-*+]\s+\[[xX]", x)]
        depth = len({len(x) - len(x.lstrip()) for x in items})
        style = "task" if tasks else "numbered" if items and items[0].lstrip()[0].isdigit() else "bullet"
        return {"style": style, "items": str(len(items)), "done": str(len(done)), "depth": str(depth)}
    if kind == "blockquote":
        depth = max(len(re.match(r"\s*((?:>\s*)+)", x)[1].replace(" ", "")) for x in lines)
        last = re.sub(r"^[\s>]+", "", lines[-1])
        return {"depth": str(depth), "attribution": last.lstrip("-— ") if last[:1] in "-—" else ""}
    return {"words": str(len(content.split())), "sentences": str(len(re.findall(r"[.!?](?:\s|$)", content)))}


def units(docs: DataFrame, id: str = "doc_id", text: str = "text", handlers: dict[str, Callable[[str], bool]] | None = None) -> DataFrame:
    """(id, unit_index, kind, start, end, details, content), a row a unit; handlers as in unit_list."""
    from lodestone.operators.chunking import per_document

    def cut(t: str) -> list[dict]:
        return [{"unit_index": k, "kind": u["kind"], "start": u["start"], "end": u["end"], "details": u["details"], "content": t[u["start"] : u["end"]]} for k, u in enumerate(unit_list(t, handlers))]

    return per_document(docs, cut, "unit_index int, kind string, start int, end int, details map<string,string>, content string", id, text)


def unit_function(handlers: dict[str, Callable[[str], bool]] | None = None):
    """A table function for SQL, a row a unit: `from docs, lateral atomic_units(text)`; its columns depend on what it is called with: a second argument false leaves the details out. To be registered with spark.udtf.register."""
    from pyspark.sql import types as T
    from pyspark.sql.functions import udtf
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    @udtf(useArrow=True)  # which keeps the order of details
    class Units:
        @staticmethod
        def analyze(text: AnalyzeArgument, details: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(text.dataType, T.StringType):
                raise ValueError("the first argument must be a text")
            s = T.StructType().add("unit_index", T.IntegerType()).add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
            if details is None or details.value:
                s = s.add("details", T.MapType(T.StringType(), T.StringType()))
            return AnalyzeResult(s)

        def eval(self, text: str, details: bool = True):
            for k, u in enumerate(unit_list(text, handlers) if text else []):
                yield (k, u["kind"], u["start"], u["end"], u["details"]) if details else (k, u["kind"], u["start"], u["end"])

    return Units


def header_context(levels: Column, depths: Column, most: int) -> Column:
    """Titles of a header path down to a depth."""
    kept = F.filter(F.arrays_zip(levels.alias("l"), depths.alias("d")), lambda x: x["d"] <= most)
    return F.array_join(F.transform(kept, lambda x: x["l"]), " > ")


def find_sections(sections_: DataFrame, title: str | None = None, exact_case: bool = True, levels: tuple[int, int] | None = None, title_pattern: str | None = None, content_pattern: str | None = None, where: Column | None = None) -> DataFrame:
    """Sections that meet all given conditions; patterns see several lines, and a point fits line ends."""
    rows = sections_
    if title is not None:
        rows = rows.where(F.col("title") == title if exact_case else F.lower("title") == title.lower())
    if levels is not None:
        rows = rows.where(F.col("level").between(*levels))
    if title_pattern is not None:
        rows = rows.where(F.col("title").rlike(title_pattern))
    if content_pattern is not None:
        rows = rows.where(F.col("content").rlike(f"(?ms){content_pattern}"))
    return rows if where is None else rows.where(where)
