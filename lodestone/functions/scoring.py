"""Scores and classes of documents, chunks and hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.querying import has_any

# fixed values: keyword lists, weights and limits of the scoring rules
QUALITY_WEIGHTS = {"length": 0.15, "structure": 0.20, "credibility": 0.25, "freshness": 0.10, "relevance": 0.20, "language": 0.05, "uniqueness": 0.05}
CATEGORIES = {
    "machine-learning": ["machine learning", "neural network", "ai", "artificial intelligence", "deep learning", "algorithm", "model training", "regression", "classification"],
    "research": ["research", "study", "analysis", "experiment", "hypothesis", "methodology", "results", "conclusion", "findings"],
    "technology": ["software", "programming", "development", "code", "api", "framework", "library", "database", "cloud"],
    "business": ["market", "business", "strategy", "revenue", "profit", "customer", "product", "service", "management"],
}
CATEGORY_COLLECTIONS = {"machine-learning": "ml-research", "research": "academic-papers", "technology": "tech-docs", "business": "business-reports"}
DOMAINS = {
    "academic": ["research", "study", "analysis", "paper", "journal", "publication", "methodology", "findings", "conclusion", "hypothesis", "experiment"],
    "technical": ["algorithm", "implementation", "code", "function", "class", "method", "framework", "library", "api", "documentation", "specification"],
    "research": ["investigation", "survey", "review", "assessment", "evaluation", "comparison", "model", "theory", "approach", "technique"],
}
TAGS = {
    "machine_learning": ["neural", "network", "machine learning"],
    "algorithms": ["algorithm", "optimization"],
    "data_analysis": ["data", "dataset", "analysis"],
    "modeling": ["model", "training", "prediction"],
    "research": ["research", "study", "findings"],
    "academic_paper": ["paper", "publication", "journal"],
}
CONTENT_TYPES = {"code": ["def ", "class ", "import ", "function"], "academic_paper": ["abstract", "introduction", "methodology"], "tutorial": ["tutorial", "guide", "how-to"], "documentation": ["api", "documentation", "reference"]}
COMPLEX_WORDS = ["advanced", "complex", "sophisticated", "comprehensive", "detailed", "in-depth", "extensive", "thorough", "intricate", "elaborate"]
TECHNICAL_TERMS = ["optimization", "algorithm", "neural", "gradient", "architecture", "implementation", "framework", "methodology", "analysis"]
CODE_WORDS = ["def", "function", "class", "import", "return", "if", "for", "while"]
ACADEMIC_WORDS = ["neural", "network", "learning", "algorithm", "model", "training", "optimization", "gradient", "deep", "machine", "artificial", "intelligence", "research", "study", "analysis", "method", "approach", "framework", "architecture", "structure"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f refers to it."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def words(text: Column | str) -> Column:
    return F.array_remove(F.split(_c(text), "\\s+"), "")


def occurrences(text: Column | str, part: str) -> Column:
    c = _c(text)
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def hits(text: Column, terms: list[str]) -> Column:
    return _sum([F.contains(text, F.lit(t)).cast("int") for t in terms])


def length_score(text: Column | str, least: int = 50, most: int = 100_000) -> Column:
    n = F.length(_c(text))
    return F.when(n < least, 0.0).when(n > most, 0.8).otherwise(F.least(n / 2000.0, F.lit(1.0)))


def structure_score(text: Column | str) -> Column:
    t = _c(text)
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    return F.least(
        part(F.contains(t, F.lit("\n\n")), 0.3)
        + part(occurrences(t, ".") >= 3, 0.2)
        + part(F.contains(t, F.lit("#")), 0.2)
        + part(has_any(t, ["- ", "* ", "1. ", "2. "]), 0.1)
        + part(has_any(t, ["`", "def ", "class ", "import "]), 0.2),
        F.lit(1.0),
    )


def credibility_score(author: Column | str, date: Column | str, identifier: Column | str, publisher: Column | str) -> Column:
    """Columns are texts; null or empty ones count as missing."""
    there = lambda c: F.coalesce(_c(c).cast("string"), F.lit("")) != ""
    a = F.coalesce(_c(author).cast("string"), F.lit(""))
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    several = F.contains(a, F.lit(",")) | F.contains(a, F.lit(" and "))
    return F.least(0.4 + part(a != "", 0.3) + part(several, 0.1) + part(there(date), 0.2) + part(there(identifier), 0.3) + part(there(publisher), 0.2), F.lit(1.0))


def freshness_score(date: Column | str, as_of: Column) -> Column:
    days = F.datediff(as_of, F.try_to_timestamp(_c(date).cast("string")).cast("date"))
    return F.when(days.isNull(), 0.5).when(days < 30, 1.0).when(days < 365, 0.8).when(days < 1825, 0.6).otherwise(0.3)


def language_score(text: Column | str) -> Column:
    t = _c(text)
    sentences = F.filter(F.transform(F.split(t, "\\."), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")
    first = F.transform(sentences, lambda s: F.substring(s, 1, 1))
    counts = bound(first, lambda f: F.struct(F.size(f).alias("n"), F.size(F.filter(f, lambda c: (c == F.upper(c)) & (F.upper(c) != F.lower(c)))).alias("upper")))

    def score(c: Column) -> Column:
        mean = F.length(t) / F.greatest(c["n"], F.lit(1))
        return F.least(0.7 + F.when(c["n"] > 0, 0.2 * c["upper"] / c["n"]).otherwise(0.0) + F.when(mean.between(10, 100), 0.1).otherwise(0.0), F.lit(1.0))

    return F.when(t.isNotNull(), bound(counts, score))


def uniqueness_score(text: Column | str) -> Column:
    ratio = bound(words(F.lower(_c(text))), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)))
    return bound(ratio, lambda r: F.when(r.isNull(), 0.0).when(r < 0.3, 0.2).when(r < 0.5, 0.5).otherwise(r))


def quality_parts(text: Column | str, credibility: Column | float = 0.4, freshness: Column | float = 0.5, relevance: float = 0.7) -> Column:
    """struct of the scores that make up the quality, and their weighted sum as quality."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    parts = {"length": length_score(text), "structure": structure_score(text), "credibility": lit(credibility), "freshness": lit(freshness), "relevance": lit(relevance), "language": language_score(text), "uniqueness": uniqueness_score(text)}
    return bound(F.struct(*[v.alias(k) for k, v in parts.items()]), lambda p: F.struct(*[p[k].alias(k) for k in parts], _sum([p[k] * w for k, w in QUALITY_WEIGHTS.items()]).alias("quality")))


def quality_score(text: Column | str, credibility: Column | float = 0.4, freshness: Column | float = 0.5, relevance: float = 0.7) -> Column:
    return quality_parts(text, credibility, freshness, relevance)["quality"]


def grade(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.9, "A").when(s >= 0.8, "B").when(s >= 0.7, "C").when(s >= 0.6, "D").otherwise("F")


def category(text: Column | str) -> Column:
    """struct(name, confidence): the category of most keyword weight (occurrences times length) above 0.4 confidence, the first on ties, else general."""

    def found(t: Column) -> Column:
        made = []
        for k, (name, terms) in enumerate(CATEGORIES.items()):
            # most texts lack most terms: looking is cheaper than replacing
            weight = _sum([F.when(F.contains(t, F.lit(term)), occurrences(t, term) * len(term)).otherwise(F.lit(0).cast("long")) for term in terms])
            # a null or empty text has no share; least would pass over its null and give the limit
            conf = F.least(F.coalesce(F.try_divide(weight, F.length(t)) * 1000, F.lit(0.0)), F.lit(0.95))
            made.append(F.struct(conf.alias("confidence"), F.lit(-k).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.filter(F.array(*made), lambda x: x["confidence"] > 0.4))

    return bound(bound(F.lower(_c(text)), found), lambda b: F.struct(F.coalesce(b["name"], F.lit("general")).alias("name"), F.coalesce(b["confidence"], F.lit(0.4)).alias("confidence")))


def category_collection(name: Column | str, default: str = "general") -> Column:
    c = _c(name)
    return F.coalesce(*[F.when(c == k, v) for k, v in CATEGORY_COLLECTIONS.items()], F.lit(default))


def semantic_tags(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return F.array_compact(F.array(*[F.when(has_any(t, terms), tag) for tag, terms in TAGS.items()]))


def content_type(text: Column | str) -> Column:
    t = F.lower(_c(text))
    return F.coalesce(*[F.when(has_any(t, terms), k) for k, terms in CONTENT_TYPES.items()], F.lit("general"))


def domain(text: Column | str) -> Column:
    t = F.lower(_c(text))
    a, b, c = (hits(t, DOMAINS[k]) for k in ("academic", "technical", "research"))
    return F.when(F.greatest(a, b, c) == 0, "general").when((a >= b) & (a >= c), "academic").when(b >= c, "technical").otherwise("research")


def complexity(text: Column | str) -> Column:
    t, n = F.lower(_c(text)), F.size(words(text))
    score = 3.0 + F.when(n > 1000, 2.0).when(n > 500, 1.0).otherwise(0.0) + hits(t, COMPLEX_WORDS) * 0.5 + hits(t, TECHNICAL_TERMS) * 0.3
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), score))


def key_phrases(text: Column | str) -> Column:
    """First three words of those of the first three sentences that have as many."""
    first = F.transform(F.slice(F.split(_c(text), "\\. "), 1, 3), lambda s: F.slice(F.array_remove(F.split(s, "\\s+"), ""), 1, 3))
    return F.transform(F.filter(first, lambda w: F.size(w) >= 3), lambda w: F.array_join(w, " "))


def reading_minutes(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.bround(F.size(words(text)) / 200, 0).cast("int"))


def route(document_type: Column | str, path: Column | str, team: Column | str) -> Column:
    """The type of collection that a document belongs in."""
    kind, p, t = F.lower(F.coalesce(_c(document_type), F.lit("unknown"))), F.lower(F.coalesce(_c(path), F.lit(""))), _c(team)
    return (
        F.when(F.coalesce(t, F.lit("")).isin("", "public") == F.lit(False), "project-specific")
        .when(has_any(p, ["project/", "src/", "code/"]), "project-specific")
        .when(has_any(kind, ["reference", "manual", "specification"]), "reference")
        .when(has_any(p, ["reference/", "docs/", "manual/"]), "reference")
        .when(has_any(p, ["fundamental/", "core/", "standards/"]), "fundamental")
        .when(kind.isin("pdf", "docx") & F.contains(p, F.lit("standard")), "fundamental")
        .when(has_any(p, ["temp/", "tmp/", "scratch/"]), "temporary")
        .otherwise("general")
    )


def chunk_type(text: Column | str) -> Column:
    t = F.regexp_replace(_c(text), "^\\s+|\\s+$", "")
    lines = F.split(t, "\n")
    n = F.size(lines)
    starts = F.size(F.filter(lines, lambda x: F.ltrim(x).rlike("^(- |\\* |\\+ |1\\. |2\\. )")))
    pipes = F.size(F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    headers = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("#")))
    links = occurrences(t, "[") + occurrences(t, "http")
    return (
        F.when(t == "", "empty")
        .when(F.contains(t, F.lit("```")), "code_block")
        .when(occurrences(t, "`") / F.length(t) > 0.05, "code_heavy")
        .when(starts > n * 0.5, "list")
        .when(pipes > n * 0.3, "table")
        .when(headers > 0, "header_heavy")
        .when(links > F.size(words(t)) * 0.1, "link_heavy")
        .when(has_any(t, ["$", "\\(", "\\)", "\\[", "\\]"]), "mathematical")
        .otherwise("prose")
    )


def chunk_quality(text: Column | str, boundary: Column | None = None) -> Column:
    """struct(score, issues): mean of factors for length, ending, empty lines and, where it is a sentence boundary, its ending."""
    t = F.regexp_replace(_c(text), "^\\s+|\\s+$", "")
    lines = F.split(t, "\n")
    n = F.length(t)
    length = F.when(n < 50, 0.6).when(n > 2000, 0.8).otherwise(1.0)
    last = F.substring(t, -1, 1)
    ending = F.when(last.isin(".", "!", "?", ":", ";"), 1.0).when(last == ",", 0.7).otherwise(0.5)
    sparse = (F.size(lines) > 1) & (F.size(F.filter(lines, lambda x: F.trim(x) == "")) / F.size(lines) > 0.5)
    empty = F.when(sparse, 0.8).otherwise(1.0)
    broken = ((boundary == "sentence") & ~last.isin(".", "!", "?")) if boundary is not None else F.lit(False)
    total = F.when(broken, (length + ending + empty + 0.7) / 4).otherwise((length + ending + empty) / 3)
    issues = F.array_compact(F.array(
        F.when(n < 50, "very short"), F.when(n > 2000, "very long"), F.when(last == ",", "ends with comma"),
        F.when(~last.isin(".", "!", "?", ":", ";", ","), "ends abruptly"), F.when(sparse, "too many empty lines"), F.when(broken, "not a sentence end"),
    ))
    return F.when(t == "", F.struct(F.lit(0.0).alias("score"), F.array(F.lit("empty")).alias("issues"))).otherwise(F.struct(F.bround(total, 2).alias("score"), issues.alias("issues")))


def content_statistics(text: Column | str) -> Column:
    t = _c(text)
    lines, w = F.split(t, "\n"), words(t)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    return F.struct(
        F.length(t).cast("long").alias("chars"), count("\\p{L}").alias("letters"), count("\\p{Nd}").alias("digits"), count("(?U)\\s").alias("spaces"),
        F.size(w).cast("long").alias("words"), F.size(F.array_distinct(F.transform(w, F.lower))).cast("long").alias("unique_words"),
        F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) == "")).cast("long").alias("empty_lines"),
        occurrences(t, "#").alias("headers"), occurrences(t, "**").alias("bold"), occurrences(t, "`").alias("backticks"), occurrences(t, "[").alias("links"), occurrences(t, "![").alias("images"),
    )


def preview(text: Column | str, most: int = 100) -> Column:
    t = _c(text)
    head = F.substring(t, 1, most - 3)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    kept = F.when((F.locate(" ", head) > 0) & (space > (most - 3) * 0.8), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(kept, F.lit("...")))


def code_similarity(a: Column | str, b: Column | str) -> Column:
    x, y = F.lower(_c(a)), F.lower(_c(b))
    shared = _sum([(F.contains(x, F.lit(k)) & F.contains(y, F.lit(k))).cast("int") for k in CODE_WORDS])
    sort = F.when(F.contains(x, F.lit("sort")) & F.contains(y, F.lit("sort")), 2).otherwise(0)
    array = F.when(F.contains(x, F.lit("array")) & has_any(y, ["array", "list"]), 1).otherwise(0)
    return F.least(F.lit(1.0), (shared + sort + array) / (len(CODE_WORDS) + 3))


def academic_similarity(a: Column | str, b: Column | str) -> Column:
    x, y = F.lower(_c(a)), F.lower(_c(b))
    inx, iny = (lambda s: F.contains(x, F.lit(s))), (lambda s: F.contains(y, F.lit(s)))
    boost = lambda cond, n: F.when(cond, n).otherwise(0)
    shared = _sum([(inx(k) & iny(k)).cast("int") for k in ACADEMIC_WORDS])
    total = (
        shared
        + boost(inx("neural network") & iny("deep learning"), 8)
        + boost(inx("neural") & (iny("deep") | iny("learning")), 6)
        + boost(inx("architecture") & iny("structure"), 4)
        + boost(inx("model") & iny("model"), 3)
        + boost(inx("network") & (iny("structure") | iny("model")), 3)
    )
    s = total / (len(ACADEMIC_WORDS) + 20)
    s = F.when(total > 0, F.greatest(s, F.lit(0.4))).otherwise(s)
    special = inx("neural") & inx("network") & inx("architecture") & iny("deep") & iny("learning") & iny("model") & iny("structure")
    return F.least(F.lit(1.0), F.when(special, F.greatest(s, F.lit(0.65))).otherwise(s))


def relevance(distance: Column | str) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1 - _c(distance)), 3)


def confidence_step(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s > 0.9, 0.95).when(s > 0.8, 0.85).when(s > 0.6, 0.7).when(s > 0.4, 0.5).otherwise(0.3)


def relevance_level(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 0.9, "Highly Relevant").when(s >= 0.7, "Very Relevant").when(s >= 0.5, "Relevant").when(s >= 0.3, "Somewhat Relevant").otherwise("Low Relevance")


def matched_terms(text: Column | str, terms: Column | str) -> Column:
    return F.filter(_c(terms), lambda w: F.contains(F.lower(_c(text)), F.lower(w)))


def term_frequency(text: Column | str, term: str) -> Column:
    return occurrences(F.lower(_c(text)), term.lower())


def keyword_density(text: Column | str, keywords: list[str]) -> Column:
    n = F.size(words(text))
    total = _sum([term_frequency(text, k) for k in keywords])
    return F.when(n > 0, F.least(F.lit(1.0), total / n)).otherwise(0.0)


def structure_relevance(title: Column | str, section: Column | str, kind: Column | str, n_keys: Column | str, source: Column | str) -> Column:
    there = lambda c: F.coalesce(_c(c), F.lit("")) != ""
    part = lambda cond, w: F.when(cond, w).otherwise(0.0)
    return F.least(F.lit(1.0), part(there(title), 0.3) + part(there(section), 0.2) + part(F.lower(_c(kind)).isin("markdown", "text", "documentation"), 0.2) + part(_c(n_keys) > 3, 0.1) + part(there(source), 0.2))


def hit_confidence(semantic: Column | str, density: Column | str, structure: Column | str) -> Column:
    s = _c(semantic) * 0.6 + _c(density) * 0.25 + _c(structure) * 0.15
    return F.when(s >= 0.8, "very_high").when(s >= 0.65, "high").when(s >= 0.45, "medium").otherwise("low")


def strategy(k: Column | str) -> Column:
    n = _c(k)
    return F.when(n <= 50, "precise").when(n >= 500, "fast").otherwise("balanced")


def highlight(text: Column | str, terms: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """Every occurrence of a term in any case, longest terms first in one pass, so that none is marked inside another."""
    import re

    parts = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(_c(text), f"(?i)({parts})", f"{left}$1{right}") if terms else _c(text)


def highlight_words(text: Column | str, terms: list[str]) -> Column:
    """As highlight, but whole words of an HTML-escaped text."""
    import re

    out = _c(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    parts = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(out, f"(?iU)\\b({parts})\\b", "<mark>$1</mark>") if terms else out


def source_type(path: Column | str) -> Column:
    p = F.lower(_c(path))
    ext = {"markdown": [".md", ".markdown"], "text": [".txt", ".text"], "pdf": [".pdf"], "python": [".py"], "html": [".html", ".htm"]}
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [p.endswith(e) for e in v]), k) for k, v in ext.items()], F.lit("unknown"))
