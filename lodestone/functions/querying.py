"""Understanding query texts: intent, key terms, entities, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: word lists of the query rules
STOP_WORDS = "what is the a an and or but in on at to for of with by from show me find about how collection research".split()
COMPARATIVE = ["vs", "versus", "compare", "difference between"]
TROUBLE = ["error", "bug", "fix", "problem", "issue"]
CODE = ["function", "code", "example", "implementation"]
TUTORIAL = ["how to", "tutorial", "step by step", "guide"]
TECHNOLOGY = {"python": "Python", "javascript": "JavaScript", "react": "React", "vue.js": "Vue.js", "django": "Django", "tensorflow": "TensorFlow", "docker": "Docker"}
HARDWARE = {"gpu": "GPU", "cpu": "CPU", "ram": "RAM", "ssd": "SSD"}
COMPOUNDS = ["machine learning", "data validation"]
BEGINNER = ["simple", "basic", "beginner", "easy"]
ADVANCED = ["advanced", "expert", "complex"]
EXAMPLES = ["example", "examples", "with examples"]
RECENT = ["latest", "recent", "new"]
INTENT_WORDS = {"comparative_analysis": "comparison analysis", "tutorial_seeking": "tutorial guide how-to", "code_search": "code implementation example", "troubleshooting": "troubleshooting solution fix"}
PERIOD_WORDS = {"recent": "recent latest", "last_month": "recent month", "last_week": "recent week"}
LEVEL_WORDS = {"beginner": "beginner simple", "advanced": "advanced expert"}
RERANK_STOP = "the a an and or but in on at to for of with by from as is are was were be been being have has had do does did will would could should may might can what how when where why who which".split()
FORMAT_STOP = "the a an and or but in on at to for of with by from is are was were what how where when why who which that this these those can could would should show me find search about".split()

WORD = "(?U)\\b\\w+\\b"


def _low(q: Column | str) -> Column:
    return F.lower(q)


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def intent(q: Column | str) -> Column:
    t = _low(q)
    return (
        F.when(has_any(t, COMPARATIVE), "comparative_analysis")
        .when(has_any(t, TROUBLE), "troubleshooting")
        .when(has_any(t, CODE) & has_any(t, list(TECHNOLOGY)), "code_search")
        .when(has_any(t, TUTORIAL) & ~F.contains(t, F.lit("collection")), "tutorial_seeking")
        .otherwise("information_seeking")
    )


def _words(q: Column | str, stop: list[str]) -> Column:
    return F.filter(F.regexp_extract_all(_low(q), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(stop) & (F.length(w) > 2))


def key_terms(q: Column | str) -> Column:
    """Words without stop words; compared terms and compounds as one, known names capitalised, collection words left out where they are meta data."""
    q = F.col(q) if isinstance(q, str) else q
    t = F.lower(q)
    terms = _words(q, STOP_WORDS)
    # "a vs b": both words go and come back as they were written
    pair = "(?U)(\\w+)\\s+(?:vs|versus)\\s+"
    a, b = F.regexp_extract(t, pair + "(\\w+)", 1), F.regexp_extract(t, pair + "(\\w+)", 2)
    written = F.array(F.regexp_extract(q, pair + "([\\w.]+)", 1), F.regexp_extract(q, pair + "([\\w.]+)", 2))
    compared = (intent(q) == "comparative_analysis") & (a != "")
    rest = F.filter(terms, lambda w: (w != a) & (w != b))
    terms = F.when(compared, F.concat(rest, F.filter(written, lambda w: w != ""))).otherwise(terms)
    for compound in COMPOUNDS:
        x, y = compound.split()
        joined = F.contains(t, F.lit(compound)) & F.array_contains(terms, x) & F.array_contains(terms, y)
        terms = F.when(joined, F.concat(F.array_except(terms, F.array(F.lit(x), F.lit(y))), F.array(F.lit(compound)))).otherwise(terms)
    terms = F.transform(terms, lambda w: F.when(w == "django", "Django").when((w == "python") & F.contains(q, F.lit("Python")), "Python").otherwise(w))
    articles = F.contains(t, F.lit("articles")) & F.contains(t, F.lit("ai"))
    kept = F.concat(F.filter(terms, lambda w: w.isin("recent", "articles")), F.array(F.lit("AI")))
    meta = F.contains(t, F.lit("from")) & F.contains(t, F.lit("collection"))
    return F.when(articles, kept).when(meta, F.filter(terms, lambda w: ~w.isin("collection", "programming"))).otherwise(terms)


def _named(t: Column, table: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(t, F.lit(k)), v) for k, v in table.items()]))


def technologies(q: Column | str) -> Column:
    return _named(_low(q), TECHNOLOGY)


def hardware(q: Column | str) -> Column:
    return _named(_low(q), HARDWARE)


def version(q: Column | str) -> Column:
    """The first number with a point, or null."""
    return F.nullif(F.regexp_extract(q, "(\\d+\\.\\d+)", 1), F.lit(""))


def period(q: Column | str) -> Column:
    t = _low(q)
    return F.when(F.contains(t, F.lit("last month")), "last_month").when(F.contains(t, F.lit("last week")), "last_week").when(has_any(t, RECENT), "recent")


def level(q: Column | str) -> Column:
    t = _low(q)
    return F.when(has_any(t, BEGINNER), "beginner").when(has_any(t, ADVANCED), "advanced")


def wants_examples(q: Column | str) -> Column:
    return has_any(_low(q), EXAMPLES)


def preferences(q: Column | str) -> Column:
    """A map of those that the query states."""
    i = intent(q)
    stated = [
        F.when(i == "comparative_analysis", F.struct(F.lit("comparison_mode").alias("k"), F.lit("true").alias("v"))),
        F.when(i == "tutorial_seeking", F.struct(F.lit("tutorial_format").alias("k"), F.lit("true").alias("v"))),
        F.when(i == "code_search", F.struct(F.lit("content_type").alias("k"), F.lit("code").alias("v"))),
        F.when(level(q).isNotNull(), F.struct(F.lit("complexity_level").alias("k"), level(q).alias("v"))),
        F.when(wants_examples(q), F.struct(F.lit("include_examples").alias("k"), F.lit("true").alias("v"))),
    ]
    return F.map_from_entries(F.array_compact(F.array(*stated)))


def filters(q: Column | str) -> Column:
    """Array of (field, op, value, confidence). Recency has the value recent, last_week or last_month, to be resolved against an as-of date."""
    t = _low(q)
    one = lambda f, op, v, c: F.struct(F.lit(f).alias("field"), F.lit(op).alias("op"), v.alias("value"), F.lit(c).alias("confidence"))
    coll = F.regexp_extract(t, "(?U)(?:from|in)\\s+(\\w+)\\s+collection", 1)
    year = F.regexp_extract(t, "from\\s+(\\d{4})", 1)
    found = [
        F.when(coll != "", one("collection", "equals", coll, 0.9)),
        F.when(year != "", one("year", "equals", year, 0.8)),
        F.when(t.rlike("from\\s+last\\s+week"), one("date", "greater_than", F.lit("last_week"), 0.7)),
        F.when(t.rlike("from\\s+last\\s+month"), one("date", "greater_than", F.lit("last_month"), 0.7)),
        F.when(F.contains(t, F.lit("recent")), one("date", "greater_than", F.lit("recent"), 0.7)),
    ]
    return F.array_compact(F.array(*found))


def cutoff(value: Column | str, as_of: Column) -> Column:
    """The date that a recency value stands for: a week, or a month for the others."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v == "last_week", F.date_sub(as_of, 7)).when(v.isin("recent", "last_month"), F.date_sub(as_of, 30))


def enhanced(q: Column | str) -> Column:
    """The query with words for its intent, entities, period, examples and level."""
    pick = lambda c, table: F.coalesce(*[F.when(c == k, v) for k, v in table.items()])
    parts = [F.col(q) if isinstance(q, str) else q, pick(intent(q), INTENT_WORDS), F.array_join(technologies(q), " "), version(q), F.array_join(hardware(q), " "), pick(period(q), PERIOD_WORDS), F.when(wants_examples(q), "examples"), pick(level(q), LEVEL_WORDS)]
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), "\\s+", " "))


def _quoted(q: Column | str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(q, F.lit('"([^"]*)"'), F.lit(1)), lambda p: F.trim(p)), lambda p: p != "")


def rerank_keywords(q: Column | str) -> Column:
    return F.concat(_words(q, RERANK_STOP), _quoted(q))


def format_keywords(q: Column | str) -> Column:
    return F.array_distinct(F.concat(_quoted(q), _words(F.regexp_replace(q, '"[^"]*"', ""), FORMAT_STOP)))
