"""Inverted indexes kept as tables: words and n-grams of texts for pruned top-k search, and values of fields for filters.

Documents get row numbers when they are written. Postings are rows (term, n, rows), one for each term of a batch of
documents, so a term of any frequency lies over as many rows as there are batches, and nothing is shuffled to index a text.
Kinds, each a table: `word`; `gram`, every run of up to three characters of a text's first ten words; `domain`, terms that
raise scores.

A search scores few documents. Its threshold comes from the documents of the rarest words of a query, scored exactly:
the k-th best of these. A document that has none of the rarest words but the last n can't score more than n shares and
all bonuses; so the lists of the common words are never opened where that stays below the threshold. What the opened
lists leave possible is bounded again with its own bonuses; those of the largest bounds are scored exactly for a better
threshold, and of the others only those that can reach it. Only a query whose threshold is within its bonuses opens the
lists of its domain terms, and for each of its words that of its rarest n-gram, as a word counts for a bonus inside
another one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed values: terms that raise the score of a text that shares them with the query, and the bonus of a query word within the first ten words
BOOSTS = {"neural": 0.3, "machine learning": 0.4, "algorithm": 0.2}
TITLE, TITLE_WORDS = 0.2, 10
CLOSE = 1e-9


def dealt(df: DataFrame, task_bytes: int = 64 << 20) -> DataFrame:
    """df over all tasks if it is so small that it may lie in one row group; larger tables are read as they lie."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(tasks) if size < tasks * task_bytes else df


def small_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """df; the session's Arrow batches are lowered to 8 MB, so that long texts don't fill the memory beside the heap."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    said = str(conf.get(key, "64m")).lower().rstrip("b")
    size = int(float(said.rstrip("kmgt")) * 1024 ** " kmgt".index(said[-1] if said[-1] in "kmgt" else " "))
    if not 0 < size <= most:
        conf.set(key, f"{most}b")
    return df


def words_of(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(text), "\\s+"), "")


def head_of(text: Column | str) -> Column:
    """The first ten words; what is behind them is not split."""
    return F.array_join(F.slice(F.array_remove(F.split(F.lower(text), "\\s+", TITLE_WORDS + 2), ""), 1, TITLE_WORDS), " ")


def domains_of(text: Column | str) -> Column:
    """The terms of BOOSTS that the text holds."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(t)), F.lit(t)) for t in BOOSTS]))


def grams_of(text: Column, size: int) -> Column:
    """All distinct runs of that many characters."""
    n = F.length(text) - size + 1
    return F.array_distinct(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size))))


def bonus(domains: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BOOSTS.items() for x in pair])
    return F.aggregate(domains, F.lit(0.0), lambda s, t: s + F.element_at(table, t))


def inverted(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Batches (row, terms) -> (term, n, rows): the rows of each term in up to block_rows documents of a batch. terms: an array, or a text whose words are meant."""
    for batch in batches:
        for start in range(0, batch.num_rows, block_rows):
            b = batch.slice(start, block_rows)
            terms, row = b["terms"], b["row"].to_numpy()
            if not pa.types.is_list(terms.type):
                terms = pc.ascii_split_whitespace(terms)
            at = np.repeat(np.arange(len(row)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            flat = terms.flatten()
            some = pc.greater(pc.binary_length(flat), 0)
            coded = flat.filter(some).dictionary_encode()
            key = np.sort(coded.indices.to_numpy().astype(np.int64) * len(row) + at[some.to_numpy(zero_copy_only=False)])
            key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
            n = np.bincount(key // len(row), minlength=len(coded.dictionary))
            rows = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(row[key % len(row)]))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64()), rows], names=["term", "n", "rows"])


def words_shared(text: str, asked: list[list[str]]) -> list[int]:
    """How many words of each list the text holds; its words are split once for all."""
    words = set(re.split(r"[ \t\n\x0b\f\r]+", text))
    return [sum(w in words for w in some) for some in asked]


class Postings:
    def __init__(self, spark: SparkSession, path: str, block_rows: int = 1 << 16):
        self.spark, self.base, self.block_rows = spark, path, block_rows
        self._tables: dict[str, DataFrame] = {}

    def build(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> Postings:
        """Index all documents with a text. Of an id that occurs twice each row is a hit."""
        some = dealt(docs.where(F.col(text).isNotNull()).select(id, text))
        some.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.lower(text).alias("text"), head_of(text).alias("head"), domains_of(text).alias("domains")).write.parquet(f"{self.base}/documents")
        block_rows = self.block_rows
        grams = F.concat(*[grams_of(F.col("head"), n) for n in (1, 2, 3)])
        for kind, terms in (("word", F.col("text")), ("gram", grams), ("domain", F.col("domains"))):
            small_batches(self.documents().select("row", terms.alias("terms"))).mapInArrow(lambda batches: inverted(batches, block_rows), "term string, n long, rows array<long>").write.parquet(f"{self.base}/{kind}")
        return self

    def _table(self, name: str) -> DataFrame:
        """Read once, so that schemas are looked up once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.base}/{name}")
        return self._tables[name]

    def documents(self) -> DataFrame:
        return self._table("documents")

    def rows_of(self, terms: DataFrame, kind: str = "word") -> DataFrame:
        """terms (qid, term) -> (qid, row) of every document that holds a term, once for each."""
        return self._table(kind).join(terms.select("qid", "term"), "term").select("qid", F.explode("rows").alias("row"))

    def frequency(self, terms: DataFrame, kind: str = "word") -> DataFrame:
        """terms (term) -> (term, df) of those that the index holds."""
        return self._table(kind).select("term", "n").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))

    def score(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """Exact scores (qid, id, score) of (qid, row). A document is read once for all its queries."""
        c = F.col
        shared = F.udf(lambda text, asked: words_shared(text, asked), "array<int>")
        wanted = pairs.select("qid", "row").join(queries.select("qid", "asked", c("domains").alias("wanted")), "qid")
        wanted = self._kept(wanted.groupBy("row").agg(F.collect_list(F.struct("qid", "asked", "wanted")).alias("queries")))
        both = self.documents().join(wanted, "row").select("id", "head", "domains", "queries", shared("text", "queries.asked").alias("n"))
        each = both.select("id", "head", "domains", F.explode(F.arrays_zip("queries", "n")).alias("x")).select("id", "head", "domains", "x.queries.*", "x.n")
        total = c("n") / F.size("asked") + bonus(F.array_intersect("domains", "wanted")) + self._title()
        return each.select("qid", "id", F.least(F.lit(1.0), total).alias("score"))

    def _title(self) -> Column:
        return F.when(F.exists("asked", lambda w: F.contains(F.col("head"), w)), F.lit(TITLE)).otherwise(0.0)

    def search(self, queries: DataFrame, k: int, seeds: int = 20) -> DataFrame:
        """queries (qid, query) -> (qid, id, score, rank): share of query words in the text, with bonuses for shared domain terms and for a query word within the first ten words; at most 1, above 0 only, ties to the smaller id."""
        c = F.col
        asked = queries.select("qid", F.array_distinct(words_of("query")).alias("asked"), domains_of("query").alias("domains")).where(F.size("asked") > 0)
        asked = self._kept(asked.withColumn("most_bonus", TITLE + bonus(c("domains"))))
        terms = asked.select("qid", F.size("asked").alias("m"), "most_bonus", F.explode("asked").alias("term"))
        rarity = Window.partitionBy("qid").orderBy("df", "term")
        known = terms.join(self.frequency(terms), "term").withColumns({
            "r": F.row_number().over(rarity),
            "before": F.coalesce(F.sum("df").over(rarity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "held": F.count("*").over(Window.partitionBy("qid")),
        })
        known_terms = self._kept(known)
        rare = known_terms.where((c("before") < k) | (c("before") + c("df") <= seeds * k))
        first = self._kept(self.rows_of(rare).distinct())
        kth = self._kept(self._kth(self.score(first, asked), k))
        # the rarest words, until a document without any of them stays below the threshold
        bound = known_terms.join(kth, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        needed = bound.withColumn("open", (c("held") - (c("r") - 1)) / c("m") + c("most_bonus") >= c("least") - CLOSE).where("open")
        opened = self._kept(needed.withColumn("closed", c("held") - F.count("*").over(Window.partitionBy("qid"))).select("qid", "term", "m", "most_bonus", "least", "closed"))
        near = self._kept(self._near(opened, asked))
        # the most promising ones set a threshold that the others have to reach, with a smaller id where no score is better
        promise = Window.partitionBy("qid").orderBy(F.desc(F.least(F.lit(1.0), "high")), "id")
        first = self._kept(near.withColumn("n", F.row_number().over(promise)).where(c("n") <= seeds * k).select("qid", "row"))
        best = self._kth(self.score(first, asked), k).select("qid", c("least").alias("better"), "last")
        limits = self._kept(asked.select("qid", "most_bonus").join(kth.select("qid", "least"), "qid", "left").join(best, "qid", "left").select("qid", "most_bonus", F.coalesce(F.greatest("least", "better"), F.lit(0.0)).alias("least"), F.when(c("better") == 1.0, c("last")).alias("last")))
        likely = near.join(limits, "qid").where((c("high") >= c("least") - CLOSE) & (c("last").isNull() | (c("id") <= c("last")))).select("qid", "row")
        # queries that bonuses alone could answer
        loose = limits.where(c("least") <= c("most_bonus") + CLOSE)
        if loose.limit(1).count():
            likely = likely.unionByName(self._with_bonus(asked.join(loose.select("qid"), "qid", "left_semi")))
        likely = self._kept(likely.distinct())
        ranks = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return self.score(likely, asked).where("score > 0").withColumn("rank", F.row_number().over(ranks)).where(c("rank") <= k)

    def _kth(self, scores: DataFrame, k: int) -> DataFrame:
        """(qid, least, last): score and id of the k-th best of each query that has as many."""
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        ranked = scores.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
        return ranked.where(F.col("n") == k).select("qid", F.col("score").alias("least"), F.col("id").alias("last"))

    def _near(self, opened: DataFrame, asked: DataFrame) -> DataFrame:
        """(qid, row, id, high) of the documents in opened lists that may reach the threshold; high: all words of closed lists and the document's own bonuses counted."""
        c = F.col
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # said, since pairs are small and what is done with them isn't
        counted = self.rows_of(opened).repartition(tasks, "row").groupBy("row", "qid").agg(F.count("*").alias("n"))
        limits = opened.select("qid", "m", "most_bonus", "least", "closed").distinct().join(asked.select("qid", "asked", c("domains").alias("wanted")), "qid")
        within = lambda extra: (c("n") + c("closed")) / c("m") + extra >= c("least") - CLOSE
        shared = sum((F.when(F.array_contains("domains", t) & F.array_contains("wanted", t), F.lit(x)).otherwise(0.0) for t, x in BOOSTS.items()), F.lit(0.0))
        both = counted.join(limits, "qid").where(within(c("most_bonus"))).join(self.documents().select("row", "id", "head", "domains"), "row")
        both = both.withColumn("shared", shared).where(within(c("shared") + TITLE)).withColumn("bonus", c("shared") + self._title()).where(within(c("bonus")))
        return both.select("qid", "row", "id", ((c("n") + c("closed")) / c("m") + c("bonus")).alias("high"))

    def _with_bonus(self, asked: DataFrame) -> DataFrame:
        """(qid, row) of documents that may have a bonus: a shared domain term, or the rarest n-gram of a query word in the head."""
        c = F.col
        shared = self.rows_of(asked.select("qid", F.explode("domains").alias("term")), "domain")
        words = asked.select("qid", F.explode("asked").alias("word"))
        size = F.least(F.length("word"), F.lit(3))
        grams = words.select("word", F.explode(F.when(size == 3, grams_of(c("word"), 3)).when(size == 2, grams_of(c("word"), 2)).otherwise(grams_of(c("word"), 1))).alias("term")).distinct()
        counted = grams.join(self.frequency(grams, "gram"), "term", "left")
        order = Window.partitionBy("word").orderBy(c("df").asc_nulls_first(), "term")  # a gram that no head holds comes first, and ends the word
        rarest = counted.withColumn("r", F.row_number().over(order)).where("r = 1 and df is not null").select("word", "term")
        inside = self.rows_of(words.join(rarest, "word").select("qid", "term").distinct(), "gram")
        return shared.unionByName(inside)

    def _kept(self, df: DataFrame) -> DataFrame:
        """Written and read again: what several steps read, with a size that joins are chosen by."""
        at = f"{self.base}/queries-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


class FieldIndex:
    """Values of fields -> ids, for filters that never read the documents."""

    def __init__(self, spark: SparkSession, path: str, block_rows: int = 1 << 16):
        self.spark, self.base, self.block_rows = spark, path, block_rows

    def build(self, docs: DataFrame, fields: list[str], id: str = "doc_id") -> FieldIndex:
        """Each value of a field, and each element of an array, is a key. Nulls are not indexed."""
        kinds = dict(docs.dtypes)
        numeric = lambda f: kinds[f].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")

        def keys(f: str) -> Column:
            number = (lambda v: v.cast("double")) if numeric(f) else (lambda v: F.lit(None).cast("double"))
            every = F.coalesce(F.col(f), F.array().cast(kinds[f])) if kinds[f].startswith("array") else F.array(F.col(f))
            return F.transform(every, lambda v: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), number(v).alias("number")))

        values = [keys(f) for f in fields]
        blocks = max(1, -(-docs.count() // self.block_rows))
        rows = docs.select(F.col(id).alias("id"), F.explode(F.flatten(F.array(*values))).alias("v")).select("id", "v.*", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).where("value is not null")
        lists = rows.groupBy("field", "value", "number", "block").agg(F.collect_set("id").alias("ids"))
        lists.sortWithinPartitions("number", "value").write.partitionBy("field").parquet(f"{self.base}/fields")
        return self

    def filter(self, criteria: dict[str, object]) -> DataFrame:
        """Ids (id) of the documents that meet the criteria of all fields. A criterion is a value, or operators that must all hold: $gte, $lte (numbers), $in, $contains (text, in any case)."""
        if not criteria:
            return self._rows().select(F.explode("ids").alias("id")).distinct()
        tests = {
            "$gte": lambda x: F.col("number") >= x,
            "$lte": lambda x: F.col("number") <= x,
            "$in": lambda x: F.col("value").isin([str(v) for v in x]),
            "$contains": lambda x: F.col("number").isNull() & F.contains(F.lower("value"), F.lit(x.lower())),
        }
        hits = None
        for field, wanted in criteria.items():
            rules = wanted if isinstance(wanted, dict) else {"$in": [wanted]}
            if unknown := set(rules) - set(tests):
                raise ValueError(f"unknown operator: {sorted(unknown)}")
            # each rule on its own, since another element of an array may meet the next one
            for n, (rule, x) in enumerate(rules.items()):
                found = self._rows().where((F.col("field") == field) & tests[rule](x)).select(F.explode("ids").alias("id")).distinct().withColumn("rule", F.lit(f"{field} {n}"))
                hits = found if hits is None else hits.unionByName(found)
        n_rules = sum(len(w) if isinstance(w, dict) else 1 for w in criteria.values())
        return hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == n_rules).select("id")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/fields")
