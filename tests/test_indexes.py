"""Vector index, postings, joins of ranges and prefixes, scorers, sketches and the table function, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def nearest(rows, q, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    far = sorted((round(1 - float(unit(v) @ unit(q)), 12), i) for i, v in rows)
    return [i for _, i in far[:k]]


def test_vector_index_is_built_extended_and_searched(spark, tmp_path):
    from lodestone.operators.vector_index import VectorIndex

    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 24))
    x[100:110] = x[100]  # ties
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, "a", None), (2001, "a", [0.0] * 24), (2002, "a", [float("nan")] * 24), (None, "a", x[0].tolist())]
    df = spark.createDataFrame(rows + odd, "id long, collection string, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/i", part_rows=200, degree=12, entry_every=16)
    asked = spark.createDataFrame([(q, x[q].tolist()) for q in range(0, 900, 30)] + [(9999, [0.0] * 24), (9998, None)], "qid long, query_embedding array<double>")

    def recall(live, version=None):
        got = {}
        for r in index.search(asked, 10, beam=64, version=version).collect():
            got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
        assert set(got) == set(range(0, 900, 30)) and all(sorted(g) == list(range(1, 11)) for g in got.values())
        return np.mean([len(set(g.values()) & set(nearest([(i, v) for i, _, v in rows if live(i)], x[q], 10))) / 10 for q, g in got.items()])

    assert index.build(df.where("id < 500 or id >= 2000 or id is null")) == 1
    assert recall(lambda i: i < 500) >= 0.97
    parts = index.table.entry().folders
    assert index.insert(df.where("id >= 500 and id < 2000")) == 2
    assert recall(lambda i: True) >= 0.97 and len(index.table.entry().folders) > len(parts)
    assert index.delete(spark.range(0, 90, 30)) == 3
    assert recall(lambda i: i not in (0, 30, 60)) >= 0.97
    assert recall(lambda i: i < 500, version=1) >= 0.97  # older versions stay
    tied = index.search(spark.createDataFrame([(1, x[100].tolist())], "qid long, query_embedding array<double>"), 5).orderBy("rank").collect()
    assert [r["id"] for r in tied] == [100, 101, 102, 103, 104]


def test_an_insert_touches_parts_with_room_only(spark, tmp_path):
    from lodestone.operators.vector_index import VectorIndex

    make = lambda a, b: spark.range(a, b).select("id", F.lit("c").alias("collection"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    index = VectorIndex(spark, f"file://{tmp_path}/i", part_rows=60, degree=4)
    index.build(make(0, 100))
    old = index.table.entry()
    index.insert(make(100, 105))
    new = index.table.entry()
    assert len(set(old.folders) & set(new.folders)) == len(old.folders) - 1 and index.table.read().count() == 105
    index.insert(make(0, 0))
    empty = VectorIndex(spark, f"file://{tmp_path}/e")
    assert empty.build(make(0, 0)) == 1 and empty.search(make(0, 3).select(F.col("id").alias("qid"), F.col("embedding").alias("query_embedding"))).count() == 0


BOOSTS = {"neural": 0.3, "machine learning": 0.4, "algorithm": 0.2}


def plain_lexical(docs, queries, k):
    out = []
    for qid, q in queries:
        words = set((q or "").lower().split())
        if not words:
            continue
        hits = []
        for i, t in docs:
            if t is None:
                continue
            held = t.lower().split()
            s = len(words & set(held)) / len(words) + sum(b for w, b in BOOSTS.items() if w in q.lower() and w in t.lower())
            s += 0.2 if any(w in " ".join(held[:10]) for w in words) else 0
            if s > 0:
                hits.append((-round(min(s, 1.0), 9), i))
        out += [(qid, i, -s, n + 1) for n, (s, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 10), (3, 100)])
def test_pruned_search_equals_scoring_all(spark, tmp_path, seed, k):
    from lodestone.operators.postings import Postings

    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(300)] + ["neural", "machine", "learning", "algorithm", "é", "a", "ab", "cab"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rnd.randint(1, 40))) for i in range(150)] + [(500, None), (501, ""), (502, "  "), (503, "xaby z"), (504, text(3000)), (505, docs_text := text(12)), (506, docs_text)]
    queries = [(i, text(rnd.randint(1, 8))) for i in range(25)] + [(90, docs_text), (91, ""), (92, None), (93, "nowhere"), (94, "ab"), (95, "b"), (96, "neural ALGORITHM zz"), (97, "w1 w1 w1")]
    index = Postings(spark, f"{tmp_path}/p", block_rows=40).build(spark.createDataFrame(docs, "doc_id long, text string"))
    got = index.search(spark.createDataFrame(queries, "qid long, query string"), k, seeds=2).collect()
    assert sorted((r["qid"], r["id"], round(r["score"], 9), r["rank"]) for r in got) == plain_lexical(docs, queries, k)


def test_search_opens_few_lists(spark, tmp_path):
    """Where the k best share rare words, the list of the word that all documents hold stays closed."""
    from lodestone.operators.postings import Postings

    docs = [(i, f"common common{i % 3} rare{i // 10} only{i}") for i in range(200)]
    p = Postings(spark, f"{tmp_path}/p").build(spark.createDataFrame(docs, "doc_id long, text string"))
    scored, plain = [], p.score
    p.score = lambda pairs, asked: scored.append(pairs.count()) or plain(pairs, asked)
    got = p.search(spark.createDataFrame([(1, "rare3 only33 only35 only37 zz common")], "qid long, query string"), 3).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [33, 35, 37] and max(scored) < 60


def test_search_scores_few_where_bounds_are_wide(spark, tmp_path):
    """Documents of the rarest word are poor and set a low threshold, and many copies score 1: neither makes the search score all of them."""
    from lodestone.operators.postings import Postings

    rnd = random.Random(4)
    head, common = "x " * 10, [f"c{i}" for i in range(10)]
    docs = [(i, head + " ".join(c for c in common if rnd.random() < 0.5)) for i in range(3, 400)] + [(i, head + "seed") for i in range(3)]
    docs += [(i, "neural machine learning all the same " + " ".join(f"o{j}" for j in range(i % 7))) for i in range(900, 400, -1)] + [(401, "neural"), (401, "machine learning all x")]
    queries = [(1, "seed " + " ".join(common)), (2, "neural machine learning all")]
    p = Postings(spark, f"{tmp_path}/p", block_rows=64).build(spark.createDataFrame(docs, "doc_id long, text string"))
    scored, plain = [], p.score
    p.score = lambda pairs, asked: scored.append({r["qid"]: r["count"] for r in pairs.groupBy("qid").count().collect()}) or plain(pairs, asked)
    got = p.search(spark.createDataFrame(queries, "qid long, query string"), 3, seeds=2).collect()
    assert sorted((r["qid"], r["id"], round(r["score"], 9), r["rank"]) for r in got) == plain_lexical(docs, queries, 3)
    assert scored[-1][1] < 40 and scored[-1][2] < 40


def test_field_index(spark, tmp_path):
    from lodestone.operators.postings import FieldIndex

    rows = [(1, "Alpha", 5, ["x", "y"]), (2, "beta", 10, ["y"]), (3, None, 15, []), (4, "alphabet", None, None), (5, "10", 10, ["x", None])]
    f = FieldIndex(spark, f"{tmp_path}/f", block_rows=2).build(spark.createDataFrame(rows, "doc_id long, name string, n int, tags array<string>"), ["name", "n", "tags"])
    ask = lambda **c: sorted(r["id"] for r in f.filter(c).collect())
    assert ask(name="beta") == [2] and ask(n=10) == [2, 5] and ask(tags="x") == [1, 5]
    assert ask(n={"$gte": 10, "$lte": 12}) == [2, 5] and ask(name={"$contains": "ALPHA"}) == [1, 4] and ask(tags={"$in": ["x", "y"]}) == [1, 2, 5]
    assert ask(n={"$gte": 5}, tags="y", name={"$contains": "a"}) == [1, 2] and ask(other=1) == [] and ask() == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="unknown operator"):
        ask(n={"$near": 1})


def test_contained_ranges(spark):
    from lodestone.operators.intervals import contained

    rnd = random.Random(4)
    outer = [(d, k, a, a + rnd.choice([0, 1, 3, 7, 50, 400])) for d in ("p", "q") for k, a in enumerate(rnd.randint(0, 500) for _ in range(60))]
    inner = [(rnd.choice(["p", "q", "r"]), a, a + rnd.randint(0, 20), n) for n, a in enumerate(rnd.randint(0, 520) for _ in range(200))]
    inner += [inner[0], (None, 1, 2, 900), ("p", None, 2, 901)]
    want = []
    for d, a, b, n in inner:
        held = [(oe - os, k) for od, k, os, oe in outer if od == d and a is not None and os <= a and b <= oe]
        if held:
            want.append((d, a, b, n, min(held)[1]))
    got = contained(spark.createDataFrame(inner, "doc string, start long, end long, n int"), spark.createDataFrame(outer, "doc string, outer_id int, outer_start long, outer_end long"), "doc")
    assert sorted(map(tuple, got.select("doc", "start", "end", "n", "outer_id").collect())) == sorted(want)


def test_contained_grows_with_the_units_of_one_document(spark):
    """100,000 units in 5,000 sections of one document, which nest: no join makes more than a few rows a unit."""
    from lodestone.operators.intervals import contained

    units = spark.range(100_000).selectExpr("id div 1000000 doc", "id * 10 start", "id * 10 + 8 end")
    sections = spark.range(5000).selectExpr("id div 1000000 doc", "id outer_id", "id * 200 outer_start", "id * 200 + 200 outer_end").unionByName(spark.range(50).selectExpr("id div 1000000 doc", "10000 + id outer_id", "id * 20000 outer_start", "id * 20000 + 20000 outer_end"))
    df = contained(units, sections, "doc")
    got = df.selectExpr("count(*) n", "sum(int(outer_id = floor(start / 200))) fine").first()
    assert (got["n"], got["fine"]) == (100_000, 100_000)
    assert "CartesianProduct" not in (plan := df._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_overlapping_ranges(spark):
    from lodestone.operators.intervals import overlapping

    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), n, a, a + rnd.randint(0, 60)) for n, a in enumerate(rnd.randint(-200, 200) for _ in range(120))]
    other = [(g, n, a, b) for g, n, a, b in rows if n % 2]
    got = overlapping(spark.createDataFrame(rows, "g string, id int, start int, end int"), spark.createDataFrame(other, "g string, other_id int, other_start int, other_end int"), "g", 25)
    want = [(g, n, m) for g, n, a, b in rows for h, m, c, e in other if g == h and a < e and b > c and a < b and c < e]
    assert sorted(map(tuple, got.select("g", "id", "other_id").collect())) == sorted(want)


def test_longest_prefix(spark):
    from lodestone.operators.projects import project_of

    roots = [("p1", "/a"), ("p2", "/a/b"), ("p0", "/a/b"), ("p3", "/é"), ("p4", "/a/b/c/d/e"), (None, "/n"), ("p5", None)]
    paths = [(1, "/a/x"), (2, "/a/b/x"), (3, "/é/f"), (4, "/q"), (5, None), (6, "/a"), (7, ""), (8, "/n/x"), (9, "/a/b/c/d/e/f")]
    df = project_of(spark.createDataFrame(paths, "id long, path string"), spark.createDataFrame(roots, "project string, root string"), "id", "path")
    assert dict(map(tuple, df.collect())) == {1: "p1", 2: "p0", 3: "p3", 4: None, 5: None, 6: "p1", 7: None, 8: None, 9: "p4"}
    many = spark.range(200_000).selectExpr("concat('p', id) project", "concat('/r', id, '/') root")
    big = project_of(spark.range(1000).selectExpr("id", "concat('/r', id * 7, '/file') path"), many, "id", "path")
    assert big.where("project = concat('p', id * 7)").count() == 1000 and "NestedLoop" not in big._jdf.queryExecution().toString()


def test_scorer_is_loaded_once_a_task_and_failures_stand_alone(spark, tmp_path):
    import math

    from lodestone.operators.scorers import rerank_by_model

    class Loud:
        """Counts how often it is loaded and fails on a text that says so."""

        def __init__(self, folder):
            self.folder = folder

        def load(self):
            import tempfile

            tempfile.mkstemp(dir=self.folder)

            def model(queries, texts):
                if any("fail" in t for t in texts):
                    raise RuntimeError("out of memory")
                return [None if "none" in t else float("nan") if "nan" in t else float(len(t)) - 4 for t in texts]

            return model

    texts = ["aa", "fail", "aaaaaa", "none", "nan", None, "aaa", "fail too", "a" * 5000] * 5
    hits = spark.createDataFrame([(1, k, k + 1, "q", t) for k, t in enumerate(texts)], "qid int, id int, rank int, query string, content string").coalesce(1)
    got = {r["id"]: r for r in rerank_by_model(hits, Loud(str(tmp_path)), batch=4, temperature=2.0).collect()}
    for k, t in enumerate(texts):
        want = 0.5 if t is None or t[:4] in ("fail", "none", "nan") else 1 / (1 + math.exp(-min((len(t) - 4) / 2, 700)))
        assert got[k]["rerank_score"] == pytest.approx(want, abs=1e-12)
    order = sorted(got.values(), key=lambda r: (-r["rerank_score"], r["rank"]))
    assert [r["new_rank"] for r in order] == list(range(1, len(texts) + 1)) and len(list(tmp_path.iterdir())) == 1
    assert rerank_by_model(hits, Loud(str(tmp_path)), top=3).count() == 3


def test_sketches_merge_within_their_rank_error(spark):
    from lodestone.functions import sketches as K
    from lodestone.functions.vectors import dimension_stats

    df = spark.range(60_000).selectExpr("id % 6 part", "id % 2 g", "cast(hash(id) % 100000 as double) x").unionByName(spark.createDataFrame([(0, 0, None), (1, 1, float("nan")), (7, 2, None)], "part long, g long, x double"))
    whole = K.merged(K.sketched(df, ["g", "part"], "x"), ["g"])
    rows = {r["g"]: r for r in whole.select("g", K.count("sketch").alias("n"), *[K.quantile("sketch", q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9)]).collect()}
    assert set(rows) == {0, 1} and all(r["n"] == 30_000 for r in rows.values())
    for g, r in rows.items():
        x = np.sort([v["x"] for v in df.where(f"g = {g} and x is not null and not isnan(x)").select("x").collect()])
        for q in (0.1, 0.5, 0.9):
            at = r[f"q{int(q * 100)}"]
            assert np.searchsorted(x, at, "left") / len(x) - K.RANK_ERROR <= q <= np.searchsorted(x, at, "right") / len(x) + K.RANK_ERROR
    assert K.sketched(df, ["g"], "x").where("sketch is null").count() == 1
    small = spark.createDataFrame([([float(k), 2.0],) for k in range(9)], "embedding array<double>")
    exact, rough = ({r["dim"]: r for r in dimension_stats(small, exact=e).collect()} for e in (True, False))
    assert exact[0]["median_x"] == rough[0]["median_x"] == 4.0 and exact[1]["max_x"] == rough[1]["q75"] == 2.0


def test_units_from_sql(spark):
    from lodestone.operators.parsing import unit_function, units

    docs = spark.createDataFrame([(1, "one\n\n- a\n- b\n\n> q"), (2, None), (3, ""), (4, "!! x\n\ntwo")], "doc_id long, text string")
    docs.createOrReplaceTempView("unit_docs")
    spark.udtf.register("units_of", unit_function())
    got = spark.sql("select doc_id, unit_index, kind, start, `end`, details from unit_docs, lateral units_of(text)")
    key = lambda r: (r["doc_id"], r["unit_index"], r["kind"], r["start"], r["end"], sorted(r["details"].items()))
    assert sorted(map(key, got.collect())) == sorted(map(key, units(docs.where("text is not null")).collect()))
    assert spark.sql("select * from unit_docs, lateral units_of(text, false)").columns == ["doc_id", "text", "unit_index", "kind", "start", "end"]
    spark.udtf.register("noted_units", unit_function({"note": lambda line: line.startswith("!!")}))
    assert [r["kind"] for r in spark.sql("select kind from unit_docs, lateral noted_units(text) where doc_id = 4").collect()] == ["note", "paragraph"]
    with pytest.raises(Exception, match="must be a text"):
        spark.sql("select * from unit_docs, lateral units_of(doc_id)").collect()
