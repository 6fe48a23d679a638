"""What the findings of the fourth round showed, on tables made for it."""

import numpy as np
from test_round3 import against_sql


def documents(spark, folder, rows):
    """documents.parquet of rows (doc_id, text[, lang, source]), in one file."""
    rows = [r if len(r) == 4 else (*r, "en", "src1") for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(folder / "documents.parquet"))


def test_texts_that_are_null_or_empty_have_no_category(spark, tmp_path):
    documents(spark, tmp_path, [(1, None), (2, ""), (3, "ai " * 20), (4, "no word of it, " * 20), (5, "research market " + "x" * 20_000)])
    got, want = against_sql(spark, tmp_path, "categorise")
    assert got == want
    assert got[:2] == [(1, "general", 0.4), (2, "general", 0.4)]


def test_documents_come_back_from_json_and_csv_as_they_were(spark, tmp_path):
    odd = [None, "", " ", " a ", "a\t", "\r\n", "a\rb\r", 'a"', '"', '"\0', "\0", "\\", "a,b", "\n", "null", "__HIVE_DEFAULT_PARTITION__", "a/b=c", "..", "é" * 200, "x \n"]
    rows = [(i, text, odd[i % 7], source) for i, (text, source) in enumerate([*[(t, s) for t in odd for s in odd[:4]], *[("x", s) for s in odd]])]
    documents(spark, tmp_path, rows)
    got, want = against_sql(spark, tmp_path, "export_import")
    assert got == want


def test_json_texts_have_no_longest_length(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestone.sources import io

    io.write_json(spark.range(1).select("id", F.repeat(F.lit("ab c "), 4_100_000).alias("text")), f"{tmp_path}/a.json")
    assert io.read_any(spark, f"{tmp_path}/a.json", "id long, text string").select("id", F.length("text")).first()[:] == (0, 20_500_000)


def test_csv_files_of_other_tools_are_read_as_before(spark, tmp_path):
    from lodestone.sources import io

    (tmp_path / "a.csv").write_bytes(b'id,text,tag\r\n1,"a\nb",x\r\n2,,"y ""z"""\r\n')
    assert [tuple(r) for r in io.read_any(spark, f"{tmp_path}/a.csv", "id long, text string, tag string").collect()] == [(1, "a\nb", "x"), (2, None, 'y "z"')]
    (tmp_path / "b.json" / "tag=x").mkdir(parents=True)
    (tmp_path / "b.json" / "tag=x" / "f.json").write_text('{"id": 1}\n')
    assert [tuple(r) for r in io.read_any(spark, f"{tmp_path}/b.json", "id long, tag string").collect()] == [(1, "x")]


def _lexical(docs, asked, k):
    """(qid, id, rank) by plain loops."""
    out = []
    for q, text in asked:
        qw = set(text.split())
        scores = []
        for i, t in docs if qw else []:
            head = " ".join(t.split()[:10])
            scores.append((-round(min(1.0, len(qw & set(t.split())) / len(qw) + 0.3 * ("neural" in text and "neural" in t) + 0.2 * any(w in head for w in qw)), 9), i))
        out += [(q, i, n) for n, (s, i) in enumerate(sorted(scores)[:k], 1) if s < 0]
    return sorted(out)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_thousands_of_queries_meet_the_documents_in_one_pass(spark):
    from lodestone.operators import search as E

    r = np.random.default_rng(8)
    word = lambda: "abcdefgh"[r.integers(8)] * int(1 + r.integers(12) ** 2 // 20) + str(r.integers(10) ** 3 // 40)
    docs = [(i, " ".join(word() for _ in range(r.integers(0, 40))) + " neural" * (i % 5 == 0)) for i in range(500)]
    asked = [(q, " ".join(word() for _ in range(r.integers(1, 9))) + " neural" * (q % 2)) for q in range(5001)] + [(9000, " \t "), (9001, "zz not there"), (9002, None)]
    got = E.lexical_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string"), 4)
    assert "CoGroups" not in _plan(got)  # documents are not shuffled to blocks of queries
    some = [a for a in asked if a[1] is not None and (a[0] % 17 == 0 or a[0] >= 9000)]
    assert sorted((x["qid"], x["id"], x["rank"]) for x in got.collect() if x["qid"] % 17 == 0 or x["qid"] >= 9000) == _lexical(docs, some, 4)


def test_only_documents_that_may_be_among_the_best_get_their_bonuses(monkeypatch):
    import pyarrow as pa

    from lodestone.operators import search as E

    r = np.random.default_rng(9)
    vocabulary = [f"w{i}x" for i in range(3000)]
    texts = [" ".join(vocabulary[int(3000 * r.random() ** 3)] for _ in range(60)) for _ in range(6000)]
    words = [sorted(set(texts[i].split())) for i in range(0, 6000, 300)]
    asked = pa.table({"qid": range(len(words)), "words": pa.array(words), "terms": [[False] * 3] * len(words)})
    index = E._QueryWords(asked, 1024)
    seen, title = [], E._QueryWords.title
    monkeypatch.setattr(E._QueryWords, "title", lambda self, head: (seen.append(head), title(self, head))[1])
    pools = [E.Best(b.n, 5) for _, b in index.blocks]
    batch = pa.record_batch({"id": range(6000), "text": texts, "head": [" ".join(t.split()[:10]) for t in texts], "terms": [[False] * 3] * 6000})
    for a in range(0, 6000, 500):
        index.found(batch.slice(a, 500), pools)
    rows = pools[0].rows()
    assert sorted((q, i, n) for q in range(len(words)) for n, i in enumerate(rows["id"][rows["query"] == q], 1)) == _lexical(list(enumerate(texts)), [(q, " ".join(w)) for q, w in enumerate(words)], 5)
    assert len(seen) < 3000


def test_texts_that_are_no_queries_are_not_split_to_find_them(spark):
    from lodestone.operators import search as E

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    asked = docs.join(spark.range(0, 30, 10).withColumnRenamed("id", "doc_id"), "doc_id").selectExpr("doc_id as qid", "text as query")
    gathered = []
    limit = type(asked).limit
    type(asked).limit = lambda self, n: (gathered.append(self), limit(self, n))[1]
    try:
        E.lexical_search(docs, asked, 2)
    finally:
        type(asked).limit = limit
    assert "split" in _plan(gathered[0])
    assert not any("Filter" in line and "split" in line for line in _plan(gathered[0]).split("Optimized Logical Plan")[1].splitlines())


def test_thousands_of_vectors_are_asked_for_in_one_pass(spark):
    from lodestone.operators import search as E

    r = np.random.default_rng(10)
    x, q = r.normal(size=(300, 4)), r.normal(size=(5000, 4))
    rows = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, collection string, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, query_embedding array<double>")
    got = E.top_k(rows, asked, 3)
    assert "CoGroups" not in _plan(got)
    near = np.argsort(1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T, axis=1, kind="stable")[:, :3]
    assert sorted((r["qid"], r["rank"], r["id"]) for r in got.collect()) == [(i, n + 1, near[i, n]) for i in range(5000) for n in range(3)]
