"""What the findings of the third round showed, on tables made for it."""

import datetime

import duckdb
import numpy as np
import pytest

from lodestone.catalog_queries import oracle_sql, queries


def against_sql(spark, folder, name):
    """(rows of the query, rows of its SQL) on the tables in the folder."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    plain = lambda rows: sorted([tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    return plain(tuple(r) for r in queries()[name](spark, str(folder)).select(*names).collect()), plain(want.fetchall())


def test_dates_keep_fractions_of_seconds_and_unknown_types_are_no_match(spark, tmp_path):
    day = datetime.datetime(2024, 1, 15)
    rows = [(1, day, "click"), (2, day + datetime.timedelta(microseconds=1), "click"), (3, day + datetime.timedelta(days=1), None), (4, day + datetime.timedelta(days=1), "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got, want = against_sql(spark, tmp_path, "filter_dates")
    assert got == want == [(2,)]


def test_products_name_few_pairs_and_miss_none():
    from lodestone.operators.search import Best, _distances, _near

    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 16)) + 50  # far from the origin, so that products round
    x[1000:1100] = x[7]
    q, ids = x[:40], np.arange(3000)
    for metric in ("l2", "ip"):
        best, n = Best(len(q), 3), 0
        for a in range(0, 3000, 500):
            for i, j, far in _near(best, q, x[a : a + 500], metric, ids[:40], ids[a : a + 500]):
                best.add(i, far, id=a + j)
                n += len(i)
            best.rows()
        far = _distances(q, x, metric)
        far[np.arange(40), np.arange(40)] = np.inf
        want = [(i, j) for i in range(40) for j in np.lexsort((ids, far[i]))[:3]]
        assert list(zip(best.rows()["query"], best.rows()["id"], strict=True)) == want
        assert n < 40 * 3000 / 10


def test_the_index_finds_rows_that_no_link_leads_to(spark, tmp_path):
    from lodestone.operators.vector_index import VectorIndex

    r = np.random.default_rng(2)
    x = r.normal(size=(600, 24))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, collection string, embedding array<double>")
    index = VectorIndex(spark, f"file://{tmp_path}/i", part_rows=600, degree=2, candidates=2, entry_every=600)
    index.build(df)
    index.delete(spark.range(5))
    asked = df.where("id % 20 = 1").selectExpr("id qid", "embedding query_embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(1, 600, 20) for i in 5 + np.argsort(-(unit[5:] @ unit[q]), kind="stable")[:10]}
    assert {(row["qid"], row["id"]) for row in index.search(asked, 10, beam=10).collect()} == want
    assert {(row["qid"], row["id"]) for row in index.search(asked, 10, beam=10, exact=False).collect()} != want


def test_inner_product_search_on_rows_that_codes_cannot_tell_apart(spark):
    from lodestone.llm.ann import search

    r = np.random.default_rng(0)
    x = np.repeat(r.normal(size=(2, 32)), 1500, axis=0) + r.normal(0, 0.01, (3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in search(df, top=20, every=100, rerank=40).collect():
        got.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        assert [got[q][k] for k in range(1, 21)] == np.argsort(-s, kind="stable")[:20].tolist()


def test_lexical_search_in_blocks_of_queries(spark):
    from lodestone.operators import search as E

    r = np.random.default_rng(4)
    word = lambda: "w" + "abcdefgh"[r.integers(8)] * int(r.integers(1, 4))
    docs = [(i, " ".join(word() for _ in range(r.integers(0, 30))) + (" neural" if i % 5 == 0 else "")) for i in range(300)] + [(300, None)]
    asked = [(q, " ".join(word() for _ in range(6)) + (" neural" if q % 2 else "")) for q in range(40)] + [(40, " ")]
    want = []
    for q, text in asked:
        qw = set(text.split())
        scores = []
        for i, t in docs:
            if t is not None and qw:
                s = len(qw & set(t.split())) / len(qw) + (0.3 if "neural" in text and "neural" in t else 0) + (0.2 if any(w in " ".join(t.split()[:10]) for w in qw) else 0)
                scores.append((-round(min(1.0, s), 9), i))
        want += [(q, i, k) for k, (s, i) in enumerate(sorted(scores)[:5], 1) if s < 0]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, query string")
    for block in (1024, 7, 2):  # one block, several in a task, more than are broadcast
        got = E.lexical_search(d, q, 5, block_queries=block)
        assert sorted((x["qid"], x["id"], x["rank"]) for x in got.collect()) == sorted(want)


def _documents(spark, folder, ids, files):
    rows = [(i, f"Text number {i % 90} of the table. " * (1 + i % 5), "en", f"src{i % 3}", 1) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(str(folder / "documents.parquet"))


def _files(folder):
    import pyarrow.parquet as pq

    return [n for p in folder.rglob("*.parquet") if (n := pq.ParquetFile(p).metadata.num_rows)]


def test_a_batch_of_replicated_sinks_is_more_than_one_task(spark, tmp_path, monkeypatch):
    from lodestone.plans import index_queries as I

    _documents(spark, tmp_path, [i for i in range(400) if i % 4 != 2], 12)  # no row has remainder 2
    monkeypatch.setattr(I, "scratch", lambda spark: f"file://{tmp_path}/scratch")
    got, want = against_sql(spark, tmp_path, "replicated_sinks")
    assert got == want and len(want) == 4
    for place in ("in", "a", "b"):
        found = _files(tmp_path / "scratch" / place)
        assert sum(found) == 300 and max(found) < 100, place


@pytest.mark.parametrize("name", ["stream_keep_first", "stream_ingest"])
def test_files_of_a_stream_are_as_many_as_tasks_read_the_table(spark, tmp_path, monkeypatch, name):
    from lodestone.plans import source_queries as Q

    _documents(spark, tmp_path, range(400), 12)
    monkeypatch.setattr(Q.io, "scratch", lambda spark: f"file://{tmp_path}/scratch")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got, want = against_sql(spark, tmp_path, name)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == want and want
    found = _files(tmp_path / "scratch" / "in")
    assert sum(found) == 400 and max(found) < 70


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    from lodestone.operators.encoding import embed

    class Counting:
        dimension = 1

        def encode(self, texts):
            return [[float(len(texts))]] * len(texts)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    texts = spark.range(30, numPartitions=1).selectExpr("id", "repeat('x', 1 << 20) content")
    assert embed(texts, Counting(), batch=1000).selectExpr("max(embedding[0])").first()[0] <= 9
    _documents(spark, tmp_path, range(20), 1)
    for name in ("clean_text_nfkc", "frontmatter_problems", "markdown_sections", "near_dup_pairs"):
        spark.conf.set(key, "64m")
        queries()[name](spark, str(tmp_path))
        assert spark.conf.get(key) == f"{8 << 20}b", name


def test_a_timer_of_a_session_reads_and_writes_state_once():
    import pandas as pd

    from lodestone.streaming.sessions import SessionProcessor

    asked = []

    class State:
        rows: list = []

        def __getattr__(self, name):
            def call(*rows):
                asked.append(name)
                if name == "appendList":
                    self.rows = self.rows + rows[0]
                elif name == "put":
                    self.rows = rows[0]
                elif name == "clear":
                    self.rows = []
                return iter(self.rows) if name == "get" else bool(self.rows)

            return call

    class Handle:
        getListState = getValueState = lambda self, name, schema: State()
        registerTimer = lambda self, at: None

    class Times:
        getCurrentWatermarkInMs = lambda self: self.now

    p, times, found = SessionProcessor(1000), Times(), []
    p.init(Handle())
    list(p.handleInputRows((1,), iter([pd.DataFrame({"at": pd.to_datetime([0, 500, 5000, 5100, 9000], unit="ms"), "kind": list("abccd")})]), times))
    for times.now in (1000, 5050, 100_000):
        asked.clear()
        for pdf in p.handleExpiredTimer((1,), times, None):
            found += list(zip(pdf["n"], pdf["kinds"], strict=True))
        assert asked in (["get", "put"], ["get", "clear"])
    assert found == [(2, "a>b"), (2, "c"), (1, "d")]
