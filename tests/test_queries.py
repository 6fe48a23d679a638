"""Registered queries against DuckDB on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from lodestone.catalog_queries import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v != v:
            return None
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        return round(float(v), 5) + 0.0 if isinstance(v, float) else v

    return sorted(([plain(v) for v in r] for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, str(DATA)).toPandas()
    if name not in oracle_sql():
        assert len(got.columns)
        return
    want = duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_match():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def frame(name):
    import pandas as pd

    return pd.read_parquet(DATA / f"{name}.parquet")


def test_compatibility_form_of_whole_texts(spark):
    import hashlib
    import re
    import unicodedata

    from lodestone.functions.text import MOJIBAKE

    want = []
    for r in frame("documents").itertuples():
        t = unicodedata.normalize("NFKC", re.sub("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", "", r.text))
        for bad in sorted(MOJIBAKE, key=len, reverse=True):
            t = t.replace(bad, MOJIBAKE[bad])
        t = re.sub("[ \\t\\n\\x0b\\f\\r]+", " ", t).strip(" ")
        if len(t) >= 10:
            want.append((r.doc_id, hashlib.md5(t.encode()).hexdigest(), len(t)))
    assert sorted((r["doc_id"], r["digest"], r["n"]) for r in queries()["clean_text_nfkc"](spark, str(DATA)).collect()) == sorted(want)


def plain_vector(text, dimension):
    import math
    import re
    import zlib

    h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())]
    h += [((a * 0x9E3779B1 + b) * 0x85EBCA77C2B2AE63 % 2**64) >> 32 for a, b in zip(h, h[1:], strict=False)]
    v = [0.0] * dimension
    for x in h:
        v[x % dimension] += 1.0 if x >> 16 & 1 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def test_encoded_search_against_plain_loops(spark):
    docs = [(r.doc_id, plain_vector(r.text, 64)) for r in frame("documents").itertuples()]
    want = []
    for r in frame("benchmark").itertuples():
        q = plain_vector(r.text, 64)
        near = sorted((1 - sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in docs if any(v))[:5]
        want += [(r.item_id, i, round(far, 5), k) for k, (far, i) in enumerate(near, 1)]
    got = [(r["qid"], r["id"], round(r["distance"], 5), r["rank"]) for r in queries()["encoded_search"](spark, str(DATA)).collect()]
    assert {(q, k): d for q, _, d, k in got} == pytest.approx({(q, k): d for q, _, d, k in want}, abs=2e-5)
    assert len({(q, i) for q, i, _, _ in got} ^ {(q, i) for q, i, _, _ in want}) <= len(want) // 50  # ties of rounding


def test_principal_components_against_numpy(spark):
    import numpy as np

    e = frame("embeddings")
    x = np.stack(e["embedding"]).astype(float)
    x -= x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    want = x @ axes[:8].T
    got = {r["vec_id"]: r["projected"] for r in queries()["pca_project"](spark, str(DATA)).collect()}
    mine = np.array([got[i] for i in e["vec_id"]])
    signs = np.sign((mine * want).sum(axis=0))
    assert np.abs(mine * signs - want).max() < 1e-3
    share = np.cumsum(np.linalg.svd(x, compute_uv=False) ** 2) / (x**2).sum()
    kept = {len(r["projected"]) for r in queries()["pca_share"](spark, str(DATA)).collect()}
    assert kept == {int(np.argmax(share >= 0.5)) + 1}


def test_answers_come_from_whole_tables(spark):
    rows = queries()["answer_job"](spark, str(DATA)).collect()
    assert {r["qid"] for r in rows} == set(frame("benchmark")["item_id"])
    docs = dict(zip(frame("documents")["doc_id"], frame("documents")["text"], strict=True))
    for r in rows:
        assert 1 <= r["new_rank"] <= 5 and int(r["id"].split("_")[0]) in docs and 0 <= r["score"] <= 1 and r["reason"].startswith("Ranked due to ")


def test_oracles_have_more_than_one_answer(duck):
    """Rows that differ in more than their keys, so that agreeing says something."""
    for name in ("domain", "content_type", "intent_counts", "chunk_profiles", "structure_statistics", "paragraph_chunks", "model_aware_chunks"):
        rows_ = duck.sql(oracle_sql()[name]).df()
        rest = rows_.drop(columns=[c for c in ("doc_id", "chunk_index") if c in rows_])
        assert len(rest.drop_duplicates()) > 1, name
