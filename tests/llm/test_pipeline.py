"""The pipeline against a plain version of its stages."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(3)
    base = tmp_path_factory.mktemp("corpus")
    words = ["word" + a + b for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopqr"]
    rows, labels = [], []
    for i in range(240):
        t = [rnd.choice(words) for _ in range(80)]
        bad = i % 8 == 0
        if bad:
            for _ in range(4):
                t[rnd.randrange(80)] = rnd.choice(["grumpf", "blorgle", "snark"])
        if i % 8 == 3:
            t[5] = "token=abcdef123456"
        rows.append((i, " ".join(t), "en", f"s{i % 4}"))
        labels.append((i, 1, int(bad)))
    rows += [(300 + i, rows[1][1], "en", "s1") for i in range(60)]  # copies
    rows += [(400 + i, rows[2][1].replace("word", "Word", 1) + (" more" if i else ""), "en", "s2") for i in range(2)]  # near copies
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars", "'x' as extra")
    df.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), rows, labels


def test_stages(spark, corpus):
    d, rows, labels = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = pipeline.drop_toxic(spark, docs, d)
    bad = {i for i, _, y in labels if y}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {r[0] for r in rows} - bad
    one = pipeline.drop_near_copies(spark, kept, d)
    assert {r["doc_id"] for r in one.collect()} == {i for i in ids if i < 300}
    clean = pipeline.redact_secrets(spark, one, d)
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all("token=" not in t for t in text.values()) and text[3].count("[assign]") == 1 and text[1] == rows[1][1]
    mixed = pipeline.mix_sources(spark, clean, d)
    assert mixed.columns == list(pipeline.COLUMNS)
    assert {r["doc_id"] for r in mixed.collect()} <= ids
    out = pipeline.encode_pieces(spark, mixed, d)
    assert out.count() == mixed.count()


def test_run_equals_the_stages_and_odd_tables(spark, corpus):
    d, _, _ = corpus
    first, again = (sorted((r["doc_id"], r["ids_sha256"]) for r in pipeline.run(spark, d).collect()) for _ in range(2))
    assert first == again and first
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", None, 0), (2, "a b", None, "s", 3)], docs.drop("extra").schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name
        stage(spark, odd, d).collect()
    assert pipeline.redact_secrets(spark, odd, d).count() == 4 and pipeline.drop_toxic(spark, odd, d).count() == 4
    assert pipeline.drop_near_copies(spark, odd, d).count() == 2


def test_near_copies_are_verified(spark):
    rnd, rows = random.Random(9), []
    for i in range(160):
        t = [f"v{rnd.randrange(5000)}" for _ in range(304)]
        rows.append((2 * i, " ".join(t)))
        for k in range(0, 300, 50 if i % 2 else 30):
            t[k + 4] = f"x{i}-{k}"
        rows.append((2 * i + 1, " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(300)} for i, t in rows}
    sim = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in sets if i % 2 == 0}
    assert {s >= 0.8 for s in sim.values()} == {True, False} and all(0.65 < s < 0.9 for s in sim.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    got = {r["doc_id"] for r in pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == {i for i, _ in rows} - {i + 1 for i, s in sim.items() if s >= 0.8}


def test_stages_on_awkward_rows(spark, tmp_path):
    """Clashing columns, long texts, repeated and null ids, against plain versions of what each stage decides."""
    from test_registered import ROWS, words

    df = spark.createDataFrame([tuple(r) for r in ROWS], "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "cast(length(text) as long) n_chars", "'x' score", "'y' findings", "7 fp", "1 copies", "0 size", "'k' `key`", "9 n", "0 component", "3 __k", "4 __i", "5 dup")
    kept = pipeline.drop_near_copies(spark, df, "").collect()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words((t or "").translate({c: c + 32 for c in range(65, 91)})) for _, t, _, _ in ROWS)]
    group = list(range(len(ROWS)))
    moved = True
    pairs = [(a, b) for a in range(len(ROWS)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while moved:
        moved = False
        for a, b in pairs:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                moved = True
    ids: dict = {}
    for k, r in enumerate(ROWS):
        ids.setdefault(group[k], []).append(r[0])
    want = sorted(min((i for i in v if i is not None), default=None) for v in ids.values() if any(i is not None for i in v)) + [None] * sum(all(i is None for i in v) for v in ids.values())
    assert sorted((r["doc_id"] for r in kept if r["doc_id"] is not None)) + [None] * sum(r["doc_id"] is None for r in kept) == want
    for _, stage in pipeline.STAGES[2:3]:
        assert stage(spark, df, "").count() == len(ROWS) and stage(spark, df, "").columns == list(pipeline.COLUMNS)
    mixed = pipeline.mix_sources(spark, df, "").collect()
    taken: dict = {}
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    from lodestone.llm.mixing import mix

    told = {r["source"]: r["n"] for r in mix(df).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect() if r["n"]}
    assert taken == told
    assert pipeline.encode_pieces(spark, df, "").count() == len(ROWS)
