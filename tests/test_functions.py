"""Functions on hand-written rows and as properties."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import querying as Q
from lodestone.functions import scoring as G
from lodestone.functions import text as T
from lodestone.operators import catalog as C
from lodestone.operators import chunking as K
from lodestone.operators import dedup as D
from lodestone.operators import filters as W
from lodestone.operators import parsing as R
from lodestone.operators.encoding import HashingEncoder, embed
from lodestone.sources import io
from lodestone.streaming import windows as S

MARKED = """preamble before any header
# Title
Intro paragraph. Second sentence.     @topic:ml  [[owner:ann]]  {prio:high}  <!-- @status: draft -->
## Code
```python
import os
# not a header
```

```python
import os
```
### List
- [x] done
- [ ] open
  - nested

> quote
>> nested quote

| a | b |
|---|:-:|
| 1 | 2 |"""


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


@pytest.mark.parametrize(
    ("text", "intent", "terms"),
    [
        ("React vs Vue.js", "comparative_analysis", {"React", "Vue.js"}),
        ("fix python error 3.11", "troubleshooting", {"fix", "python", "error"}),
        ("python function example", "code_search", {"python", "function", "example"}),
        ("how to use docker", "tutorial_seeking", {"use", "docker"}),
        ("show me papers from biology collection", "information_seeking", {"papers", "biology"}),
        ("devs handbook", "comparative_analysis", {"devs", "handbook"}),
        ("machine learning in django", "information_seeking", {"machine learning", "Django"}),
    ],
)
def test_query_understanding(spark, text, intent, terms):
    r = one(spark, text, Q.intent("t").alias("i"), Q.key_terms("t").alias("k"))
    assert r["i"] == intent and terms <= set(r["k"])


def test_entities_and_filters(spark):
    r = one(spark, "papers from biology collection from 2023, recent gpu python 3.11 examples", Q.technologies("t").alias("a"), Q.hardware("t").alias("b"), Q.version("t").alias("c"), Q.filters("t").alias("f"), Q.preferences("t").alias("p"))
    assert (r["a"], r["b"], r["c"]) == (["Python"], ["GPU"], "3.11")
    assert [(f["field"], f["value"], f["confidence"]) for f in r["f"]] == [("collection", "biology", 0.9), ("year", "2023", 0.8), ("date", "recent", 0.7)]
    assert r["p"]["include_examples"] == "true"


def test_cleaning(spark):
    r = one(spark, "  It's\x07 ﬁne  cafÃ© here ", T.clean("t").alias("a"), T.clean("t", least=100).alias("b"), T.cut_at_space(F.lit("one two three"), 9).alias("c"))
    assert (r["a"], r["b"], r["c"]) == ("It's fine café here", None, "one two")
    assert one(spark, "HTTPServer Name--id", T.snake_case("t").alias("s"))["s"] == "h_t_t_p_server_name_id"


def test_filters(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": "X"}, "n": 5, "d": "2024-03-01T00:00:00Z"}'), (2, '{"n": "x"}'), (3, None)], "id long, meta string")
    ids = lambda c: [r["id"] for r in df.where(c).orderBy("id").collect()]
    assert ids(W.compare(W.field("a.b", "meta"), "eq", "x")) == [1]
    assert ids(W.conjunction([("n", "gt", 3)], metadata="meta")) == [1]
    assert ids(W.conjunction([("n", "gt", 3), ("n", "eq", "x")], "or", metadata="meta")) == [1, 2]
    assert ids(W.compare(W.field("d", "meta"), "greater_than", "2024-02-01")) == [1]
    assert ids(W.store_filter({"n": {"$gte": 5, "$lte": 5}}, "meta")) == [1] and ids(W.conjunction([])) == [1, 2, 3]
    assert ids(~W.has_keys("meta", ["a.b"])) == [2, 3] and ids(W.tags_match(F.array(F.lit("q")), [])) == []
    with pytest.raises(ValueError):
        W.store_filter({"$bad": 1})


def test_sections_and_units():
    s = R.section_list(MARKED)
    assert [(x["level"], x["title"], x["parent"]) for x in s] == [(0, "", None), (1, "Title", None), (2, "Code", 1), (3, "List", 2)]
    assert s[3]["path"] == "Title > Code > List" and "".join(MARKED[x["start"] : x["end"]] for x in s) == MARKED
    u = R.unit_list(MARKED)
    kinds = [x["kind"] for x in u]
    assert kinds.count("code_block") == 2 and kinds[-1] == "table" and kinds.count("list") == 1 and kinds.count("blockquote") == 1
    assert u[-1]["details"] == {"columns": "2", "rows": "3", "has_separator": "true", "alignments": "left,center"}
    code = [x for x in u if x["kind"] == "code_block"]
    assert code[0]["start"] < code[1]["start"] and all(MARKED[c["start"] : c["end"]].endswith("```") for c in code) and code[0]["details"]["language"] == "python"
    assert next(x for x in u if x["kind"] == "list")["details"] == {"style": "task", "items": "3", "done": "1", "depth": "2"}


def test_inline_tags_and_front_matter(spark):
    df = spark.createDataFrame([(1, MARKED)], "doc_id long, text string")
    assert {(r["kind"], r["key"], r["value"]) for r in R.inline_tags(df).collect()} == {("tag", "topic", "ml"), ("bracket", "owner", "ann"), ("brace", "prio", "high"), ("comment", "status", "draft")}
    assert R.split_frontmatter('+++\ntitle = "T"\n+++\nbody') == ({"title": "T"}, "body", "toml")
    assert R.split_frontmatter("---\ntags: [x, y]\n---\nb")[0] == {"tags": ["x", "y"]}
    with pytest.raises(ValueError):
        R.split_frontmatter("---\na: [\n---\n")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n!#`|-", max_size=600), st.integers(20, 120))
def test_chunks_are_slices_that_cover_the_text(text, size):
    c = K.Config(size=size, overlap=size // 5, least=size // 10, window=size // 6)
    s = K.spans(text, c)
    if not text.strip():
        assert s == []
        return
    assert s[0][0] == 0 and s[-1][1] == len(text)
    for (a, b, _), (x, y, _) in zip(s, s[1:], strict=False):
        assert a < x <= b < y


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab|\n#>- `[]x", max_size=200))
def test_units_are_ordered_slices(text):
    u = R.unit_list(text)
    assert all(a["end"] <= b["start"] for a, b in zip(u, u[1:], strict=False))
    assert re.sub(r"\s", "", "".join(text[x["start"] : x["end"]] for x in u)) == re.sub(r"\s", "", text)
    joined = "".join(text[x["start"] : x["end"]] for x in R.section_list(text))
    assert text.endswith(joined) and not text[: len(text) - len(joined)].strip()


def test_hybrid_chunks_are_slices(spark):
    df = spark.createDataFrame([(1, "---\ntitle: t\n---\n" + MARKED), (2, ""), (3, None)], "doc_id long, text string")
    rows = K.hybrid(df).join(df, "doc_id").collect()
    assert rows and all(r["text"][r["start"] : r["end"]] == r["content"] for r in rows) and "table" in {r["kind"] for r in rows}


def test_chunkers(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five."), (2, "a\n\nb\n \nc"), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["content"]) for r in K.sentences(df, 20).orderBy("doc_id", "chunk_index").collect()]
    assert got[:2] == [(1, "One two. Three four."), (1, "Five.")]
    assert [r["content"] for r in K.paragraphs(df).where("doc_id = 2").orderBy("chunk_index").collect()] == ["a", "b", "c"]
    assert [r["content"] for r in K.fixed_size(df, 10).where("doc_id = 1").orderBy("chunk_index").collect()] == ["One two. T", "hree four.", " Five."]


def test_chunk_scores(spark):
    r = one(spark, "- a\n- b\n- c", G.chunk_type("t").alias("k"), G.chunk_quality("t", F.lit("sentence")).alias("q"))
    assert r["k"] == "list" and r["q"]["score"] == 0.7 and "very short" in r["q"]["issues"]
    assert one(spark, "a <the> other the", G.highlight_words("t", ["the"]).alias("h"))["h"] == "a &lt;<mark>the</mark>&gt; other <mark>the</mark>"


def test_catalog(spark):
    df = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0])], "id string, content string, embedding array<double>")
    new = spark.createDataFrame([(None, "z", [1.0, 1.0]), ("c", "w", [1.0]), ("d", None, [1.0, 2.0])], df.schema)
    out = C.append(df, new)
    assert out.count() == 3 and out.where("id is null").count() == 0
    assert [r["content"] for r in C.upsert(df, df.limit(1).select("id", F.lit("q").alias("content"))).orderBy("id").collect()] == ["q", "y"]
    with pytest.raises(ValueError):
        C.delete(df)
    assert C.checksum(df).first() == C.checksum(df.repartition(3)).first()


def test_import_export_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", "x, \"q\"\nline", "en"), ("b", "y", None)], "id string, content string, collection string")
    io.write_json(df, f"{tmp_path}/j.json")
    io.write_csv(df, f"{tmp_path}/c.csv")
    for kind in ("json", "csv"):
        assert sorted(io.read_any(spark, f"{tmp_path}/{kind[0]}.{kind}", "id string, content string, collection string").collect()) == sorted(df.collect())
    new = spark.createDataFrame([("b", "new", None), ("c", "z", "de")], df.schema)
    pick = lambda how: {r["id"]: r["content"] for r in io.merge_import(df, new, how).collect()}
    assert pick("skip")["b"] == "y" and pick("overwrite")["b"] == "new" and pick("merge") == {"a": 'x, "q"\nline', "b": "new", "c": "z"}
    io.snapshot(df, f"{tmp_path}/s")
    assert io.restore(spark, f"{tmp_path}/s").count() == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "n.md").write_text("# hi")
    r = io.read_folder(spark, f"{tmp_path}/docs", "*.md").first()
    assert (r["title"], r["kind"], r["content"]) == ("n", "markdown", "# hi")


def test_near_pairs(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["x"])), (3, " ".join(base)), (4, " ".join(reversed(base))), (5, ""), (6, None)]
    got = D.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)] and got[0]["similarity"] > 0.9


def test_near_pairs_behind_a_head_below_the_threshold(spark):
    base = [f"w{i}" for i in range(120)]
    part = [*base[:-18], *[f"y{i}" for i in range(18)]]
    rows = [(1, " ".join(base)), *[(k, " ".join([*part[:-1], f"z{k}"])) for k in range(2, 42)], (50, " ".join(part[:-1] + ["z9"]))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows if i != 50}
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert all(0.7 < sim[1, b] < 0.8 for b in range(2, 42))  # shares bands with all, is alike to none
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 7):
        got = [(r["a"], r["b"], r["similarity"]) for r in D.near_pairs(df, block=block).collect()]
        assert {(a, b): s for a, b, s in got} == pytest.approx({k: s for k, s in sim.items() if s >= 0.8}) and len(got) == 780
    assert {r["doc_id"]: r["representative"] for r in D.members(df).collect()} == {**{i: i for i in sets}, 50: 9}


def test_search_in_blocks_and_odd_vectors(spark):
    from lodestone.operators import search as E

    rows = [(i, "a" if i % 2 else "b", [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(100, "a", None), (101, "a", [0.0, 0.0, 0.0]), (102, None, [1.0]), (103, None, [1.0, 2.0, 3.0]), (104, "b", [1.0, None, 2.0])]
    chunks = spark.createDataFrame(rows, "id long, collection string, embedding array<double>")
    asked = chunks.where("id < 12 or id > 99").selectExpr("id qid", "embedding query_embedding", "id self_id")

    def plain(metric, k, per):
        want = []
        for q, _, x in rows:
            if (q < 12 or q > 99) and x and None not in x and (metric != "cosine" or any(x)):
                near = {}
                for i, c, y in rows:
                    if i != q and y and None not in y and len(x) == len(y) and (metric != "cosine" or any(y)):
                        n = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
                        far = sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) if metric == "l2" else 1 - sum(a * b for a, b in zip(x, y, strict=True)) / (n if metric == "cosine" else 1)
                        near.setdefault(c if per else "", []).append((round(far, 9) + 0.0, i))
                want += [(q, i, k1) for v in near.values() for k1, (_, i) in enumerate(sorted(v)[:k], 1)]
        return sorted(want)

    for metric, per in (("cosine", False), ("l2", True), ("ip", False)):
        got = E.top_k(chunks, asked, 4, per_collection=per, metric=metric, not_self=True)
        far = {(r["qid"], r["id"]): round(r["distance"], 9) for r in got.collect()}
        want = plain(metric, 4, per)
        assert len(far) == len(want) and sorted(r["rank"] for r in got.collect()) == sorted(k for _, _, k in want)
        assert metric != "l2" or sorted((r["qid"], r["id"], r["rank"]) for r in got.collect()) == want
    step = lambda q, r: q.merge(r, how="cross")[["qid", "id"]]
    pairs = E.meet(chunks.select("id"), asked.select("qid"), step, "qid long, id long", most_queries=3)
    assert pairs.count() == asked.count() * len(rows) == pairs.distinct().count()


def test_encoder(spark):
    df = embed(spark.createDataFrame([("a b c",), ("",), (None,)], "content string"), HashingEncoder(16))
    rows = {r["content"]: r for r in df.collect()}
    assert sum(x * x for x in rows["a b c"]["embedding"]) == pytest.approx(1) and rows[""]["embedding"] is None and rows[""]["embedding_error"]


def test_remote_encoder():
    from lodestone.operators.encoding import RemoteEncoder

    said, waits = [], []

    def send(answers):
        it = iter(answers)

        def one(texts):
            said.append(len(texts))
            status = next(it)
            return status, [[float(len(t))] for t in texts] if status == 200 else []

        return one

    assert RemoteEncoder(send([200, 503, 500, 200]), 1, batch=2, wait=waits.append).encode(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
    assert said == [2, 1, 1, 1] and waits == [1.0, 2.0]
    for answers in ([401], [429], [500, 502, 503]):
        with pytest.raises(ConnectionError):
            RemoteEncoder(send(answers), 1, wait=waits.append).encode(["a"])
    with pytest.raises(ValueError):
        RemoteEncoder(send([200]), 2).encode(["a"])


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same" if i % 2 else f"text {i} long enough", f"2024-01-01 00:{i:02d}:00") for i in range(20)], "doc_id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    docs.write.parquet(f"{tmp_path}/in")
    stream = S.read_stream(spark, f"{tmp_path}/in", docs.schema)
    q = S.ingest_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: b.select("doc_id"), C.document_problem(F.col("text")))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    once = S.keep_first_stream(S.read_stream(spark, f"{tmp_path}/in", docs.schema), "at", "1 hour").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    once.awaitTermination(120)
    assert spark.table("once").count() == 11
    t = S.tumbling(S.read_stream(spark, f"{tmp_path}/in", docs.schema), "at", "5 minutes", late="1 minute").writeStream.outputMode("append").format("memory").queryName("tumble").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp3").start()
    t.awaitTermination(120)
    assert spark.table("tumble").count() >= 3
