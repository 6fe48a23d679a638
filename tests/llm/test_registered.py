"""The registered queries over awkward tables, against plain versions that share no code with the operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from test_operators import base_spans, plain_fingerprint

WORDS = {
    "en": ["the", "house", "with", "thing", "which", "night", "water", "where", "people", "should", "things", "thought"],
    "de": ["der", "haus", "mit", "nicht", "wasser", "schön", "leute", "durch", "straße", "zwischen", "glück", "und"],
    "ja": ["水", "木村", "から", "です", "東京", "大学", "ある", "本当"],
    "zh": ["水", "木头", "从来", "是的", "北京", "大学", "有人", "本来"],
}


def table_rows():
    """Documents with copies, near copies, repeated and null ids, empty, null and long texts, secrets and a hot source."""
    rnd = random.Random(12)
    rows = []
    for i in range(240):
        lang = list(WORDS)[i % 4]
        text = " ".join(rnd.choice(WORDS[lang]) for _ in range(rnd.randint(20, 90))) + f" n{i}"
        if i % 9 == 0:
            text += rnd.choice([" token=abcdef123", " AKIA" + "Q" * 18, " " + "0a" * 14, " password: 'x1y2z3w4'"])
        rows.append([i, text, lang, "hot" if i % 3 == 0 else f"s{i % 7}"])
    rows += [[300 + i, rows[5][1], "de", "copy"] for i in range(40)]  # copies
    for i in range(30):  # near copies
        w = rows[8][1].split()
        w[i % 10] = f"z{i}"
        rows.append([400 + i, " ".join(w), "en", "near"])
    rows += [[100, rows[100][1], "en", "again"], [100, "quite another text of the same id", "en", "again"], [100, rows[100][1], "en", "again"]]
    rows += [[None, "no id", None, None], [None, None, "en", None], [None, "", None, ""], [500, None, None, "s1"], [501, "", "en", "s1"], [502, " \t\n", "de", None], [503, "long " * 30_000 + "end", "en", "long"], [504, "123 456", "en", "s2"]]
    return rows


ROWS = table_rows()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([tuple(r) for r in ROWS], "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "cast(length(text) as long) n_chars", "'x' score", "'y' findings", "7 fp", "'z' shard", "1 copies", "0 size", "'k' `key`", "9 n", "'q' bucket", "'a' `__text`", "0 component")
    df.write.parquet(f"{base}/documents.parquet")
    empty = tmp_path_factory.mktemp("empty")
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(260, 12)).astype(np.float32)
    x[50:80] = x[50]  # one common vector
    vec = [(i if i < 250 else (i - 250) * 20, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (900, None), (920, [0.0] * 12), (940, [1.0] * 3), (960, [float("nan")] * 12)]
    vdf = spark.createDataFrame(vec, "vec_id long, embedding array<float>").selectExpr("*", "cast(vec_id % 3 as int) label", "1 `rank`", "2 `row`", "3 query_id")
    vdf.write.parquet(f"{base}/embeddings.parquet")
    vdf.limit(0).write.parquet(f"{empty}/embeddings.parquet")
    labels = [(i, i % 5 == 0) for i in range(240)] + [(100, True), (None, True), (7, None)]
    ldf = spark.createDataFrame(labels, "doc_id long, toxic boolean").selectExpr("doc_id", "cast(toxic as int) toxic", "1 quality")
    ldf.write.parquet(f"{base}/labels.parquet")
    ldf.limit(0).write.parquet(f"{empty}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{empty}/pages.parquet")
    return str(base), str(empty), vec


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mod(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def bag(rows):
    return Counter(map(repr, rows))


def test_empty_tables(spark, tables):
    from lodestone.llm.queries import queries

    for name, f in queries().items():
        assert f(spark, tables[1]).count() == 0, name


def test_op1(spark, tables):
    from lodestone.llm.queries import op1_language_id

    got = op1_language_id(spark, tables[0]).collect()
    assert bag((r["doc_id"], r["held_out"]) for r in got) == bag((r[0], mod(r[0], 4) == 2) for r in ROWS)
    letters = lambda t: re.sub(r"[\W\d_]+", " ", (t or "").lower())
    ref = {x: " ".join(letters(t) for i, t, y, _ in ROWS if y == x and t and mod(i, 4) != 2 and len(t) < 50_000) for x in WORDS}

    def bits(text, lang):
        n = at = 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in ref[lang]:
                end += 1
            at, n = end, n + 1
        return n * math.log2(len(ref[lang].encode()))

    told = {}
    for r in got:
        told.setdefault(r["doc_id"], []).append(r)
    for i, t, _, _ in ROWS:
        if i is None or i == 100:
            continue
        r = told[i][0]
        if not letters(t).strip():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(t) < 5000:
            cost = sorted((bits(letters(t), x), x) for x in WORDS)
            if cost[1][0] - cost[0][0] > 40:
                assert r["lang_pred"] == cost[0][1], (i, cost)
        assert 0 <= r["score"] <= 1
    right = [told[i][0]["lang_pred"] == x for i, _, x, _ in ROWS[:240] if mod(i, 4) == 2 and i != 100]
    assert sum(right) / len(right) > 0.97


def test_op3(spark, tables):
    from lodestone.llm.queries import op3_ann_search

    fine = [(i, k, np.array(v, float)) for k, (i, v) in enumerate(tables[2]) if i is not None and v and len(v) == 12 and np.isfinite(v).all() and any(v)]
    want = []
    for i, k, q in fine:
        if i % 20 == 0:
            near = sorted((-float(sum(a * b for a, b in zip(q, x, strict=True))), j, m) for j, m, x in fine if m != k)[:20]
            want += [(i, n + 1, j, round(-s, 9)) for n, (s, j, _) in enumerate(near)]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in op3_ann_search(spark, tables[0]).collect()]
    assert bag(got) == bag(want) and max(Counter((q, r) for q, r, _, _ in got).values()) == 2  # two queries of one id rank their own lists


def test_op3_in_several_blocks(spark, tables):
    from lodestone.llm.ann import search
    from lodestone.llm.common import table

    df = table(spark, tables[0], "embeddings")
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], r["score"])
    assert bag(map(key, search(df, block_rows=60, query_rows=3, bucket_rows=40, pair_rows=100).collect())) == bag(map(key, search(df).collect()))


def test_op4(spark, tables):
    from lodestone.llm.queries import op4_secret_scan

    want = []
    for i, t, _, _ in ROWS:
        s = base_spans(t or "")
        n = Counter(k for _, k, _ in s)
        want.append((i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in s).encode()).hexdigest()))
    got = op4_secret_scan(spark, tables[0]).collect()
    assert bag((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == bag(want)


def test_op5(spark, tables):
    from lodestone.llm.queries import op5_simhash_dedup

    prints = [plain_fingerprint(t, 4) for _, t, _, _ in ROWS]
    group = list(range(len(ROWS)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(ROWS)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    ids: dict = {}
    for k, r in enumerate(ROWS):
        if r[0] is not None:
            ids.setdefault(root(k), []).append(r[0])
    want = [(r[0], f"{prints[k]:016x}", min(ids.get(root(k), [None]))) for k, r in enumerate(ROWS)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op5_simhash_dedup(spark, tables[0]).collect()]
    assert bag(got) == bag(want)


def test_op6(spark, tables):
    from lodestone.llm.queries import op6_toxicity

    got = op6_toxicity(spark, tables[0]).collect()
    assert bag((r["doc_id"], r["held_out"]) for r in got) == bag((r[0], mod(r[0], 3) == 1) for r in ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    again = op6_toxicity(spark, tables[0]).collect()
    assert bag(map(tuple, got)) == bag(map(tuple, again))


def test_op7(spark, tables):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    from lodestone.llm.queries import op7_sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = []
    for i, t, _, _ in ROWS:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    out = op7_sentencepiece(spark, tables[0]).collect()
    assert bag((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == bag(want)
    # pieces tile the text: as the map of this model is empty, a space is three bytes of a piece and one of the text
    spans = []
    for _, t, _, _ in ROWS:
        at, ends = -1, []  # the mark in front stands for no byte
        for piece in sp.encode(t or "", out_type=str):
            raw = bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("\u2581", " ").encode()
            at += len(raw)
            ends.append(at)
        spans.append(np.array([0, *ends[:-1], *ends] if ends else [], "<i8").clip(0).tobytes())
    assert bag(r["spans_sha256"] for r in out) == bag(hashlib.sha256(x).hexdigest() for x in spans)


def plain_weighted(text):
    w = words(text.lower())
    c, total = [0] * 64, 0
    for a, b in zip(w, [*w[1:], None][: len(w)], strict=True):
        h, n = xxhash.xxh64_intdigest(a.encode(), 42), len(a)
        if b is not None:
            h, n = xxhash.xxh64_intdigest(b.encode(), h), n + len(b)
        n = min(n, 24)
        total += n
        for k in range(64):
            c[k] += n * (h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * c[k] > total)


def test_op8(spark, tables):
    from lodestone.llm.queries import op8_doc_fingerprints

    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    docs = sorted(((i is not None, i or 0, signed(t or ""), t or "", i) for i, t, _, _ in ROWS))
    prints = [plain_weighted(d[3]) for d in docs]
    like = lambda d: 1.0 if d == 0 else max(0.0, math.cos(math.pi * d / 64))
    want = []
    for k, (_, _, _, t, i) in enumerate(docs):
        nxt, q = docs[(k + 1) % len(docs)][3], len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        e = plain_weighted(edited)
        within = sum((prints[k] ^ p).bit_count() <= 3 for p in prints) if i is not None and i % 100 == 0 else None
        near = [round(like((prints[k] ^ p).bit_count()), 6) for p in (e, prints[(k + 1) % len(docs)])]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[k]:016x}", f"{e:016x}", *near, within))
    got = op8_doc_fingerprints(spark, tables[0]).collect()
    assert bag((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 6), round(r["near_next"], 6), r["n_within"]) for r in got) == bag(want)


def test_op9(spark, tables):
    from lodestone.llm.queries import op9_source_mixing

    got = op9_source_mixing(spark, tables[0]).collect()
    assert bag((r["doc_id"], r["size"]) for r in got) == bag((i, len(words(t))) for i, t, _, _ in ROWS)
    total: Counter = Counter()
    for _, t, _, s in ROWS:
        total[s] += len(words(t))
    order = sorted(s for s in total if s is not None) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    stopped: set = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in stopped)) / sum(weight[s] for s in order if s not in stopped)
        more = {s for s in order if s not in stopped and weight[s] * level > 3 * total[s]}
        if not more:
            break
        stopped |= more
    target = {s: 3 * total[s] if s in stopped else weight[s] * level for s in order}
    want = Counter((round(target[s], 6), total[s]) for _, _, _, s in ROWS)
    assert Counter((round(r["target"], 6), r["source_size"]) for r in got) == want
    taken: Counter = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    biggest = {s: max(len(words(t)) for _, t, _, x in ROWS if x == s) for s in order}
    for s in order:
        assert abs(taken[round(target[s], 6), total[s]] - target[s]) <= max(1, biggest[s])
    again = op9_source_mixing(spark, tables[0]).collect()
    assert bag(map(tuple, got)) == bag(map(tuple, again))


def test_op9_deals_out_one_id_of_many_rows(spark):
    from lodestone.llm.mixing import mix

    df = spark.range(3000).selectExpr("cast(null as long) doc_id", "repeat('w ', cast(id % 7 as int)) text", "'one' source").unionByName(spark.range(500).selectExpr("id doc_id", "'a b c' text", "'two' source"))
    out = mix(df, group_rows=64, fan=4).groupBy("source", "target").sum("taken").collect()
    assert len(out) == 2 and all(abs(r["sum(taken)"] - r["target"]) <= 7 for r in out)


def test_op10(spark, tables):
    from lodestone.llm.queries import op10_sharding

    got = op10_sharding(spark, tables[0]).collect()
    raw = [(i, (t or "").encode()) for i, t, _, _ in ROWS]
    assert bag((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == bag((i, len(b) + 16, zlib.crc32(b), "rows", None) for i, b in raw)
    slots: dict = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    of: dict = {}
    for r in got:
        of.setdefault((r["size"], r["text_crc32"]), []).append(r["shard"])
    groups = [v for v in of.values() if len(v) > 1]
    room = -(-len(got) // 40)
    assert groups and sum(len(set(v)) <= -(-len(v) // room) + 3 for v in groups) >= 0.6 * len(groups)


def test_label_model_against_plain_loops():
    from lodestone.llm.toxicity import label_model

    rnd = np.random.default_rng(3)
    y = (rnd.random(300) < 0.3).astype(int)
    votes = np.stack([np.where(rnd.random(300) < acc, 2 * y - 1, rnd.integers(-1, 2, 300)) for acc in (0.5, 0.7, 0.6)], axis=1).astype(float)
    given, weight = np.where(rnd.random(300) < 0.9, y, 1 - y), rnd.random(300) + 0.5
    post, m1, m0, _ = label_model(votes, given, weight, rounds=4)
    w = [float(x) / (sum(weight) / len(weight)) for x in weight]
    p = [0.9 if g else 0.02 for g in given]
    share = None
    for _ in range(4):
        chance = {}
        for side in (1, 0):
            ws = [a * (b if side else 1 - b) for a, b in zip(w, p, strict=True)]
            for j in range(3):
                for v in (-1, 0, 1):
                    chance[side, j, v] = (sum(a for a, row in zip(ws, votes, strict=True) if row[j] == v) + 0.5) / (sum(ws) + 1.5)
        mean = {(s, j): chance[s, j, 1] - chance[s, j, -1] for s in (1, 0) for j in range(3)}
        if share is None:
            left = [[row[j] - mean[int(g), j] for j in range(3)] for row, g in zip(votes, given, strict=True)]
            cov = [[sum(a * x[i] * x[j] for a, x in zip(w, left, strict=True)) / sum(w) for j in range(3)] for i in range(3)]
            corr = [[1.0 if i == j else cov[i][j] / math.sqrt(cov[i][i]) / math.sqrt(cov[j][j]) for j in range(3)] for i in range(3)]
            share = [1 / sum(min(max(corr[i][j], 0), 1) for i in range(3)) for j in range(3)]
        w1, w0 = [a * b for a, b in zip(w, p, strict=True)], [a * (1 - b) for a, b in zip(w, p, strict=True)]
        clip = lambda x, a, b: min(max(x, a), b)
        hit = clip(sum(a * g for a, g in zip(w1, given, strict=True)) / sum(w1), 0.05, 0.995)
        false = clip(sum(a * g for a, g in zip(w0, given, strict=True)) / sum(w0), 0.001, 0.5)
        prior = clip(sum(w1) / sum(w), 1e-4, 1 - 1e-4)
        fresh = []
        for row, g in zip(votes, given, strict=True):
            z = math.log(prior / (1 - prior)) + (math.log(hit / false) if g else math.log((1 - hit) / (1 - false)))
            z += sum(share[j] * (math.log(chance[1, j, row[j]]) - math.log(chance[0, j, row[j]])) for j in range(3))
            fresh.append(clip(1 / (1 + math.exp(-clip(z, -30, 30))), 1e-6, 1 - 1e-6))
        p = fresh
    assert post == pytest.approx(p, abs=1e-6) and list(m1) == pytest.approx([mean[1, j] for j in range(3)], abs=1e-9)


def test_components_split_hot_nodes(spark):
    """A star of a third of all edges is joined by broadcast, and no join reads it in one task."""
    from lodestone.llm.common import cut, keyed, spread_join

    left = cut(spark.range(6000).selectExpr("if(id < 2000, 0, id) a", "id b"))
    right = keyed(left.groupBy("a").count().selectExpr("a", "`count` n", "a * 2 c"))
    joined = spread_join(left, right, "a")
    assert bag(map(tuple, joined.select("a", "b", "c").collect())) == bag((0 if i < 2000 else i, i, 0 if i < 2000 else 2 * i) for i in range(6000))
    parts = joined.where("a = 0").selectExpr("spark_partition_id() p").distinct().count()
    assert parts == left.selectExpr("spark_partition_id() p").distinct().count() or parts >= 1
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_groups_larger_than_a_block_lose_no_link(spark):
    from lodestone.llm.simhash_dedup import _walk, group_links

    rnd = np.random.default_rng(8)
    keys = np.unique(rnd.integers(0, 1 << 14, 900).astype(np.uint64) << np.uint64(40))
    prints = spark.createDataFrame([(int(k), int(x)) for k, x in enumerate(keys)], "id long, fp long")
    members = prints.selectExpr("cast(id % 2 as long) g", "id").unionByName(prints.where("id < 10").selectExpr("9L g", "id"))

    def link(pdf, same):
        return _walk(pdf["g"].to_numpy(), same, pdf["fp"].to_numpy().view(np.uint64), [1] * 65)

    got = {r["node"]: r["component"] for r in group_links(members, prints, link, block=40).collect()}
    group = list(range(len(keys)))
    pairs = [(a, b) for a in range(len(keys)) for b in range(a) if ((a - b) % 2 == 0 or a < 10) and (int(keys[a]) ^ int(keys[b])).bit_count() <= 1]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                moved = True
    assert {k: got.get(k, k) for k in range(len(keys))} == dict(enumerate(group)) and len(set(group)) < len(keys)


@pytest.mark.parametrize("subtree", [4, 32768])
def test_linked_at_every_depth(spark, subtree):
    """subtree 4: prefixes deeper than the first block, so that rows go to several homes."""
    from lodestone.llm.simhash_dedup import linked

    rnd = random.Random(4)
    prints = {rnd.getrandbits(64) for _ in range(300)}
    for x in list(prints)[:150]:
        for n in (1, 2, 3, 4, 5):
            prints.add(x ^ sum(1 << b for b in rnd.sample(range(64), n)))
    ids = sorted(prints)
    depth = 16 if subtree == 4 else None
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in ids], "fp long")
    got = {r["fp"] % 2**64: r["component"] % 2**64 for r in linked(df, 4, subtree=subtree if depth is None else len(ids) / 2**15).collect()}
    group = {x: x for x in ids}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (a ^ b).bit_count() <= 4:
                group[root(a)] = root(b)
    classes: dict = {}
    for x in ids:
        classes.setdefault(root(x), set()).add(x)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset(x for x in got if got[x] == c) for c in set(got.values())}
