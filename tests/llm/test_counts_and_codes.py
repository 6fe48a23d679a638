"""Divergence audit, token counts and vector codes: the registered queries over awkward tables, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from test_registered import ROWS, bag, tables  # noqa: F401  the fixture


def plain_audit(rows, least=3, top=200):
    """rows (lang, source, text) -> rows of the audit, by dense sums over all kept terms."""
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for la, so, t in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for la, so, terms in docs:
        df[la].update(set(terms))
        n[la, so].update(terms)
        groups[la].add(so)
    out = []
    for la, sources in groups.items():
        kept = [t for t, k in df[la].items() if k >= least]
        v = len(kept)
        chances = {}
        for so in [*sources, None]:
            count = n[la, so] if so is not None else sum((n[la, s] for s in sources), Counter())
            total = sum(count[t] for t in kept)
            chances[so] = {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}
        far = lambda p, q: (p - q) ** 2 // q
        for so in sources:
            p = chances[so]
            pairs = [(o, sum(far(p[t], chances[o][t]) for t in kept)) for o in sources if o != so]
            terms = [(t, far(p[t], chances[None][t])) for t in kept if n[la, so][t] and p[t] > chances[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(la, so, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return out


def test_op11(spark, tables):  # noqa: F811
    from lodestone.llm.queries import op11_source_divergence

    got = op11_source_divergence(spark, tables[0]).collect()
    assert bag(map(tuple, got)) == bag(plain_audit([(r[2], r[3], r[1]) for r in ROWS]))


@pytest.mark.parametrize("cells, most", [(8, 1 << 19), (1 << 16, 5)])
def test_audit_with_a_full_sketch_and_small_tables(spark, cells, most):
    """Of 8 cells nearly all terms pass; with tables of 5 terms every task writes many parts. The result stays."""
    from lodestone.llm.divergence import audit

    rnd = random.Random(2)
    rows = [("en" if k % 3 else None, rnd.choice(["a", "b", "é", "", None]), " ".join(rnd.choice(["Aa", "aa", "bé", "c1c", "水", "ß"]) + rnd.choice(["", "", f"x{k}q"]) for _ in range(rnd.randint(0, 12)))) for k in range(120)]
    rows += [("solo", "only", "one two one"), ("bare", "s1", None), ("bare", "s2", "12 3"), ("rare", "s1", "once"), ("rare", "s2", "twice twice")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, block int")
    got = audit(df, top=3, most_cells=cells, bytes_a_cell=1, most_terms=most).collect()
    assert bag(map(tuple, got)) == bag(plain_audit(rows, top=3))


def test_chances_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from lodestone.llm.divergence import chance

    cases = [(0, 0, 1), (9_223_372_035, 10**12, 7), (9_223_372_034, 10**12, 7), (10**15, 3 * 10**15, 10**9), (5, 6, 2)]
    df = spark.createDataFrame(cases, "n long, total long, v long").select(chance(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in cases]


def test_sketch_never_underestimates():
    from lodestone.llm.divergence import DEPTH, Sketch, cells, merged, packed

    rnd = np.random.default_rng(4)
    h, n = rnd.integers(0, 1 << 63, 3000).astype(np.uint64), rnd.integers(1, 3, (4, 3000))
    whole = None
    for part in n:
        s = Sketch(1 << 12, 3)
        s.add(h[:2000], part[:2000])
        s.add(h[1000:], part[1000:])
        whole = packed(s.count.ravel()) if whole is None else merged(whole, packed(s.count.ravel()), 3)
    flat = np.stack([whole >> k & 3 for k in (0, 2, 4, 6)], 1).ravel()[: DEPTH << 12].reshape(DEPTH, -1)
    told = np.min([row[at] for row, at in zip(flat, cells(h, 1 << 12), strict=True)], 0)
    assert (told == 3).all()
    one = Sketch(1 << 16, 3)
    one.add(h[:50], np.ones(50, int))
    assert (np.min([row[at] for row, at in zip(one.count, cells(h[:50], 1 << 16), strict=True)], 0) == 1).all()


def library(name):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return public.path(name), Tokenizer.from_file(public.path(name))


def test_op12(spark, tables):  # noqa: F811
    _, tok = library("word_bpe_49k.json")
    from lodestone.llm.queries import op12_token_counts

    want = []
    for i, t, _, _ in ROWS:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    got = op12_token_counts(spark, tables[0]).collect()
    assert bag(map(tuple, got)) == bag(want) and any(r["over_limit"] for r in got)


def test_counts_of_odd_texts_equal_the_library():
    path, tok = library("word_bpe_49k.json")
    from lodestone.llm.token_counts import TokenCounter

    count, rnd = TokenCounter(path).count, random.Random(3)
    pool = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\t", " ", "　", "̸", "̱", "́", "E", "H", "Σ", "ΑΣ", "İ", "ß", "K", "'s", "'LL", "'", "12", "½", "Ⅷ", "é", "木村", "です", "🙂", "👨‍👩‍👧", "\x00", "\x1c", "\x85", "​", "ǅ", "ﬁ", "가", "가", "क्षि", "the", "The", "aaaa", "zzzzqqqq", "!!!", "--", "﻿"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(0x250), rnd.randrange(0x3000), rnd.randrange(0xE000, 0x20000)])) for _ in range(10)) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(50_000)), "ab" * 40_000, "a" * 30_001]
    assert [count(t.encode()) for t in texts] == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def test_small_tables_of_counts_are_emptied(monkeypatch):
    path, tok = library("word_bpe_49k.json")
    from lodestone.llm import token_counts

    monkeypatch.setattr(token_counts, "MOST_KEPT", 3)
    c = token_counts.TokenCounter(path)
    text = "one two three four five six seven one two three " * 3
    assert c.count(text.encode()) == len(tok.encode(text, add_special_tokens=False).ids) and len(c.runs) <= 3


def test_other_tokenizers_are_refused(tmp_path):
    path, _ = library("byte_bpe_50k.json")
    from lodestone.llm.token_counts import TokenCounter

    with pytest.raises(ValueError, match="white space"):
        TokenCounter(path)


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows (vec_id, vector, label) of equal length, in the order in which they start codebooks; every entry is looked at."""
    width = -(-len(rows[0][1]) // parts)
    padded = [[*r[1], *[0.0] * (width * parts - len(r[1]))] for r in rows]
    cut = [[n * scale // d for n, d in (float(x).as_integer_ratio() for x in v)] for v in padded]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in cut]
    books = [[cut[k][p] for k in range(min(entries, len(rows)))] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assigned():
        return [[min((dist(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assigned()
    errors = [sum(d for d, _ in f) for f in found]
    labels = Counter()
    for r, e in zip(rows, errors, strict=True):
        labels[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = (1 << 63) - 1
    return [(r[0], r[2], "".join(f"{k:02x}" for _, k in f), min(e, most), min(labels[r[2]], most), sha) for r, f, e in zip(rows, found, errors, strict=True)]


def kept(rows):
    fine = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for r in fine)
    most = min(sizes, key=lambda d: (-sizes[d], d))
    return sorted((r for r in fine if len(r[1]) == most), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def vectors(dim, n=150, size=1.0):
    rnd = np.random.default_rng(dim)
    rows = [(int(rnd.integers(0, 10_000)), (rnd.normal(size=dim) * size).tolist(), None if k % 7 == 0 else int(k % 3)) for k in range(n)]
    rows += [(rows[3][0], rows[5][1], 1), rows[4], rows[4], (None, [0.0] * dim, 2), (None, rows[9][1], None), (1, None, 1), (2, [1.0] * (dim + 1), 1), (3, [], 1)]
    rows += [(4, [float("nan"), *[0.0] * (dim - 1)], 1), (5, [float("inf"), *[0.0] * (dim - 1)], 1), (6, [None, *[0.0] * (dim - 1)], 1)]
    return rows + [(7 + k, rows[2][1], 0) for k in range(40)]


@pytest.mark.parametrize("dim, size", [(16, 1.0), (13, 0.01), (8, 1e7), (8, 3e30)])
def test_codes_equal_plain_k_means(spark, dim, size):
    """Also with lengths that 8 doesn't divide, and components whose squares pass 64 bits."""
    from lodestone.llm.vector_codes import compress

    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], la) for i, v, la in vectors(dim, size=size)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, code string, v int, sums int")
    got = compress(df.repartition(3)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert bag(map(tuple, got)) == bag(plain_codes(kept(rows)))


def test_fewer_vectors_than_entries(spark):
    from lodestone.llm.vector_codes import compress

    rows = [(k, [float(k * j % 5) for j in range(8)], None) for k in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert bag(map(tuple, compress(df).collect())) == bag(plain_codes(rows))


def test_op13(spark, tables):  # noqa: F811
    from lodestone.llm.queries import op13_vector_codes

    rows = [(i, v and [float(np.float32(x)) for x in v], None if i is None else i % 3) for i, v in tables[2]]
    assert bag(map(tuple, op13_vector_codes(spark, tables[0]).collect())) == bag(plain_codes(kept(rows)))


def test_search_skips_entries_and_keeps_ties():
    from lodestone.llm.vector_codes import Neighbours, squared

    rnd = np.random.default_rng(1)
    middle = rnd.integers(-3000, 3000, (16, 8))
    x = middle[rnd.integers(0, 16, 4000)] + rnd.integers(-40, 40, (4000, 8))
    entries = middle.copy()
    entries[9] = entries[4]  # equal entries: the lower index wins
    full = squared(x[:, None], entries[None])
    search = Neighbours(entries)
    for start in (full.argmin(1), rnd.integers(0, 16, 4000)):
        code, best, taken = search.nearest(x, start)
        assert (code == full.argmin(1)).all() and (best == full.min(1)).all()
        if (start == full.argmin(1)).all():
            assert taken < 16 * len(x) / 4
