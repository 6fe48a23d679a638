"""Label propagation, and the parts of the toxicity model, against plain loops that share no code with them."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from test_registered import ROWS, bag, tables  # noqa: F401  the fixture


def draw(*values):
    """unit_hash: each value hashed with the hash before it as its seed; longs as eight bytes, ints as four."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h)
    return (h >> 11) / 2**53


def plain_propagation(rows, shards, quota, rounds):
    """rows [doc_id, dup, group, shard]; moves them in place."""
    for k in range(rounds):
        places = defaultdict(Counter)
        for _, _, g, s in rows:
            places[g][s] += 1
        room = [quota - sum(p[s] for p in places.values()) for s in range(shards)]
        plans = {}
        for g, p in places.items():
            size = sum(p.values())
            roomy = lambda s: max(0, room[s]) > quota // 16  # noqa: B023, E731
            to = max(p, key=lambda s: (roomy(s), p[s], -s))  # noqa: B023
            whole = size <= max(1, quota // 8)
            plans[g] = {s: (to if len(p) > 1 and (whole or (p[s], -s) < (p[to], -to)) else s, whole) for s in p}
        goals = [plans[g][s] for _, _, g, s in rows]
        asked = Counter(goal for (goal, _), r in zip(goals, rows, strict=True) if goal != r[3])
        if not asked:
            return
        for (goal, whole), r in zip(goals, rows, strict=True):
            u = draw(r[2], (k, 4)) if whole else draw(None if r[0] is None else (r[0], 8), (r[1], 4), (k, 4))
            if goal != r[3] and u < min(1.0, max(0, room[goal]) / asked[goal]):
                r[3] = goal


@pytest.mark.parametrize("seed", [1, 2])
def test_label_propagation_equals_plain_loops(spark, seed):
    from lodestone.llm.common import cut
    from lodestone.llm.sharding import propagate

    rnd = random.Random(seed)
    shards, rows = 8, []
    for g, n in enumerate([2, 2, 3, 3, 4, 5, 7, 9, 14, 40, 60, 90] * 2):
        rows += [[rnd.randrange(10**6), 0, f"g{g:02d}", rnd.randrange(shards)] for _ in range(n)]
    rows.append([None, 0, "g09", 3])
    quota = len(rows) // shards + 30
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, dup int, group string, shard int")
    got = propagate(cut(df), shards, quota, 5).select("doc_id", "dup", "group", "shard").collect()
    before = {g: len({r[3] for r in rows if r[2] == g}) for g in {r[2] for r in rows}}
    plain_propagation(rows, shards, quota, 5)
    assert bag(map(tuple, got)) == bag(map(tuple, rows))
    assert sum(len({r[3] for r in rows if r[2] == g}) for g in before) < sum(before.values()) / 2 and max(Counter(r[3] for r in rows).values()) <= 1.25 * quota  # drawn with the share that fits


def test_op10_gathers_as_the_plain_propagation_does(spark, tables):  # noqa: F811
    """The registered query: linked rows are where plain propagation puts them, but for those that the last step moves to even the counts."""
    from lodestone.llm.queries import op10_sharding

    got = op10_sharding(spark, tables[0]).collect()
    groups = Counter(hashlib.md5((t or "").encode()).hexdigest() for _, t, _, _ in ROWS)
    seen, rows = Counter(), []
    for i, t, _, _ in ROWS:
        g = hashlib.md5((t or "").encode()).hexdigest()
        if groups[g] > 1:
            rows.append([i, seen[i, g], g, 0])
            seen[i, g] += 1
    for r in rows:
        h = 42
        for v in (None if r[0] is None else (r[0], 8), (r[1], 4)):
            h = h if v is None else xxhash.xxh64_intdigest(v[0].to_bytes(v[1], "little", signed=True), h)
        r[3] = (h - (h >> 63 << 64)) % 40
    plain_propagation(rows, 40, max(1, len(ROWS) // 40), 6)
    want = Counter((r[0], r[3]) for r in rows)
    have = Counter((r["doc_id"], r["shard"]) for r in got if r["group_size"] > 1)
    assert sum(have.values()) == len(rows) and sum((want & have).values()) >= 0.6 * len(rows)


def plain_words(raw):
    return [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw)]


def plain_features(lexicon, raw):
    w = plain_words(raw)
    n = max(len(w), 1)
    hits = []
    for x in w:
        if x in lexicon:
            hits.append(lexicon.index(x))
    done = set()
    for size in sorted({len(e) - 1 for e in lexicon if e.endswith(b"*")}):
        for x in w:
            if len(x) > size and x[:size] + b"*" in lexicon and x not in done:
                done.add(x)
                hits.append(lexicon.index(x[:size] + b"*"))
    text = raw.decode("latin-1")
    letters = sum(c.isascii() and c.isalpha() for c in text)
    runs = sum(text.count(s) for s in ("###", "$$$", "***"))
    row = [float(k in hits) for k in range(len(lexicon))]
    row += [math.log1p(len(hits)), math.log1p(len(set(hits))), min(100 * len(hits) / n, 20)]
    return row + [sum(c.isascii() and c.isupper() for c in text) / max(letters, 1), min(100 * text.count("!") / n, 20), min(100 * runs / n, 20), float(len(w) < 20)]


TEXTS = [b"", b"You IDIOT!!! total moronic scum ### $$$", b"a quiet day " * 12, "Der Dummkopf, die dummköpfe und Größe".encode(), b"ididiot moron moron MORON dumb", b"!!!! ****** 123", "木村 café trash".encode()]


def test_features_equal_plain_loops():
    from lodestone.llm.toxicity import Model, features

    lexicon = [b"idiot", b"moron", b"scum", b"dumm*", b"dumb", b"moro*", "größe".encode(), b"trash"]
    got = features(Model(lexicon), TEXTS)
    assert got == pytest.approx(np.array([plain_features(lexicon, t) for t in TEXTS]), abs=1e-12)


def labelled(seed, n=600):
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("lo", "ip", "do", "si", "am", "co") for b in ("rem", "sum", "lor", "wen") for c in ("a", "en", "ur", "is", "ot")]
    texts, given = [], []
    for i in range(n):
        bad = i % 3 == 0
        t = [rnd.choice(plain) for _ in range(50)]
        for _ in range(3 if bad else 0):
            t[rnd.randrange(50)] = rnd.choice(["grumpf", "blorg", "snarkle" + rnd.choice("abcd"), "rareinsult" if rnd.random() < 0.02 else "blorg"])
        texts.append(" ".join(t).encode())
        given.append(float(bad != (rnd.random() < 0.03)))
    return texts, np.array(given)


def test_lexicon_holds_what_plain_counting_finds():
    """Whole words: those that the two-proportion test and the share of toxic texts let pass, strongest first."""
    from lodestone.llm.toxicity import lexicon

    texts, given = labelled(1)
    n1, n0 = int(given.sum()), int(len(given) - given.sum())
    passed = []
    for w in {w for t in texts for w in plain_words(t)}:
        a, b = (sum(w in plain_words(t) for t, y in zip(texts, given, strict=True) if y == k) for k in (1, 0))
        if a < max(4, 0.02 * n1) or len(w) < 3:
            continue
        p1, p0, p = a / n1, b / n0, (a + b) / (n1 + n0)
        z = (p1 - p0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        if z >= 4.5 and p1 >= 10 * p0:
            passed.append((-z, w))
    got = lexicon(texts, given, 64, 4.5)
    whole = {w for w in got if not w.endswith(b"*")}
    stems = {w[:-1] for w in got if w.endswith(b"*")}
    assert {w for _, w in passed} >= whole and whole | stems
    # each word that passes is there itself, or by a beginning that stands for it
    assert all(w in whole or any(w.startswith(s) for s in stems) for _, w in passed)
    assert not any(w.startswith(b"rareins") for w in got)  # in under 2 % of the toxic texts
    assert lexicon(texts, given, 2, 4.5) == got[:2]


def test_classifier_is_at_the_least_loss():
    """The gradient vanishes there by finite differences, and no other point of many is better."""
    from lodestone.llm.toxicity import logistic

    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(300, 4))
    target = 1 / (1 + np.exp(-(x @ [1.5, -2, 0, 0.5] - 0.7)))
    weight = rnd.uniform(0.2, 3, 300)
    beta = logistic(x, target, weight)

    def loss(b):
        total = 0.0
        for row, y, w in zip(x, target, weight / weight.mean(), strict=True):
            z = sum(a * c for a, c in zip(row, b, strict=False)) + b[-1]
            total += w * (math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z)
        return total + 0.5 * sum(c * c for c in b[:-1])

    here = loss(beta)
    for k in range(5):
        for step in (1e-3, -1e-3):
            moved = beta.copy()
            moved[k] += step
            assert loss(moved) >= here - 1e-6
    assert all(loss(beta + rnd.normal(0, 0.3, 5)) > here for _ in range(20))


def test_op6_scores_are_those_of_its_model(spark, tables):  # noqa: F811
    from lodestone.llm.common import table
    from lodestone.llm.queries import op6_toxicity, toxicity_model

    docs = table(spark, tables[0], "documents").select("doc_id", "text")
    model = toxicity_model(spark, tables[0], docs)
    got = op6_toxicity(spark, tables[0]).collect()
    if model.weights is None:
        assert {r["score"] for r in got} == {0.0}
        return
    want = []
    for i, t, _, _ in ROWS:
        row = plain_features(model.lexicon, (t or "").encode())
        z = sum(a * b for a, b in zip(row, model.weights, strict=False)) + model.weights[-1]
        want.append((i, round(1 / (1 + math.exp(-z)), 8)))
    assert bag((r["doc_id"], round(r["score"], 8)) for r in got) == bag(want)
