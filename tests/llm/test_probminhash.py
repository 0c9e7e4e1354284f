import random

import numpy as np
import pytest

from quire.llm import components as components_module
from quire.llm import probminhash
from quire.llm.common import checkpoint_dir
from quire.llm.components import components


def shingle_set(text):
    w = (text or "").lower().encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{doc_id: smallest doc_id of its class}."""
    sets = {i: shingle_set(t) for i, t in rows}
    text = {i: t or "" for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            union = len(sets[a] | sets[b])
            if text[a] == text[b] or union and len(sets[a] & sets[b]) >= 0.8 * union:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in ids}


def families(seed, n=12, copies=12):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(5000)}"
            rows.append((k, " ".join(w)))
            k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "One  two"), (k + 4, "one"), (k + 5, rows[0][1])]


@pytest.mark.parametrize("block", [2048, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(probminhash, "BLOCK", block)
    monkeypatch.setattr(probminhash, "LEADERS", 1)
    rows = families(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.class_size) for r in probminhash.report(df).collect()}
    want = brute(rows)
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(n == list(want.values()).count(c) for c, n in got.values())
    left = probminhash.dedup(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_repeated_and_null_ids(spark):
    long = " ".join(map(str, range(40)))
    rows = [(None, long, "a"), (1, long + " x", "b"), (1, long + " x", "b"), (1, "other text of this very id", "c"), (2, "other text of this very id", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(map(str, probminhash.report(df).select("doc_id", "class_id", "class_size").collect()))
    assert len(got) == 5
    assert sorted((str(r.doc_id), r.row) for r in probminhash.dedup(df).collect()) == [("1", "c"), ("None", "a")]
    assert probminhash.report(df.limit(0)).count() == 0 and probminhash.dedup(df.limit(0)).count() == 0


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = (h[:220], 1.0 + rng.random(220)), (h[80:], 1.0 + rng.random(220))
    m = 4096
    s = probminhash.sketch([a, b, a, (h[:0], np.empty(0))], m)
    wa, wb = dict(zip(a[0].tolist(), a[1], strict=True)), dict(zip(b[0].tolist(), b[1], strict=True))
    exact = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in {*wa, *wb}) for d in {*wa} & {*wb})
    assert abs((s[0] == s[1]).mean() - exact) < 4 * (exact / m) ** 0.5
    assert (s[0] == s[2]).all() and (s[3] == 0).all()


@pytest.mark.parametrize("last", [16_384, 20, 0])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(components_module, "LAST", last)
    checkpoint_dir(spark)
    rng = random.Random(2)
    chain = rng.sample(range(400, 500), 40)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(300 + k, 301 + k) for k in range(9)] + [(9, 9), *zip(chain, chain[1:], strict=False)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_copies_that_repeat_a_line_more_often(spark):
    """Plain Jaccard of a pair is (common + 10) / (common + 14), but one repeats a line of ten words 1,000 times."""
    rows = []
    for k in range(120):
        body = [f"b{k}x{i}" for i in range((60, 80, 100)[k % 3])]
        line = [f"l{k}x{i}" for i in range(10)]
        rows += [(2 * k, " ".join(body + line)), (2 * k + 1, " ".join(body + line * 1000))]
    want = brute(rows)
    assert all(want[2 * k + 1] == 2 * k for k in range(120))
    got = {r.doc_id: r.class_id for r in probminhash.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_recall_in_a_large_loose_family(spark, monkeypatch):
    """800 texts of one template, from hardly alike to near copies: families of several blocks that fall apart into many
    classes. The share of brute force's links between different texts that end up within a class."""
    monkeypatch.setattr(probminhash, "BLOCK", 128)
    rng = random.Random(11)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(200):
        w = [f"s{k}x{i}" if rng.random() < 0.04 else x for i, x in enumerate(base)]
        for c in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = f"c{k}y{c}"
            rows.append((4 * k + c, " ".join(v)))
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.class_id for r in probminhash.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(links) > 400 and len(set(got.values())) > 20
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links)
    want = brute(rows)
    assert all(want[i] <= got[i] for i in want)  # nothing is linked that brute force keeps apart


def test_very_long_texts(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(100_000)}" for _ in range(60_000))
    rows = [(1, text), (2, text + " more"), (3, text[: len(text) // 3]), (4, "same " * 100_000), (5, "same " * 90_000)]
    got = {r.doc_id: r.class_id for r in probminhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
