import hashlib
import random

import pytest
from oracle import assert_same

from quire.llm import rlz
from quire.llm.queries import ORACLE_SQL, QUERIES


def brute(rows, width=20):
    """{doc_id: kept words} for rows with unique ids."""
    first, cut = {}, {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        w = words[i]
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in first:
                cut.setdefault(i, set()).update(range(s, s + width))
            else:
                first[key] = (i, s)
    return {i: [x for k, x in enumerate(w) if k not in cut.get(i, ())] for i, w in words.items()}


def planted(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randint(18, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += [word() for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w += p[a : len(p) - rng.randint(0, 5)]
            if rng.random() < 0.2:
                w += ["same"] * rng.randint(1, 60)
        rows.append((7 * i, "\n ".join(w)))
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1002, None), (1003, ""), (1004, "too short")]
    return rows


@pytest.mark.parametrize("seed, block, width", [(1, 64, 20), (2, 2, 20), (3, 64, 20), (3, 1, 20), (4, 64, 100), (4, 3, 7), (5, 64, 200)])
def test_exact(spark, monkeypatch, seed, block, width):
    """block: how many different segments are compared with each other; beyond that windows are looked up."""
    monkeypatch.setattr(rlz, "BLOCK", block)
    rows = planted(seed, vocabulary=3 if seed == 3 else 400)
    if width >= 100:
        long = " ".join(f"z{k}" for k in range(400))
        rows += [(2000, long), (2001, long + " x"), (2002, "y " + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, width)
    got = {r.doc_id: r for r in rlz.digests(df, width).collect()}
    for i, kept in want.items():
        assert got[i].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest(), i
    assert len(got) == len(rows)


def test_general_interface(spark):
    p = " ".join(f"p{k}" for k in range(25))
    rows = [(1, f"a b  {p} c", "x", 1), (2, f"d {p}", "y", 2), (2, f"d {p}", "y", 2), (2, "other", None, 3), (None, p, "z", 4), (5, None, "n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, n int")
    got = sorted(((r.doc_id, r.text, r.row, r.n, [tuple(s) for s in r.removed]) for r in rlz.dedup(df).collect()), key=str)
    want = [(None, p, "z", 4, []), (1, "a b c", "x", 1, [(2, 27)]), (2, "d", "y", 2, [(1, 26)]), (2, "d", "y", 2, [(1, 26)]), (2, "other", None, 3, []), (5, None, "n", 5, [])]
    assert got == sorted(want, key=str)
    assert rlz.dedup(df.limit(0)).count() == 0


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES["op5_rlz_substrings"](spark, sf), ORACLE_SQL["op5_rlz_substrings"], sf)


def test_widths_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for width, gram in ((5, 6), (6 + (1 << 16), 6), (20, 0)):
        with pytest.raises(ValueError):
            rlz.digests(df, width, gram)


def test_factors_are_longest_matches():
    """Three segments of a block: the second copies the first's right part, the third both in two overlapping factors."""
    import numpy as np

    slots = np.arange(1, 35, dtype=np.uint64)
    other = slots + np.uint64(100)
    a, b, c = slots.copy(), slots.copy(), slots.copy()
    a[27:] = other[27:]  # agrees with c in slots 0 to 26
    b[:7] = other[:7]  # agrees with c in slots 7 to 33, with a in 7 to 26
    who, first, end = rlz.parse(np.array([5, 5, 5]), np.stack([a, b, c]), np.array([[0, 14]] * 3), 6, 20)
    assert sorted(zip(who.tolist(), first.tolist(), end.tolist(), strict=True)) == [(1, 7, 27), (2, 0, 27), (2, 8, 34)]
