import numpy as np
from oracle import assert_same

from quire.llm import dualtree
from quire.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_query_against_sql_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dualtree, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(dualtree, "CANDIDATE_BLOCK", 30)
    assert_same(QUERIES["op11_hard_negatives"](spark, SF), ORACLE_SQL["op11_hard_negatives"], SF)


def brute(x, low, high, c, k, allowed):
    out = set()
    for a in range(len(x)):
        s = [int(x[a].astype(object) @ c[b].astype(object)) for b in range(len(c))]
        for w in range(low.shape[1]):
            ok = [(-s[b], b) for b in range(len(c)) if low[a, w] <= s[b] <= high[a, w] and allowed(np.array([a]), np.array([b]))[0, 0]]
            out |= {(a, w, b, -n) for n, b in sorted(ok)[:k]}
    return out


def test_search_against_brute_force():
    rng = np.random.default_rng(1)
    for n, m, d, top, clusters in ((50, 300, 6, 40, 0), (70, 500, 4, 200, 8), (40, 400, 3, 2, 0), (1, 1, 1, 5, 0), (33, 65, 8, 2**40, 0), (90, 700, 16, 250, 20)):
        c = rng.integers(-top, top + 1, (m, d))
        if clusters:
            c = c[rng.integers(0, clusters, m)] + rng.integers(-2, 3, (m, d))
        c[: m // 4] = c[0]  # ties
        x = c[rng.choice(m, n, False)]
        mine, theirs = rng.integers(0, 3, n), np.sort(rng.integers(0, 3, m))
        low = rng.integers(-top, top, (n, 3)) * top
        high = low + rng.integers(0, 3 * top, (n, 3)) * top
        for allowed, labels in ((lambda a, b: mine[a, None] != theirs[None, b], (mine, theirs)), (lambda a, b: np.ones((len(a), len(b)), bool), None)):
            s = dualtree.Search(x, low, high, c, 3, allowed, labels)
            assert set(zip(*(v.tolist() for v in s.found()), strict=True)) == brute(x, low, high, c, 3, allowed)


def test_groups_are_pruned():
    rng = np.random.default_rng(2)
    c = rng.integers(-200, 200, (40, 16))[rng.integers(0, 40, 8000)] + rng.integers(-3, 4, (8000, 16))
    s = dualtree.Search(c[:1000], np.full((1000, 1), -np.inf), np.full((1000, 1), np.inf), c, 5, lambda a, b: np.ones((len(a), len(b)), bool))
    assert s.scored < 0.4 * 1000 * 8000


def test_intervals_hold():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 5)), rng.normal(size=(300, 5)) + 1
    p, q = dualtree.Tree(x, 8), dualtree.Tree(y, 16)
    for i in range(len(p.child)):
        for j in range(len(q.child)):
            low, high = dualtree.interval(p, np.array([i]), q, np.array([j]))
            s = x[p.rows(i)] @ y[q.rows(j)].T
            assert low[0] <= s.min() and s.max() <= high[0]


def by_hand(rows):
    """The contract, row by row."""
    seen = [(i, (la + 1) % 10 if i is not None and i % 7 == 0 else la, [int(np.floor(256 * t)) for t in v]) for i, v, la in rows if la is not None and v is not None and all(t is not None and np.isfinite(t) for t in v)]
    dot = lambda a, b: sum(s * t for s, t in zip(a, b, strict=False))
    last = float("inf")
    out, done = [], set()
    for i, la, v in seen:
        if i is None or i % 50 or (i, la, tuple(v)) in done:
            continue
        done.add((i, la, tuple(v)))
        pos = sorted(((-dot(v, w), last if j is None else j) for j, lb, w in seen if lb == la and j != i))[:5]
        for p, j in pos:
            neg = sorted((-dot(v, w), last if k is None else k) for k, lb, w in seen if lb != la and 50 * -p <= 100 * dot(v, w) <= 95 * -p)[:3]
            out += [(i, None if j == last else j, r, None if k == last else k, -p, -n) for r, (n, k) in enumerate(neg, 1)]
    return out


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(t) for t in rng.normal(size=3)], int(rng.integers(0, 3))) for i in range(0, 260, 5)]
    rows += [rows[10], rows[10], rows[11], (None, [1.0, 1.0, 1.0], 1), (None, [0.5, 0.5, 0.5], 2), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf], 1), (4, [None], 1), (6, [1.0], None), (8, [2.0], 0), (50, [], 1), (100, [0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    got = [tuple(r) for r in dualtree.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    want = by_hand(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert dualtree.hard_negatives(df.limit(0)).count() == 0
    assert dualtree.hard_negatives(df.where("vec_id = 50")).count() == 0


def test_components_beyond_doubles(spark):
    rows = [(50 * i, [float(2**40 + i), float(-(2**39) + 3 * i)], i % 3) for i in range(6)] + [(i, [float(2**39 + i), float(i)], i % 3) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in dualtree.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id").collect()]
    assert sorted(got) == sorted(r[:4] for r in by_hand(rows))
