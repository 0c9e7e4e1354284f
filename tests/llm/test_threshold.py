import numpy as np
from oracle import assert_same

from quire.llm import threshold
from quire.llm.queries import ORACLE_SQL, QUERIES


def brute(q, q_ids, c, c_ids, k):
    out = {}
    for i, v in enumerate(q):
        s = [(-int(v.astype(object) @ w.astype(object)), int(n), j) for j, (w, n) in enumerate(zip(c, c_ids, strict=True)) if n != q_ids[i]]
        out[i] = [(j, -x) for x, _, j in sorted(s)[:k]]
    return out


def test_cell_against_brute_force():
    rng = np.random.default_rng(5)
    for n, m, d, top in ((300, 20, 8, 50), (40, 5, 3, 2), (10, 3, 2, 1), (900, 10, 16, 3), (200, 8, 4, 2**30)):
        c = rng.integers(-top, top + 1, (n, d))
        c[: n // 3] = c[0]  # a common vector: ties by id
        ids = np.sort(rng.choice(10 * n, n, False))
        pick = rng.choice(n, min(m, n), False)
        rows, cols, scores = threshold.top_in_cell(c[pick], ids[pick], c, ids, 20)
        got = {}
        for r, j, s in zip(rows.tolist(), cols.tolist(), scores.tolist(), strict=True):
            got.setdefault(r, []).append((j, s))
        want = brute(c[pick], ids[pick], c, ids, 20)
        assert {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [2.0]), (None, [9.0, 9.0]), (0, [1.0, 2.0]), (7, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in threshold.nearest(df).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, 1, None, 64 * 576 + 128 * 576), (0, 2, 20, 64 * 64 + 128 * 128), (0, 3, 6, 128 * 64), (0, 4, 1, 32 * 64 + 32 * 128), (0, 5, 7, 32 * 64 + 32 * 128)]
    assert [g[2] for g in got if g[0] == 20] == [None, 0, 0, 6, 1, 7]
    assert threshold.nearest(df.limit(0)).count() == 0
    assert threshold.nearest(df.where("vec_id = 0")).count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(threshold, "QUERY_BLOCK", 8)
    monkeypatch.setattr(threshold, "CANDIDATE_BLOCK", 100)
    sf = "/root/testdata/sf0.001"
    assert_same(QUERIES["op10_threshold_topk"](spark, sf), ORACLE_SQL["op10_threshold_topk"], sf)
