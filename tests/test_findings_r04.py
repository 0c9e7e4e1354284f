"""Cases in which registered queries gave other rows than their SQL, or wrote far more than their input."""

import random
import time

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from quire.operators import grid, grouping, objects
from quire.plans import queries as q


def table(spark, tmp_path, *texts):
    """A folder with these texts as its documents."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/out")
    next(tmp_path.glob("out/*.parquet")).rename(tmp_path / "documents.parquet")
    return str(tmp_path)


def test_versions_meet_in_every_partition(spark, tmp_path):
    """blocks were numbered by an int on one side and a long on the other, which are dealt to different partitions."""
    sf = table(spark, tmp_path, *(f"head {k % 40}\nline {k}\nlast" for k in range(240)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert_same(q.QUERIES["diff_sizes"](spark, sf), q.ORACLE_SQL["diff_sizes"], sf)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plain_text_of_pages_without_words(spark, tmp_path):
    """F8: a page without a word has no text, not an empty one."""
    sf = table(spark, tmp_path, "", "  ", "a  b\n \n c", "\n" * 25 + "d", "x\n" * 25, None)
    assert_same(q.QUERIES["page_plain_text"](spark, sf), q.ORACLE_SQL["page_plain_text"], sf)


def shuffled(spark, df):
    """Bytes that the tasks of a query write for others."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def total():
        bus.waitUntilEmpty()
        time.sleep(0.3)
        found = store.executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


#: Most bytes of shuffle for a byte of text, by query.
DISK = {"spans_under_rects": 0.2, "clear_structure": 0.1, "vector_plans": 0.5, "export_refusals": 0.5, "export_pages": 3.0, "clone_segments": 0.3, "clone_edges": 0.15}


@pytest.mark.parametrize("name", list(DISK))
def test_shuffle_of_long_lines(spark, tmp_path, name):
    """Lines that reach over many cells of a page were repeated in each, with their texts."""
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxy", k=rng.randint(2, 9))) for _ in range(rng.randint(5, 200)))
    texts = ["\n".join(rng.choice(["", "license of the ", "the "]) + line() for _ in range(rng.randint(1, 40))) for _ in range(60)]
    sf = table(spark, tmp_path, *texts)
    assert shuffled(spark, q.QUERIES[name](spark, sf)) < DISK[name] * sum(map(len, texts))
    assert_same(q.QUERIES[name](spark, sf), q.ORACLE_SQL[name], sf)


def test_pages_with_few_and_with_many_rectangles(spark):
    """both ways of comparing in one table; copies of a row stay as many."""
    rng = random.Random(7)
    boxes = [(1, rng.randint(1, 3), k, rng.choice([None, rng.uniform(0, 500)]), rng.uniform(0, 700), rng.uniform(0, 9000), rng.uniform(0, 700)) for k in range(60)] * 2
    rects = [(1, p, rng.uniform(0, 500), rng.uniform(0, 700), 30.0, 30.0) for p, n in ((1, 3), (2, grid.FEW + 9)) for _ in range(n)]
    b = spark.createDataFrame(boxes, "doc_id long, page long, n long, x0 double, y0 double, x1 double, y1 double")
    r = spark.createDataFrame(rects, "doc_id long, page long, rx double, ry double, rw double, rh double")

    def hit(s, t):
        if s[3] is None:
            return True
        return min(s[3], s[5]) < t[2] + t[4] and max(s[3], s[5]) > t[2] and min(s[4], s[6]) < t[3] + t[5] and max(s[4], s[6]) > t[3]

    want = sorted(s[2] for s in boxes if any(s[1] == t[1] and hit(s, t) for t in rects))
    assert sorted(x.n for x in objects.under(b, r).collect()) == want
    x, y = (F.col("x0"), F.col("x1")), (F.col("rx"), F.col("rx") + F.col("rw"))
    pairs = grid.meeting(b.where("x0 < x1").distinct(), r, ["doc_id", "page"], [x], [y], how="left").collect()
    apart = [s for s in set(boxes) if s[3] is not None and s[3] < s[5]]
    want = sorted((s[2], t[2]) for s in apart for t in rects if s[1] == t[1] and s[3] < t[2] + t[4] and s[5] > t[2])
    assert sorted((p.a.n, p.b.rx) for p in pairs if p.b) == want and {p.a.n for p in pairs} == {s[2] for s in apart}


def test_cells_look_only_at_runs_that_columns_cross(monkeypatch):
    """every run was compared with every column of its row by itself; now only one that a column crosses is."""
    asked, cut = [], grouping._cut
    monkeypatch.setattr(grouping, "_cut", lambda *a: asked.append(a[0]) or cut(*a))
    rows = [("name", 50.0, 30.0), ("qty", 200.0, 20.0)] * 3 + [("name qty", 50.0, 170.0)]
    text, x, w = zip(*rows, strict=True)
    items = {"str": np.array(text, object), "x": np.array(x), "y": np.array([700.0, 700.0, 680.0, 680.0, 660.0, 660.0, 640.0]), "w": np.array(w), "size": np.full(7, 14.0)}
    items["x"][6], items["str"][6] = 50.0, "name qty"
    many = {n: np.concatenate([v, v[:2]]) for n, v in items.items()}
    many["y"][-2:] = 640.0
    cells = grouping._cells(many)
    assert [c[2] for c in cells[:6]] == ["name", "qty"] * 3 and set(asked) == {"name qty"}
