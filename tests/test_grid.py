"""Range joins by cells against comparing all with all."""

import random
import time

from pyspark.sql import functions as F

from quire.operators import grid, objects, redact

BOX = "doc_id long, page long, n long, x0 double, y0 double, x1 double, y1 double"
RECT = "doc_id long, page long, rx double, ry double, rw double, rh double"


def test_pairs_against_all_with_all(spark):
    rng = random.Random(2)
    value = lambda lo, hi: None if rng.random() < 0.03 else rng.choice([rng.uniform(lo, hi), float(64 * rng.randint(0, 9))])
    boxes = [(1, rng.randint(1, 3), k, value(0, 600), value(0, 800), value(0, 600), value(0, 800)) for k in range(150)] + [(1, 1, 999, -1e9, 5.0, 1e9, 6.0), (1, 9, 1000, 0.0, 0.0, 1.0, 1.0)]
    rects = [(1, rng.randint(1, 3), value(0, 600), value(0, 800), value(0, 150), value(0, 150)) for _ in range(60)] + [(1, 2, 0.0, 0.0, 1e7, 1e7)]
    b, r = spark.createDataFrame(boxes * 2, BOX), spark.createDataFrame(rects, RECT)
    meets = lambda lo, hi, a, z: (None in (lo, z) or lo < z) and (None in (hi, a) or hi > a)
    plus = lambda a, c: None if None in (a, c) else a + c

    def hit(s, q):
        x0, y0, x1, y1 = s[3:]
        if None in (x0, y0, x1, y1):
            return True
        return meets(min(x0, x1), max(x0, x1), q[2], plus(q[2], q[4])) and meets(min(y0, y1), max(y0, y1), q[3], plus(q[3], q[5]))

    want = sorted(s[2] for s in boxes * 2 if any(s[:2] == q[:2] and hit(s, q) for q in rects))
    assert sorted(x.n for x in objects.under(b, r).collect()) == want
    one = [(F.col("x0"), F.col("x1"))]
    pairs = grid.meeting(b.where("x0 < x1 AND n < 150").dropDuplicates(["n"]), r.where("rx IS NOT NULL AND rw IS NOT NULL"), ["doc_id", "page"], one, [(F.col("rx"), F.col("rx") + F.col("rw"))])
    want = sorted((s[2], q[2], q[4]) for s in boxes for q in rects if s[2] < 150 and None not in (s[3], s[5], q[2], q[4]) and s[3] < s[5] and s[:2] == q[:2] and s[3] < q[2] + q[4] and s[5] > q[2])
    assert sorted((p.a.n, p.b.rx, p.b.rw) for p in pairs.collect()) == want


def test_a_page_of_many_spans_and_rectangles(spark):
    n = 10_000
    at = lambda seed, most: F.rand(seed) * most
    boxes = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page"), F.col("id").alias("n"), at(1, 600).alias("x0"), at(2, 800).alias("y0")).withColumns({"x1": F.col("x0") + 3, "y1": F.col("y0") + 2}).cache()
    rects = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("page"), at(3, 600).alias("rx"), at(4, 800).alias("ry"), F.lit(4.0).alias("rw"), F.lit(3.0).alias("rh")).cache()
    ranges = ([(F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))], [(F.col("rx"), F.col("rx") + 4), (F.col("ry"), F.col("ry") + 3)])
    began = time.time()
    got = grid.meeting(boxes, rects, ["doc_id", "page"], *ranges, side=16.0).count()
    assert time.time() - began < 30
    b, r = boxes.toPandas().to_numpy(), rects.toPandas().to_numpy()
    want = sum(int(((s[3] < r[:, 2] + 4) & (s[5] > r[:, 2]) & (s[4] < r[:, 3] + 3) & (s[6] > r[:, 3])).sum()) for s in b)
    assert got == want > 1000


def test_lines_of_unknown_place(spark):
    lines = spark.createDataFrame([(1, 1, 1, None, 700.0), (1, 1, 2, 50.0, None), (1, 1, 3, None, 100.0), (1, 2, 1, None, None)], "doc_id long, page long, line_no long, x double, y double").withColumns({"w": F.lit(10.0), "size": F.lit(14.0), "text": F.lit("t")})
    rects = spark.createDataFrame([(1, 1, 40.0, 690.0, 100.0, 30.0)], RECT)
    got = {(x.page, x.line_no): x.coverage for x in redact.coverage_by(lines, rects).collect()}
    assert got == {(1, 1): "full", (1, 2): "full", (1, 3): "none", (2, 1): "none"}
