"""Reachability and copies of forms on small tables."""

import pytest
from pyspark.sql import functions as F

from quire.operators import forms, objects, reach
from quire.operators.reach import walk


def lattice(n):
    return [(i * n + j, a * n + b) for i in range(n) for j in range(n) for a, b in ((i + 1, j), (i, j + 1)) if a < n and b < n]


CHAIN = [(k, k + 1) for k in range(1000)]
LAYERS = [(0, k) for k in range(1, 6)] + [(a * 5 + i + 1, (a + 1) * 5 + j + 1) for a in range(6) for i in range(5) for j in range(5)]


def test_walk():
    assert walk(CHAIN, [0]) == [(k, k, k) for k in range(1001)]
    assert walk(CHAIN, [990, 995])[-1] == (1000, 5, 10)
    assert sorted(walk(lattice(10), [0])) == [(i * 10 + j, i + j, i + j) for i in range(10) for j in range(10)]
    assert sorted(walk([(1, 2), (2, 3), (3, 2), (1, 4), (3, 5)], [1])) == [(1, 0, 0), (2, 1, None), (3, 2, None), (4, 1, 1), (5, 3, None)]
    assert walk([(1, 1)], [1]) == [(1, 0, None)]
    assert len(walk(LAYERS, [0])) == 36
    assert walk([(1, 2)], [7]) == [(7, 0, 0)]


@pytest.mark.parametrize("most", [10**6, 0])
def test_reached(spark, monkeypatch, most):
    """Within rows and by rounds."""
    monkeypatch.setattr(reach, "TASK_EDGES", most)
    monkeypatch.setattr(reach, "ROUNDS", 4)
    graphs = {1: CHAIN[:12], 2: LAYERS, 3: [(1, 2), (2, 1), (2, 3)], 4: lattice(4), 5: [(None, 1), (1, None)]}
    edges = spark.createDataFrame([(d, a, b) for d, e in graphs.items() for a, b in e + e], "doc_id long, parent long, child long")
    seeds = spark.createDataFrame([(1, 2), (1, 5), (2, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 9), (7, None)], "doc_id long, node long")
    got = sorted((r.doc_id, r.node, r.nearest) for r in reach.reached(edges, seeds, ["doc_id"]).collect())
    want = [(d, n, k) for d, roots in ((1, [2, 5]), (2, [0]), (3, [1]), (4, [0]), (5, [1]), (6, [9])) for n, k, _ in walk([(a, b) for a, b in graphs.get(d, []) if None not in (a, b)], roots)]
    assert got == sorted(want)
    assert reach.reached(edges.limit(0), seeds, ["doc_id"]).count() == 7
    assert reach.reached(edges, seeds.limit(0), ["doc_id"]).count() == 0


def test_long_chains(spark):
    edges = spark.createDataFrame([(1, f"o{a}", f"o{b}") for a, b in CHAIN], "doc_id long, parent string, child string")
    rows = spark.createDataFrame([(1, f"o{k}") for k in range(1001)] + [(1, "orphan")], "doc_id long, node string")
    root = rows.where("node = 'o0'")
    assert objects.rebuilt(rows, edges, root).count() == 1001
    assert [r.node for r in objects.purge(rows, edges, root).collect()] == ["orphan"]


def test_fields_are_cleared_to_the_top(spark):
    fields = spark.createDataFrame([(1, k, k - 1 if k else None, "secret", "secret") for k in range(30)] + [(1, 99, None, "kept", None)], "doc_id long, field long, parent long, value string, default_value string")
    widgets = spark.createDataFrame([(1, 1, 29, 0.0, 0.0, 5.0, 5.0)], "doc_id long, page long, field long, x0 double, y0 double, x1 double, y1 double")
    rects = spark.createDataFrame([(1, 1, 1.0, 1.0, 2.0, 2.0)], "doc_id long, page long, rx double, ry double, rw double, rh double")
    out = objects.clear_fields(widgets, fields, rects)
    assert [r.field for r in out.where("NOT cleared").collect()] == [99]
    assert out.where("cleared AND (value IS NOT NULL OR default_value IS NOT NULL)").count() == 0


def test_depth_of_forms(spark):
    rows = []
    for page, edges in ((1, [(k, k + 1) for k in range(8)]), (2, [(k, k + 1) for k in range(9)]), (3, [(0, 1), (1, 0)]), (4, LAYERS), (5, [])):
        rows += [(1, page, None, 0, "form"), *((1, page, a, b, "form") for a, b in edges)]
    rows += [(1, 5, 0, 77, "image"), (1, 6, None, 77, "image")]
    uses = spark.createDataFrame(rows, "doc_id long, page long, parent long, child long, kind string")
    got = {r.page: (r.forms, r.deepest, r.images_within, r.ok) for r in objects.nested_forms(uses).collect()}
    assert got == {1: (9, 8, 0, True), 2: (10, 9, 0, False), 3: (2, None, 0, False), 4: (36, 7, 0, True), 5: (1, 0, 1, False), 6: (0, 0, 0, True)}


UNIT = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
USES = "doc_id long, page long, parent string, name string, child string, kind string, m array<double>"


def moved(x, y):
    return [1.0, 0.0, 0.0, 1.0, float(x), float(y)]


def test_uses_of_forms():
    uses = [(1, None, "A", "a", "form", moved(10, 0)), (None, "a", "B", "b", "form", [2.0, 0.0, 0.0, 2.0, 0.0, 5.0]), (None, "a", "C", "b", "form", UNIT), (2, None, "A", "i", "image", UNIT)]
    assert sorted(forms.list_uses(uses)) == sorted([(1, ["A"], "a", moved(10, 0), None), (1, ["A", "B"], "b", [2.0, 0.0, 0.0, 2.0, 10.0, 5.0], None), (1, ["A", "C"], "b", moved(10, 0), None)])
    deep = [(1, None, "x", "f0", "form", UNIT)] + [(None, f"f{k}", "x", f"f{k + 1}", "form", UNIT) for k in range(9)]
    assert forms.list_uses(deep) == [(1, None, None, None, forms.DEEP)]
    assert len(forms.list_uses(deep[:-1])) == 9
    assert forms.list_uses([(1, None, "x", "f", "form", UNIT), (None, "f", "x", "f", "form", UNIT)])[0][-1] == forms.DEEP
    assert forms.list_uses([(1, None, "x", "f", "form", UNIT), (None, "f", "x", "i", "image", UNIT)])[0][-1] == forms.IMAGE
    wide = [(1, None, "x", "f0", "form", UNIT)] + [(None, f"f{k}", n, f"f{k + 1}", "form", UNIT) for k in range(8) for n in "abcde"]
    assert forms.list_uses(wide)[0][-1] == forms.MANY


def test_copies_of_shared_forms(spark):
    """One form on two pages, of which one is redacted."""
    uses = spark.createDataFrame([(1, 1, None, "A", "a", "form", moved(0, 100)), (1, 2, None, "A", "a", "form", moved(0, 100)), (1, None, "a", "B", "b", "form", moved(0, 50)), (1, None, "a", "C", "c", "form", UNIT)], USES)
    segments = spark.createDataFrame([(1, "b", 1, "secret", 0.0, 0.0, 40.0, 10.0), (1, "b", 2, "public", 0.0, 300.0, 40.0, 10.0), (1, "c", 1, "other", 0.0, 0.0, 40.0, 10.0), (1, "a", 1, "own", 0.0, 400.0, 40.0, 10.0)], "doc_id long, form string, seq int, text string, x double, y double, w double, size double")
    rects = spark.createDataFrame([(1, 1, -1.0, 140.0, 60.0, 30.0)], "doc_id long, page long, rx double, ry double, rw double, rh double")
    out = forms.clone_on_write(uses, segments, rects)
    edges = {(r.page, r.parent, r.name, r.target) for r in out.edges.collect()}
    assert edges == {(1, None, "A", "p1:A"), (2, None, "A", "a"), (1, "p1:A", "B", "p1:A/B"), (1, "p1:A", "C", "c"), (None, "a", "B", "b"), (None, "a", "C", "c")}
    assert {(r.form, r.seq, r.text) for r in out.segments.collect()} == {("p1:A", 1, "own"), ("p1:A/B", 2, "public")}
    assert out.refused.count() == 0
    turned = uses.withColumn("m", F.when(F.col("name") == "C", F.array(*(F.lit(v) for v in (0.0, 1.0, -1.0, 0.0, 0.0, 0.0)))).otherwise(F.col("m")))
    assert ("p1:A", "C", "p1:A/C") in {(r.parent, r.name, r.target) for r in forms.clone_on_write(turned, segments, rects).edges.collect()}
    cyclic = uses.unionByName(spark.createDataFrame([(1, None, "c", "up", "a", "form", UNIT)], USES))
    out = forms.clone_on_write(cyclic, segments, rects)
    assert [(r.page, r.reason) for r in out.refused.collect()] == [(1, forms.DEEP)]
    assert out.segments.count() == 0
