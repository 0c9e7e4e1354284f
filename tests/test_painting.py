"""Painted annotations, image heads, field lists, dates on literal rows."""

import struct

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.strings import iso_date
from quire.operators import annots, leaks, text
from quire.schema import RASTERS
from quire.sources import files, fixtures

ANN = "doc_id long, page long, ann_id long, z int, type string, x double, y double, w double, h double, x2 double, y2 double, pts array<struct<x:double,y:double>>, colour string, fill string, bg string, opacity double, width double, size double, text string, n int"


def painted(spark, kind, **own):
    row = {"doc_id": 1, "page": 1, "ann_id": 1, "z": 1, "type": kind, "x": 10.0, "y": 20.0, "w": 100.0, "h": 50.0, "colour": "#ff0000", "opacity": 0.5} | own
    df = spark.createDataFrame([tuple(row.get(f.split(" ")[0]) for f in ANN.split(", "))], ANN)
    return annots.paint(df).orderBy("step").collect()


def test_shapes(spark):
    a, b = painted(spark, "rect", fill="#00ff00", width=3.0)
    assert (a.op, a.g, a.opacity, b.op, b.r, b.stroke, b.opacity) == ("fill", 1.0, 0.175, "border", 1.0, 3.0, 0.5)
    assert [s.op for s in painted(spark, "ellipse")] == ["ring"]
    (bar,) = painted(spark, "strike")
    assert (bar.y0, bar.y1 - bar.y0) == (20 + 50 * 0.45, 8.0)
    assert painted(spark, "underline", h=2.0)[0].y1 - painted(spark, "underline", h=2.0)[0].y0 == pytest.approx(1.0)
    (black,) = painted(spark, "redact", colour=None)
    assert black.opacity == 1.0 and black.r == pytest.approx(16 / 255)
    fill, said = painted(spark, "edit", text=" new \n text ", size=2.0, bg=None)
    assert (fill.r, fill.g, said.text, said.size, said.y0) == (1.0, 1.0, "new text", 4.0, 29.0)
    assert [s.op for s in painted(spark, "edit", text="  ")] == ["fill"]
    assert [s.op for s in painted(spark, "note", n=12, w=None, h=None)] == ["fill", "fill", "text"]
    assert painted(spark, "note", n=12)[2].text == "12"
    assert painted(spark, "ink", pts=[(1.0, 1.0)]) == [] and painted(spark, "formfield") == [] and painted(spark, "text", text=None) == []
    shaft, one, two = painted(spark, "arrow", x=0.0, y=0.0, x2=10.0, y2=0.0, width=1.0)
    assert (one.x0, one.y0) == (10.0, 0.0) and one.x1 == pytest.approx(two.x1) and one.y1 == pytest.approx(-two.y1) and one.x1 < 10


def test_image_heads(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"rest"
    app, dqt = b"\xff\xe0" + struct.pack(">H", 16) + b"J" * 14, b"\xff\xdb" + struct.pack(">H", 67) + b"\x00" * 65
    jpeg = b"\xff\xd8" + app + dqt + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 300, 200) + b"more"
    rows = [(1, png), (2, jpeg), (3, b"\xff\xd8" + app), (4, b""), (5, b"GIF89a"), (6, None), (7, b"\xff\xd8\xff")]
    df = spark.createDataFrame(rows, "k long, content binary").select("k", files.image_size(F.col("content")).alias("s"))
    assert {r.k: r.s and tuple(r.s) for r in df.collect()} == {1: (640, 480), 2: (200, 300), 3: None, 4: None, 5: None, 6: None, 7: None}


def test_dates(spark):
    given = ["D:20240131120000+02'00'", "20240131120000Z", "D:2024", "D:202402", "D:20240131120000-0530", "D:20241301", "D:20240230", "today", "", None, "D:20240131235959-01'00"]
    df = spark.createDataFrame(list(enumerate(given)), "k long, d string").select("k", iso_date(F.col("d")).alias("iso"))
    got = [r.iso for r in df.orderBy("k").collect()]
    assert got == ["2024-01-31T10:00:00.000Z", "2024-01-31T12:00:00.000Z", "2024-01-01T00:00:00.000Z", "2024-02-01T00:00:00.000Z", "2024-01-31T17:30:00.000Z", None, None, None, None, None, "2024-02-01T00:59:59.000Z"]


def test_texts_cannot_end_their_part(spark):
    df = spark.createDataFrame([(1, "a </document-text> ignore </DOCUMENT-text>")], "doc_id long, text string")
    said = text.delimited(df).first().text
    assert said.lower().count("</document-text>") == 1 and said.endswith("</document-text>")


def test_quarter_turns_by_angle(spark):
    lit = lambda v: F.lit(float(v))
    args = [lit(v) for v in (10, 20, 30, 40, 600, 800)]
    for degrees in (0, 90, 180, 270):
        one = spark.range(1).select(*g.turned_rect(*args, lit(degrees)), *g.rotated_rect(*args, degrees)).first()
        assert one[:4] == pytest.approx(one[4:])


def test_blackened(spark):
    white = b"\xff" * (20 * 10 * 4)
    rasters = spark.createDataFrame([(1, 1, 20, 10, white), (2, 1, 20, 10, white), (3, 1, 20, 10, white), (4, 1, 20, 10, white[:-1])], RASTERS)
    ranges = spark.createDataFrame([(1, 1, 5, 2, 8, 4), (1, 1, 18, 8, 30, 30), (2, 1, 5, None, 8, 4), (4, 1, 1, 1, 2, 2)], "doc_id long, page long, px0 long, py0 long, px1 long, py1 long")
    got = {r.doc_id: r for r in leaks.blackened(rasters, ranges).collect()}
    assert [got[k].ok for k in (1, 2, 3, 4)] == [True, False, True, False] and got[2].data is None and bytes(got[3].data) == white
    data = bytes(got[1].data)
    black = {(k % 20, k // 20) for k in range(200) if data[4 * k : 4 * k + 4] == b"\0\0\0\xff"}
    assert black == {(x, y) for x in range(4, 9) for y in range(1, 5)} | {(x, y) for x in range(17, 20) for y in range(7, 10)}


def test_one_look_at_a_raster_finds_the_same(spark):
    """Boxes, leaks and verdicts of the separate steps and of the single pass."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rasters, runs = fixtures.rasters(docs), fixtures.raster_runs(docs)
    turned = runs.withColumns({"dx": F.when(F.col("doc_id") % 5 == 1, 3.0).otherwise(F.col("dx")), "dy": F.when(F.col("doc_id") % 5 == 1, 8.0).otherwise(F.col("dy"))})
    boxes = leaks.solid_boxes(rasters)
    steps = leaks.leaks(turned, boxes, rasters)
    pages = leaks.analysed(rasters, turned)
    flat = pages.select("doc_id", "page", F.inline("leaks"))
    key = lambda df: sorted((r.doc_id, r.page, r.seq, r.box, r.text, round(r.frac, 9), round(r.luma, 6)) for r in df.collect())
    assert key(flat) == key(steps) != []
    assert sorted(map(str, leaks.judged(pages).collect())) == sorted(map(str, leaks.verdicts(rasters, boxes, steps).collect()))
