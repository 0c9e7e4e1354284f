"""Text that is still there under painted-over boxes: solid boxes of a raster, text runs under them, a verdict."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import geometry as g
from ..schema import BOXES, CANVASES, LEAKS, RASTERS

DARK, OPAQUE, LEAST_SIDE, MOST_AREA, LEAST_SOLID, HIDDEN = 80, 200, 8, 0.6, 0.85, 110


def _pixels(width: int, height: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Luminance and alpha."""
    p = np.frombuffer(data, np.uint8)[: width * height * 4].reshape(height, width, 4).astype(np.float64)
    return p[..., 0] * 0.2126 + p[..., 1] * 0.7152 + p[..., 2] * 0.0722, p[..., 3]


def _regions(mask: np.ndarray) -> np.ndarray:
    """(count, x0, x1, y0, y1) of each 4-connected region, from horizontal runs joined where runs of neighbouring
    rows overlap."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    parent = np.arange(len(rows))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for r in range(1, mask.shape[0]):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] <= ends[j]:
                i += 1
            else:
                j += 1
    root = np.array([find(i) for i in range(len(rows))], int)
    names, which = np.unique(root, return_inverse=True)
    out = np.empty((len(names), 5), int)
    out[:, 0] = np.bincount(which, ends - starts, len(names))
    for col, values, ufunc, init in ((1, starts, np.minimum, mask.shape[1]), (2, ends - 1, np.maximum, -1), (3, rows, np.minimum, mask.shape[0]), (4, rows, np.maximum, -1)):
        acc = np.full(len(names), init)
        ufunc.at(acc, which, values)
        out[:, col] = acc
    return out


def boxes_of(width: int, height: int, data: bytes) -> list[tuple[int, int, int, int, float]]:
    """Dark opaque regions that fill most of their bounds, neither tiny nor most of the page; top to bottom."""
    if width <= 0 or height <= 0:
        return []
    lum, alpha = _pixels(width, height, data)
    found = []
    for count, x0, x1, y0, y1 in _regions((lum <= DARK) & (alpha >= OPAQUE)).tolist():
        w, h = x1 - x0 + 1, y1 - y0 + 1
        if w >= LEAST_SIDE and h >= LEAST_SIDE and w * h <= width * height * MOST_AREA and count / (w * h) >= LEAST_SOLID:
            found.append((x0, y0, w, h, count / (w * h)))
    return sorted(found, key=lambda b: (b[1], b[0]))


def solid_boxes(rasters: DataFrame) -> DataFrame:
    """A row per solid box of each page's raster, numbered in reading order. One raster is one row: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.doc_id, r.page, k, *b) for r in pdf.itertuples() for k, b in enumerate(boxes_of(r.width, r.height, r.data))]
            yield pd.DataFrame(rows, columns=BOXES.fieldNames())

    return rasters.select(*RASTERS.fieldNames()).mapInPandas(run, BOXES)


#: Pixels by which a range to be blackened grows on every side.
GROWN = 1


def blackened(rasters: DataFrame, ranges: DataFrame) -> DataFrame:
    """rasters with (doc_id, page, px0, py0, px1, py1) of them, ends excluded and grown by a pixel, painted an opaque black, and the
    column ok. Where a range has a null (objects.image_pixels: no inverse) or data is too short, the page is not ok and its data is
    null: a picture of which nobody knows what is covered. Rasters without ranges stay as they are."""
    wanted = ranges.groupBy("doc_id", "page").agg(F.collect_set(F.struct("px0", "py0", "px1", "py1")).alias("ranges"))
    kinds = to_arrow_schema(T.StructType([*RASTERS.fields, T.StructField("ok", T.BooleanType())]))

    def painted(width: int, height: int, data: bytes | None, ranges: list[dict] | None) -> bytes | None:
        if data is None or not ranges:
            return data
        if len(data) < width * height * 4 or any(v is None for r in ranges for v in r.values()):
            return None
        p = np.frombuffer(data, np.uint8).copy()
        frame = p[: width * height * 4].reshape(height, width, 4)
        for r in ranges:
            frame[max(0, r["py0"] - GROWN) : max(0, r["py1"] + GROWN), max(0, r["px0"] - GROWN) : max(0, r["px1"] + GROWN)] = (0, 0, 0, 255)
        return p.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a raster at a time
                data = painted(*(batch.column(c)[k].as_py() for c in range(2, 6)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(4)), pa.array([data], pa.binary()), pa.array([data is not None])], schema=kinds)

    rows = rasters.join(wanted, ["doc_id", "page"], "left").select(*RASTERS.fieldNames(), "ranges")
    return rows.mapInArrow(run, T.StructType([*RASTERS.fields, T.StructField("ok", T.BooleanType())]))


class Luminance:
    """Sums of a raster's luminance over rectangles, from one table of running sums."""

    def __init__(self, width: int, height: int, data: bytes):
        self.width, self.height = width, height
        self.sums = np.pad(_pixels(width, height, data)[0].cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def mean(self, x: float, y: float, w: float, h: float) -> float:
        """Mean luminance under a rectangle, clipped to the raster; 255 if nothing is left of it."""
        x0, y0 = max(0, math.floor(x)), max(0, math.floor(y))
        x1, y1 = min(self.width, math.ceil(x + w)), min(self.height, math.ceil(y + h))
        if x1 <= x0 or y1 <= y0:
            return 255.0
        s = self.sums
        return float(s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]) / ((x1 - x0) * (y1 - y0))


def canvases(rasters: DataFrame) -> DataFrame:
    """(doc_id, page, blank, r, g, b): is a raster of one colour all over, and its mean colour. An empty raster is blank and
    white."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                p = np.frombuffer(r.data, np.uint8)[: r.width * r.height * 4].reshape(-1, 4)[:, :3]
                rows.append((r.doc_id, r.page, bool((p == p[:1]).all()), *(p.mean(0).tolist() if len(p) else [255.0] * 3)))
            yield pd.DataFrame(rows, columns=CANVASES.fieldNames())

    return rasters.select(*RASTERS.fieldNames()).mapInPandas(run, CANVASES)


def covered_runs(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Runs with a part under a box: (doc_id, page, seq, box, text, span). Joined by page, boxes being few per page."""
    b = boxes.select("doc_id", "page", "box", *(F.col(c).cast("double").alias(f"b{c}") for c in "xywh"))
    span = g.covered(F.col("text"), *(F.col(c) for c in ("x", "y", "dx", "dy", "height", "bx", "by", "bw", "bh")))
    joined = runs.where(F.trim("text") != "").join(b, ["doc_id", "page"]).withColumn("span", span).where(F.col("span").isNotNull())
    return joined.select("doc_id", "page", "seq", "box", F.trim(F.substring(F.col("text"), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))).alias("text"), "span").where(F.col("text") != "")


def leaks(runs: DataFrame, boxes: DataFrame, rasters: DataFrame) -> DataFrame:
    """Covered text whose place is dark: painted over and still in the file. Light text printed on a box is none.

    A page's covered runs are gathered and meet its raster once, which is read once for all of them."""
    fields = ["seq", "box", "text", "frac", "x", "y", "w", "h"]
    found = covered_runs(runs, boxes).select("doc_id", "page", "seq", "box", "text", F.col("span.frac").alias("frac"), "span.rect.*")
    pages = rasters.join(found.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*fields)).alias("runs")), ["doc_id", "page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, width, height, data, covered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                light = Luminance(width, height, data)
                for r in covered:
                    luma = light.mean(r["x"], r["y"], r["w"], r["h"])
                    if luma <= HIDDEN:
                        rows.append((doc, page, r["seq"], r["box"], r["text"], r["frac"], luma))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    kinds = to_arrow_schema(LEAKS)
    return pages.select("doc_id", "page", "width", "height", "data", "runs").mapInArrow(run, LEAKS)


def verdicts(pages: DataFrame, boxes: DataFrame, found: DataFrame) -> DataFrame:
    """A row per document: boxes, leaked strings, pages with leaks and the verdict leaks, clean or no-boxes."""
    b = boxes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("boxes"))
    s = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("leaked"), F.array_join(F.array_sort(F.collect_set("page")), ",").alias("pages_with_leaks"))
    out = pages.select("doc_id").distinct().join(b, "doc_id", "left").join(s, "doc_id", "left").fillna(0, ["boxes", "leaked"]).fillna("", ["pages_with_leaks"])
    return out.withColumn("verdict", F.when(F.col("leaked") > 0, "leaks").when(F.col("boxes") > 0, "clean").otherwise("no-boxes"))


def _under(run: dict, box: tuple) -> tuple[int, int, float, tuple[float, float, float, float]] | None:
    """geometry.covered for one run and one box: (start, end, frac, rectangle), None if too little is covered."""
    n, height, chars = math.hypot(run["dx"], run["dy"]), run["height"], len(run["text"])
    if n <= 0 or height <= 0:
        return None
    c, s = run["dx"] / n, run["dy"] / n
    bx, by, bw, bh = box[:4]
    mx, my = bx + bw / 2 - run["x"], by + bh / 2 - run["y"]
    along, across = mx * c + my * s, my * c - mx * s
    half, thick = (abs(c) * bw + abs(s) * bh) / 2, (abs(s) * bw + abs(c) * bh) / 2
    a0, a1 = max(0.0, along - half), min(n, along + half)
    t0, t1 = max(0.0, across - thick), min(height, across + thick)
    first, last = math.floor(chars * a0 / n), min(chars, math.ceil(chars * a1 / n))
    if not (a1 > a0 and t1 > t0 and t1 - t0 >= height * g.LEAST_BAND and a1 - a0 >= n * g.LEAST_SHARE and last > first):
        return None
    long, middle = a1 - a0, (a0 + a1) / 2
    rw, rh = abs(c) * long + abs(s) * height, abs(s) * long + abs(c) * height
    px, py = run["x"] + c * middle - s * height / 2, run["y"] + s * middle + c * height / 2
    return first, last, long / n, (px - rw / 2, py - rh / 2, rw, rh)


def analysed(rasters: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, page, boxes, leaks): how many solid boxes each page's raster has, and what leaks' rows are, as structs (seq, box, text, frac,
    luma). A raster is read once; its runs come to it."""
    kind = "doc_id bigint, page bigint, boxes bigint, leaks array<struct<seq:bigint,box:int,text:string,frac:double,luma:double>>"
    said = runs.where(F.trim("text") != "").groupBy("doc_id", "page").agg(F.collect_list(F.struct("seq", "text", "x", "y", "dx", "dy", "height")).alias("runs"))
    item = pa.struct([("seq", pa.int64()), ("box", pa.int32()), ("text", pa.string()), ("frac", pa.float64()), ("luma", pa.float64())])

    def of(width: int, height: int, data: bytes, runs: list[dict]) -> tuple[int, list[dict]]:
        boxes = boxes_of(width, height, data)
        hits = [(r, k, got) for k, b in enumerate(boxes) for r in runs if (got := _under(r, b)) and r["text"][got[0] : got[1]].strip(" ")]
        light = Luminance(width, height, data) if hits else None
        rows = [{"seq": r["seq"], "box": k, "text": r["text"][a:b].strip(" "), "frac": frac, "luma": light.mean(*rect)} for r, k, (a, b, frac, rect) in hits]
        return len(boxes), [r for r in rows if r["luma"] <= HIDDEN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(*(batch.column(c)[k].as_py() for c in (2, 3, 4)), batch.column(5)[k].as_py() or []) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([rows for _, rows in found], pa.list_(item))], names=["doc_id", "page", "boxes", "leaks"])

    return rasters.join(said, ["doc_id", "page"], "left").select(*RASTERS.fieldNames(), "runs").mapInArrow(run, kind)


def judged(pages: DataFrame) -> DataFrame:
    """verdicts' rows from analysed ones."""
    n = F.size("leaks")
    out = pages.groupBy("doc_id").agg(F.sum("boxes").alias("boxes"), F.sum(n).cast("bigint").alias("leaked"), F.array_join(F.array_sort(F.collect_set(F.when(n > 0, F.col("page")))), ",").alias("pages_with_leaks"))
    return out.withColumn("verdict", F.when(F.col("leaked") > 0, "leaks").when(F.col("boxes") > 0, "clean").otherwise("no-boxes"))


def text_runs(items: DataFrame, viewport, scale: float) -> DataFrame:
    """Text items (doc_id, page, seq, str, transform, width) as device runs under a page's viewport matrix.

    Widths are in points, so the advance is the width times the scale, along the composed matrix's first axis."""
    m = g.compose(viewport, F.col("transform"))
    rows = items.where((F.trim("str") != "") & F.col("transform").isNotNull() & (F.col("width") > 0)).withColumn("m", m)
    along, tall = F.hypot(F.col("m")[0], F.col("m")[1]), F.hypot(F.col("m")[2], F.col("m")[3])
    advance = F.col("width") * scale
    return rows.where((along > 0) & (tall > 0)).select("doc_id", "page", "seq", F.col("str").alias("text"), F.col("m")[4].alias("x"), F.col("m")[5].alias("y"), (F.col("m")[0] / along * advance).alias("dx"), (F.col("m")[1] / along * advance).alias("dy"), tall.alias("height"))
