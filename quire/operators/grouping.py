"""Four ways of putting positioned text together into lines; they differ on purpose and are never merged.

All of them take a page as one row that holds its items (`nested`, or `text_documents.page_words` without a shuffle).
compare_lines is a column expression. The others place items in an order that matters; they turn a page's items into arrays and
give a row at a time what belongs to it. A page is bounded by what fits on it, not by the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.strings import collapse
from ..schema import CELLS, GROUPED_LINES, OCR_LINES


def nested(items: DataFrame) -> DataFrame:
    """(doc_id, page, items): flat items gathered by page, in input order (seq)."""
    own = [c for c in items.columns if c not in ("doc_id", "page")]
    rows = items.select("doc_id", "page", F.struct("seq", *(c for c in own if c != "seq")).alias("i"))
    return rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("i")).alias("items"))


def _pages(items: DataFrame) -> DataFrame:
    return items.select("doc_id", "page", "items") if "items" in items.columns else nested(items)


def compare_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, y, text): items whose baselines round to the same even number, left to right, joined by a blank. All pages of a
    batch are sorted at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends, flat = np.asarray(lists.offsets), lists.values
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            flat = flat.slice(int(ends[0]), len(of))
            field = lambda n: flat.field(n)  # noqa: B023, E731
            x, y, w = (pc.fill_null(field(n).cast(pa.float64()), np.nan).to_numpy() for n in ("x", "y", "w"))
            use = np.flatnonzero(pc.fill_null(pc.not_equal(pc.utf8_trim(field("str"), " "), ""), False).to_numpy(zero_copy_only=False) & (w > 0) & np.isfinite(y))
            level = (np.floor(y[use] / 2 + 0.5) * 2).astype(np.int64)
            order = np.lexsort((field("seq").to_numpy()[use], x[use], level, of[use]))
            use, level = use[order], level[order]
            page = of[use]
            opens = np.flatnonzero(np.r_[True, (page[1:] != page[:-1]) | (level[1:] != level[:-1])]) if len(use) else use
            words = pa.ListArray.from_arrays(pa.array(np.r_[opens, len(use)].astype(np.int32)), field("str").take(pa.array(use)))
            at = pa.array(page[opens])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(level[opens]), pc.binary_join(words, " ")], names=["doc_id", "page", "y", "text"])

    pages = _pages(items)
    kinds = dict(pages.dtypes)
    rows = pages.mapInArrow(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, y bigint, text string")
    return rows.withColumn("text", collapse(F.col("text"))).where(F.col("text") != "")


Arrays = dict[str, np.ndarray]


def _by_page(items: DataFrame, make: Callable[[Arrays], list[tuple]], schema: T.StructType) -> DataFrame:
    """make's rows for each page; it gets the items' fields as arrays, texts as objects."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column(2), []
            ends, flat = np.asarray(lists.offsets), lists.values
            fields = {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}
            for k, (doc, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = {n: v[ends[k] : ends[k + 1]] for n, v in fields.items()}
                rows += [(doc, page, *r) for r in make(own)]
            columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return _pages(items).mapInArrow(run, schema)


def _take(a: Arrays, which: np.ndarray) -> Arrays:
    return {n: v[which] for n, v in a.items()}


def baseline_lines(items: DataFrame) -> DataFrame:
    """Lines of items within 2 points of the baseline of the line's first item, in input order; top to bottom, joined
    without blanks."""

    def make(a: Arrays) -> list[tuple]:
        left = _take(a, np.flatnonzero(a["str"] != ""))
        lines = []
        while len(left["y"]):  # the first item left opens a line, and all that is near enough goes with it
            near = np.abs(left["y"] - left["y"][0]) <= 2
            line, left = _take(left, near), _take(left, ~near)
            lines.append((line["y"][0], _take(line, np.argsort(line["x"], kind="stable"))))
        lines.sort(key=lambda r: -r[0])
        return [(n, "".join(line["str"]), line["x"][0], y) for n, (y, line) in enumerate(lines, 1)]

    return _by_page(items, make, GROUPED_LINES)


# Fixed values of the table grouping, in points or shares of the text's size: how near baselines of a row are; how far a run may begin
# before the end of those to its left; gaps that part cells, and those that part them at a column's start; gaps that are a blank, a
# blank's width, the most blanks; how far a cut moves to a blank.
ROW, BACK, WIDE, COLUMN, BLANK, STEP, LEAST_GAP, MOST_BLANKS, SNAP = 0.45, (0.25, 2.0), 1.6, 0.9, 0.12, 0.3, 8.0, 4, 4


def _half_points(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 2 + 0.5) / 2


def _bands(a: Arrays) -> np.ndarray:
    """A number for each item: its baseline's band, from the top down. Each baseline takes up some room above and below itself; bands are
    what these intervals cover together."""
    room = np.maximum(1.0, a["size"] * ROW / 2)
    top, bottom = -(a["y"] + room), -(a["y"] - room)  # downwards
    order = np.argsort(top, kind="stable")
    reach = np.maximum.accumulate(bottom[order])
    band = np.empty(len(order), np.int64)
    band[order] = np.cumsum(np.r_[False, top[order][1:] >= reach[:-1]])
    return band


def _layers(x: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of one band, from left to right, dealt to as few rows as keep runs from lying on top of each other: a run goes to the first
    row that ends before it begins, or that it laps over by a quarter of the row's width or two sizes at most."""
    reach = np.maximum.accumulate(right)[:-1]
    if (x[1:] >= reach - np.maximum(np.maximum(2.0, size[1:] * BACK[1]), (reach - x[0]) * BACK[0])).all():
        return np.zeros(len(x), np.int64)  # all go to the first row
    begin, end, out = [], [], np.empty(len(x), np.int64)
    for k in range(len(x)):
        row = next((n for n in range(len(end)) if x[k] >= end[n] - max(2.0, size[k] * BACK[1], (end[n] - begin[n]) * BACK[0])), len(end))
        if row == len(end):
            begin.append(x[k])
            end.append(right[k])
        out[k], end[row] = row, max(end[row], right[k])
    return out


def _cut(text: str, x: float, right: float, columns: np.ndarray) -> list[tuple[str, float, float]]:
    """(text, x, right) of the parts of a run between the columns that it reaches over. Characters count as equally wide; a cut moves to the
    nearest blank. A column that would leave a part without text does not cut."""
    inside = columns[(columns > x + 0.5) & (columns < right - 0.5)]
    parts, begin, at = [], x, 0
    for c in inside.tolist():
        cut = int(np.clip(np.floor(len(text) * (c - x) / (right - x) + 0.5), 1, max(1, len(text) - 1)))
        near = [(abs(p - cut), p) for p in range(cut - SNAP, cut + SNAP + 1) if 0 < p < len(text) and text[p] == " "]
        cut = min(near)[1] if near else cut
        if cut > at and text[at:cut].strip(" ") and text[cut:].strip(" "):
            parts.append((text[at:cut].strip(" ") if at else text[:cut].rstrip(" "), begin, c))
            begin, at = c, cut
    return [*parts, (text[at:].lstrip(" ") if at else text, begin, max(right, begin + 1.0))]


def _cells(a: Arrays) -> list[tuple]:
    a = _take(a, np.flatnonzero(np.array([bool(s.strip()) for s in a["str"]], bool) & (a["w"] > 0)))
    if not len(a["x"]):
        return []
    a["right"] = a["x"] + a["w"]
    band, n = _bands(a), 0
    row = np.empty(len(band), np.int64)
    order = np.lexsort((a["x"], band))
    for own in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
        row[own] = n + _layers(a["x"][own], a["right"][own], a["size"][own])
        n = int(row[own].max()) + 1
    starts = _half_points(a["x"])
    seen, rows = np.unique(np.unique(np.stack([starts, row], 1), axis=0)[:, 0], return_counts=True)
    columns = seen[rows >= (3 if n >= 3 else 2)]
    recurs = np.isin(starts, columns)
    out = []
    order = np.lexsort((a["x"], row))
    for line, own in enumerate(np.split(order, np.flatnonzero(np.diff(row[order])) + 1), 1):
        here = starts[own][recurs[own]]  # in order, as the runs are
        text, x, right, y, size = (a[n][own] for n in ("str", "x", "right", "y", "size"))
        crossed = np.searchsorted(here, x + 0.5, "right") < np.searchsorted(here, right - 0.5, "left")
        if crossed.any():
            parts = [(*p, b, c, len(cut) > 1) for t, u, v, b, c, over in zip(text, x, right, y, size, crossed, strict=True) for cut in [_cut(t, u, v, np.unique(here)) if over else [(t, u, max(v, u + 1.0))]] for p in cut]
            parts.sort(key=lambda p: p[1])
            text, x, right, y, size, piece = (np.array(v) for v in zip(*parts, strict=True))
            known = np.isin(_half_points(x), columns) | piece
        else:  # no column within a run: each is a part, from left to right as they are
            right, piece = np.maximum(right, x + 1.0), np.zeros(len(x), bool)
            known = recurs[own]
        reach = np.r_[x[0], np.maximum.accumulate(right)[:-1]]
        gap = x - reach
        # A cell begins behind a gap, which may be narrower at a column's start, and at either edge of a cut run's part.
        opens = np.flatnonzero(np.r_[True, (gap > np.maximum(LEAST_GAP, size * np.where(known, COLUMN, WIDE)))[1:] | piece[1:] | piece[:-1]])
        blanks = np.where(gap > np.maximum(1.0, size * BLANK), np.clip(np.floor(gap / np.maximum(1.0, size * STEP) + 0.5), 1, MOST_BLANKS), 0).astype(int)
        blanks[opens] = 0
        shown = [" " * b + t if b else t for b, t in zip(blanks.tolist(), text.tolist(), strict=True)]
        tall, left = np.maximum.reduceat(size, opens), np.minimum.reduceat(x, opens)
        boxes = np.stack([left, np.minimum.reduceat(y, opens) - tall * 0.3, np.maximum.reduceat(right, opens) - left, tall * 1.2, tall], 1).tolist()
        for k, (lo, hi) in enumerate(zip(opens, [*opens[1:], len(text)], strict=True)):
            out.append((line, k + 1, "".join(shown[lo:hi]), *boxes[k], bool(k and known[lo]), float(max(0.0, gap[lo])) if k else 0.0))
    return out


def table_cells(items: DataFrame) -> DataFrame:
    """Lines and table cells: rows of items with about one baseline, split at column starts that recur down the page
    and at wide gaps; runs painted over several columns are cut."""
    return _by_page(items, _cells, CELLS)


def recurring_columns(items: DataFrame, rows: str = "y") -> DataFrame:
    """(doc_id, page, column): x positions, in half points, at which items of three rows or more start (two, if the page
    has fewer than three rows)."""
    starts = F.floor(F.col("x") * 2 + 0.5) / 2
    per = items.groupBy("doc_id", "page", starts.alias("column")).agg(F.count_distinct(rows).alias("n"))
    total = items.groupBy("doc_id", "page").agg(F.count_distinct(rows).alias("rows"))
    return per.join(total, ["doc_id", "page"]).where(F.col("n") >= F.when(F.col("rows") >= 3, 3).otherwise(2)).select("doc_id", "page", "column", "n")


#: How near the middles of a row's words are, and how wide a gap a blank stands for, in word heights.
OCR_ROW, OCR_BLANK = 0.6, 0.18


def ocr_lines(words: DataFrame, least: float = 45.0) -> DataFrame:
    """Recognised words as lines: rows by the middles of the words' boxes, words left to right, a blank where the gap
    is over 0.18 of the row's median word height; a line is as sure as its least sure word and goes below `least`."""

    def make(a: Arrays) -> list[tuple]:
        left = _take(a, np.lexsort((a["x0"], a["y0"] + a["y1"])))
        lines = []
        while len(left["x0"]):  # one row at a time: its mean middle and its height grow with the words that it takes
            middles, heights = (left["y0"] + left["y1"]) / 2, np.maximum(1.0, left["y1"] - left["y0"])
            tallest = np.maximum.accumulate(heights[::-1])[::-1]
            took = np.zeros(len(middles), bool)
            middle, tall, n = middles[0], heights[0], 0
            for k in range(len(middles)):
                if middles[k] - middle >= max(tall, tallest[k]) * OCR_ROW:
                    break  # words come from the top down, and none of the rest is tall enough
                if abs(middles[k] - middle) < max(tall, heights[k]) * OCR_ROW:
                    took[k] = True
                    n += 1
                    middle, tall = middle + (middles[k] - middle) / n, max(tall, heights[k])
            line, left = _take(left, took), _take(left, ~took)
            line = _take(line, np.argsort(line["x0"], kind="stable"))
            blank = (np.sort(line["y1"] - line["y0"])[n // 2] or 10.0) * OCR_BLANK
            edge = np.maximum.accumulate(line["x1"])
            apart = np.r_[False, line["x0"][1:] - edge[:-1] > blank]
            text = ""
            for word, gap in zip(line["text"], apart.tolist(), strict=True):
                text += " " * bool(gap and text) + word
            lines.append((text, line["x0"].min(), line["y0"].min(), edge[-1], line["y1"].max(), line["confidence"].min()))
        kept = sorted((r for r in lines if r[5] >= least and r[0].strip()), key=lambda r: r[2])
        return [(k, *r) for k, r in enumerate(kept, 1)]

    return _by_page(words, make, OCR_LINES)


def median_height(words: DataFrame) -> DataFrame:
    """(doc_id, page, height): the upper median of word heights, 10 for 0."""
    h = F.array_sort(F.collect_list(F.col("y1") - F.col("y0")))
    return words.groupBy("doc_id", "page").agg(h.alias("h")).select("doc_id", "page", F.coalesce(F.nullif(F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")), F.lit(0.0)), F.lit(10.0)).alias("height"))
