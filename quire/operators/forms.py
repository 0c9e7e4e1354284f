"""Forms within forms, redacted use by use: what a page's rectangles cover goes from copies, and whatever else uses a form keeps it.

A use is told by its page and the names that lead to it. A use whose text is covered becomes a form of its own, and so do all uses
above it, whose names then lead to the copies; everything else stays. Uses are listed in a document's row; placing, covering and
rewriting are joins."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .objects import FORM_DEPTH, PAGE
from .redact import coverage_by

#: A page with more uses of forms is refused: each would be looked at by itself.
MOST_USES = 10_000
#: Rows that go on together.
OUT_ROWS = 8192
#: Why a page is refused.
DEEP, IMAGE, MANY = "forms nested too deep, or within themselves", "an image within a form", "too many uses of forms"

Use = tuple[int | None, str | None, str, str, str, list[float]]  # page, parent, name, child, kind, m


def _compose(m: list[float], n: list[float]) -> list[float]:
    """First n, then m."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f]


def list_uses(uses: list[Use]) -> list[tuple]:
    """(page, path, form, m, refusal) of each use of a form, path being the names from the page on and m the matrix from the form to the
    page; of a page that is refused one row with the reason."""
    within, top = defaultdict(list), defaultdict(list)
    for page, parent, *use in uses:
        (top[page] if parent is None else within[parent]).append(use)
    out = []
    for page, own in sorted(top.items()):
        rows, todo, why = [], [((name,), child, m, 0) for name, child, kind, m in own if kind == "form"], None
        while todo and not why:
            path, form, m, depth = todo.pop()
            rows.append((page, list(path), form, m, None))
            if len(rows) > MOST_USES:
                why = MANY
            for name, child, kind, n in within[form]:
                if kind != "form":
                    why = why or IMAGE
                elif depth == FORM_DEPTH:  # a cycle comes here, too
                    why = why or DEEP
                else:
                    todo.append(((*path, name), child, _compose(m, n), depth + 1))
        out += [(page, None, None, None, why)] if why else rows
    return out


def form_instances(uses: DataFrame) -> DataFrame:
    """list_uses' rows for uses (doc_id, page, parent, name, child, kind, m); page is null within forms, parent on pages."""
    kind = f"doc_id {dict(uses.dtypes)['doc_id']}, page bigint, path array<string>, form string, m array<double>, refusal string"
    names = ["page", "path", "form", "m", "refusal"]
    types = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.float64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for row in range(batch.num_rows):  # a document at a time; what is found goes on in batches
                uses = batch.column(1)[row].values
                found = list_uses(list(zip(*(f.to_pylist() for f in uses.flatten()), strict=True)))
                ids += [row] * len(found)
                rows += found
                if len(rows) >= OUT_ROWS or rows and row == batch.num_rows - 1:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])
                    ids, rows = [], []

    rows = uses.groupBy("doc_id").agg(F.collect_list(F.struct("page", "parent", "name", "child", "kind", "m")).alias("uses"))
    return rows.select("doc_id", "uses").mapInArrow(run, kind)


class Clones(NamedTuple):
    """edges: (doc_id, page, parent, name, target), all uses as they are afterwards; segments: (doc_id, form, seq, text) of the copies;
    refused: (doc_id, page, reason), pages whose uses stay as they are and which must not be written."""

    edges: DataFrame
    segments: DataFrame
    refused: DataFrame


def _copy_name(path: Column) -> Column:
    """A copy is called by its page and its path, so that a second run names it alike."""
    return F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(":"), F.array_join(path, "/"))


def clone_on_write(uses: DataFrame, segments: DataFrame, rects: DataFrame) -> Clones:
    """uses as above; segments: (doc_id, form, seq, text, x, y, w, size) in the forms' own space; rects: (doc_id, page, rx, ry, rw, rh).
    Segments that are wholly covered go; partly covered ones stay."""
    touched = rects.select(*PAGE).distinct()
    placed = form_instances(uses).join(touched, PAGE, "left_semi")
    refused = placed.where("refusal IS NOT NULL").select(*PAGE, F.col("refusal").alias("reason"))
    own = placed.where("refusal IS NULL").select(*PAGE, "path", "form", "m")
    place = F.struct("x", "y", "w", "size").alias("at")  # texts come last, to what is left of copies
    m = F.col("m")
    upright = (m[1] == 0) & (m[2] == 0)  # text at an angle is not compared with rectangles: it counts as covered
    x, y = (F.when(upright, c) for c in g.apply(m, F.col("at.x"), F.col("at.y")))
    lines = own.join(segments.select("doc_id", "form", "seq", place), ["doc_id", "form"]).select(
        *PAGE, "path", "form", "seq", "at", x.alias("x"), y.alias("y"), (F.col("at.w") * F.hypot(m[0], m[1])).alias("w"), (F.col("at.size") * F.hypot(m[2], m[3])).alias("size"),
    )
    marked = coverage_by(lines, rects, ["path", "form", "seq", "at"])
    gone = marked.where("coverage = 'full'").select(*PAGE, "path").distinct()
    above = F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))
    changed = gone.select(*PAGE, F.explode(above).alias("path")).distinct().withColumn("copy", _copy_name(F.col("path")))
    copies = own.join(changed, [*PAGE, "path"])
    left = marked.join(changed, [*PAGE, "path"]).where("coverage <> 'full'").select("doc_id", F.col("form").alias("_form"), F.col("seq").alias("_seq"), F.col("at").alias("_at"), F.col("copy"))
    texts = segments.select("doc_id", F.col("form").alias("_form"), "seq", "text", place)
    same = F.col("seq").eqNullSafe(F.col("_seq")) & F.col("at").eqNullSafe(F.col("_at"))
    kept = left.join(texts, ["doc_id", "_form"]).where(same).select("doc_id", F.col("copy").alias("form"), "seq", "text").distinct()
    inner = uses.where("parent IS NOT NULL").select("doc_id", F.col("parent").alias("form"), "name", "child")
    to = changed.select(*PAGE, "path", F.col("copy").alias("_to"))
    of_copies = copies.join(inner, ["doc_id", "form"]).select(*PAGE, F.col("copy").alias("parent"), F.concat("path", F.array("name")).alias("path"), "name", "child")
    of_pages = uses.where("parent IS NULL").select(*PAGE, F.lit(None).cast("string").alias("parent"), F.array("name").alias("path"), "name", "child")
    written = of_copies.unionByName(of_pages).join(to, [*PAGE, "path"], "left").select(*PAGE, "parent", "name", F.coalesce("_to", "child").alias("target"))
    stays = uses.where("parent IS NOT NULL").select("doc_id", F.lit(None).cast("bigint").alias("page"), "parent", "name", F.col("child").alias("target"))
    return Clones(written.unionByName(stays), kept, refused)
