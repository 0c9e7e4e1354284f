"""Annotations: bounds, hits, display space, drawing steps, stamps and form fields.

An annotation is one wide row: doc_id, page, ann_id, z, type and the fields its type has (x, y, w, h, x2, y2, size, text,
pts ARRAY<STRUCT<x, y>>, colour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.strings import collapse, expand_tokens

LINES_ = ("arrow", "line")
#: Types that are drawn; a form field becomes a widget instead.
DRAWN = ("text", "edit", "highlight", "underline", "strike", "rect", "ellipse", "line", "arrow", "ink", "image", "signature", "redact")


def bounds() -> Column:
    """struct(x0, y0, x1, y1) of an annotation row: of its points, its two ends, or its box."""
    pts, kind = F.col("pts"), F.col("type")
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    make = lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)))
    x, y, w, h, x2, y2 = (F.col(c) for c in ("x", "y", "w", "h", "x2", "y2"))
    return (
        F.when(kind == "ink", make(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        .when(kind.isin(*LINES_), make(F.least(x, x2), F.least(y, y2), F.greatest(x, x2), F.greatest(y, y2)))
        .otherwise(make(x, y, x + F.coalesce(w, F.lit(0.0)), y + F.coalesce(h, F.lit(0.0))))
    )


def hit_test(anns: DataFrame, x: float, y: float, scale: float = 1.0, pad: float = 5.0, least: float = 14.0) -> DataFrame:
    """The topmost annotation of each page under a point; targets are padded and at least `least` pixels wide."""
    b = anns.withColumn("b", bounds())
    slack = lambda lo, hi: F.greatest(F.lit(pad / scale), (F.lit(least / scale) - (hi - lo)) / 2)
    sx, sy = slack(F.col("b.x0"), F.col("b.x1")), slack(F.col("b.y0"), F.col("b.y1"))
    hit = b.where((F.lit(x) >= F.col("b.x0") - sx) & (F.lit(x) <= F.col("b.x1") + sx) & (F.lit(y) >= F.col("b.y0") - sy) & (F.lit(y) <= F.col("b.y1") + sy))
    return hit.groupBy("doc_id", "page").agg(F.max_by("ann_id", "z").alias("ann_id"))


def surviving(anns: DataFrame, rects: DataFrame, pw: float, ph: float) -> DataFrame:
    """Annotations that no redaction rectangle (doc_id, page, rx, ry, rw, rh) meets, in any of the page's four
    turnings; one of unknown extent goes if its page has a rectangle at all."""
    w, h = F.lit(pw), F.lit(ph)
    variants = F.explode(F.array(*[F.struct(*(c.alias(n) for c, n in zip(g.rotated_rect(F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh"), w, h, d), "xywh", strict=True))) for d in (0, 90, 180, 270)])).alias("v")
    cover = rects.select("doc_id", "page", variants).select("doc_id", "page", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"), F.col("v.w").alias("vw"), F.col("v.h").alias("vh"))
    a = anns.withColumn("b", bounds())
    meets = g.overlaps(F.col("b.x0"), F.col("b.y0"), F.col("b.x1") - F.col("b.x0"), F.col("b.y1") - F.col("b.y0"), F.col("vx"), F.col("vy"), F.col("vw"), F.col("vh"))
    on = (a["doc_id"] == cover["doc_id"]) & (a["page"] == cover["page"]) & F.coalesce(meets, F.lit(True))
    return a.join(cover, on, "left_anti").drop("b")


def to_display(anns: DataFrame, ph: float, scale: float) -> DataFrame:
    """Boxes and points in device space of an upright page: y down, scaled."""
    s, top = F.lit(scale), F.lit(ph)
    pts = F.transform("pts", lambda p: F.struct((p["x"] * s).alias("x"), ((top - p["y"]) * s).alias("y")))
    tall = F.coalesce(F.when(~F.col("type").isin(*LINES_), F.col("h")), F.lit(0.0))
    return anns.select("doc_id", "page", "ann_id", "type", (F.col("x") * s).alias("x"), ((top - F.col("y") - tall) * s).alias("y"), (F.col("w") * s).alias("w"), (F.col("h") * s).alias("h"), (F.col("x2") * s).alias("x2"), ((top - F.col("y2")) * s).alias("y2"), pts.alias("pts"))


def to_turned_display(anns: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes, ends and points of annotations on the page as it is shown, y up: turned by its rotation and mirrored (flip: 1 left to right, 2
    top to bottom). pages: (doc_id, page, bx, by, bw, bh, rot, flip)."""
    box = [F.col(c) for c in ("bx", "by", "bw", "bh")]
    m, width, height = g.viewport(*box, 1.0, F.coalesce("rot", F.lit(0)))
    rows = anns.join(pages.select("doc_id", "page", m.alias("_m"), width.alias("_w"), height.alias("_h"), F.coalesce("flip", F.lit(0)).alias("_flip")), ["doc_id", "page"])

    def to(x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = g.flipped(*g.apply(F.col("_m"), x, y), F.col("_w"), F.col("_h"), F.col("_flip"))
        return dx, F.col("_h") - dy

    x, y, w, h, x2, y2 = (F.col(c) for c in ("x", "y", "w", "h", "x2", "y2"))
    line, plain = F.col("type").isin(*LINES_), F.col("type") == "text"  # a text is placed by its point only
    a, b, e = to(x, y), to(x + w, y + h), to(x2, y2)
    point = line | plain | w.isNull() | h.isNull()
    pts = F.transform("pts", lambda p: (lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))(to(p["x"], p["y"])))
    return rows.select(
        "doc_id", "page", "ann_id", "type", F.when(point, a[0]).otherwise(F.least(a[0], b[0])).alias("x"), F.when(point, a[1]).otherwise(F.least(a[1], b[1])).alias("y"),
        F.when(point, w).otherwise(F.abs(b[0] - a[0])).alias("w"), F.when(point, h).otherwise(F.abs(b[1] - a[1])).alias("h"), e[0].alias("x2"), e[1].alias("y2"), pts.alias("pts"),
    )


def flip(anns: DataFrame, pw: float, ph: float, mode: str) -> DataFrame:
    """Annotations of a mirrored page, h left to right, v top to bottom, so that they stay where they are seen."""
    if mode == "h":
        return anns.withColumn("x", F.lit(pw) - F.col("x") - F.coalesce("w", F.lit(0.0))).withColumn("pts", F.transform("pts", lambda p: F.struct((F.lit(pw) - p["x"]).alias("x"), p["y"].alias("y"))))
    return anns.withColumn("y", F.lit(ph) - F.col("y") - F.coalesce("h", F.lit(0.0))).withColumn("pts", F.transform("pts", lambda p: F.struct(p["x"].alias("x"), (F.lit(ph) - p["y"]).alias("y"))))


def draw_ops(anns: DataFrame) -> DataFrame:
    """One row per drawing step, in z order: op and bounds; a line's arrow head and a struck text are steps of their own."""
    kind = F.col("type")
    steps = (
        F.when(kind.isin("text", "edit"), F.array(F.lit("text")))
        .when(kind == "arrow", F.array(F.lit("line"), F.lit("head")))
        .when(kind.isin("highlight", "redact", "rect"), F.array(F.lit("fill")))
        .when(kind.isin("underline", "strike", "line"), F.array(F.lit("line")))
        .when(kind == "ink", F.array(F.lit("path")))
        .when(kind == "ellipse", F.array(F.lit("ellipse")))
        .otherwise(F.array(F.lit("image")))
    )
    shown = anns.where(kind.isin(*DRAWN)).withColumn("b", bounds()).select("*", F.posexplode(steps).alias("k", "op"))
    order = Window.partitionBy("doc_id", "page").orderBy("z", "ann_id", "k")
    return shown.select("doc_id", "page", F.row_number().over(order).cast("bigint").alias("step"), "ann_id", "op", "b.x0", "b.y0", "b.x1", "b.y1")


# Fixed values of what is painted: a bar's thickness and place in its box, the least thickness; an arrow head's length, its share of the
# stroke, and half its angle; how much of a fill shows; the smallest text; where an edit's text stands in its box; a note's side,
# folded corner and how much darker that is.
BAR, BAR_AT, LEAST_BAR = 0.16, {"underline": 0.06, "strike": 0.45}, 1.0
HEAD, HEAD_STROKES, HEAD_ANGLE, FILLED, LEAST_TEXT, EDIT_AT = 8.0, 4.0, 3.141592653589793 / 7, 0.35, 4.0, 0.18
NOTE, FOLD, DARKER = 8.0, 0.34, 0.18
REDACTED, PAPER = "#101014", "#ffffff"


def _step(op: str, x0: Column, y0: Column, x1: Column, y1: Column, colour: Column, opacity: Column | None = None, stroke: Column | None = None, size: Column | None = None, text: Column | None = None) -> Column:
    num = lambda c: (F.lit(None) if c is None else c).cast("double")
    names = [("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1), ("r", colour["r"]), ("g", colour["g"]), ("b", colour["b"]), ("opacity", F.lit(1.0) if opacity is None else opacity), ("stroke", stroke), ("size", size)]
    return F.struct(F.lit(op).alias("op"), *(num(c).alias(n) for n, c in names), (F.lit(None) if text is None else text).cast("string").alias("text"))


def paint(anns: DataFrame) -> DataFrame:
    """(doc_id, page, step, ann_id, op, x0, y0, x1, y1, r, g, b, opacity, stroke, size, text): what is painted for each annotation, in z order.

    op: fill or oval (a box), border or ring (its outline), line (between two points), text (at a point), image. Annotations have
    colour, fill and bg as #rrggbb, opacity, width (of strokes), size and text besides their place, n for notes."""
    x, y, w, h, x2, y2 = (F.col(c) for c in ("x", "y", "w", "h", "x2", "y2"))
    kind, given = F.col("type"), lambda c, default: F.coalesce(F.col(c), F.lit(default))
    colour, opacity, width = g.rgb(given("colour", "#000000")), given("opacity", 1.0), given("width", 1.0)
    box = lambda op, c, o=None, s=None: _step(op, x, y, x + w, y + h, c, o, s)

    def bar(name: str) -> Column:
        low = y + h * BAR_AT[name]
        return F.array(_step("fill", x, low, x + w, low + F.greatest(F.lit(LEAST_BAR), h * BAR), colour, opacity))

    line = lambda ax, ay, bx, by: _step("line", ax, ay, bx, by, colour, opacity, width)
    angle, head = F.atan2(y2 - y, x2 - x), F.greatest(F.lit(HEAD), width * HEAD_STROKES)
    barbs = [line(x2, y2, x2 - head * F.cos(angle + t), y2 - head * F.sin(angle + t)) for t in (-HEAD_ANGLE, HEAD_ANGLE)]
    pts = F.col("pts")
    strokes = F.transform(F.sequence(F.lit(2), F.size(pts)), lambda k: line(F.element_at(pts, k - 1)["x"], F.element_at(pts, k - 1)["y"], F.element_at(pts, k)["x"], F.element_at(pts, k)["y"]))
    none = F.slice(F.array(box("fill", colour)), 1, 0)
    words, size = collapse(given("text", "")), F.greatest(F.lit(LEAST_TEXT), given("size", LEAST_TEXT))
    said = lambda up: F.when(words != "", F.array(_step("text", x, y + up, x, y + up, colour, None, None, size, words))).otherwise(none)
    lined = lambda fill, edge: F.concat(F.when(F.col("fill").isNotNull(), F.array(box(fill, g.rgb(F.col("fill")), opacity * FILLED))).otherwise(none), F.array(box(edge, colour, opacity, width)))
    side = F.greatest(F.lit(NOTE), given("w", 16.0))
    tall, fold, shade = F.coalesce(h, side), side * FOLD, F.struct(*(F.greatest(F.lit(0.0), colour[c] - DARKER).alias(c) for c in "rgb"))
    label, white = F.col("n").cast("string"), g.rgb(F.lit(PAPER))
    note = F.array(
        _step("fill", x, y, x + side, y + tall, colour), _step("fill", x + side - fold, y + side - fold, x + side, y + side, shade),
        _step("text", x + side * 0.5 - F.length(label) * 1.7, y + tall * 0.5 - 3.2, x, y, white, None, None, side * 0.5, label),
    )
    steps = F.when(kind == "highlight", F.array(box("fill", colour, opacity))).when(kind == "underline", bar("underline")).when(kind == "strike", bar("strike"))
    steps = steps.when(kind == "redact", F.array(box("fill", g.rgb(given("colour", REDACTED))))).when(kind == "whiteout", F.array(box("fill", colour))).when(kind == "line", F.array(line(x, y, x2, y2)))
    steps = steps.when(kind == "arrow", F.array(line(x, y, x2, y2), *barbs)).when(kind == "rect", lined("fill", "border")).when(kind == "ellipse", lined("oval", "ring")).when((kind == "ink") & (F.size(pts) > 1), strokes)
    steps = steps.when(kind == "text", said(F.lit(0.0))).when(kind == "edit", F.concat(F.array(box("fill", g.rgb(given("bg", PAPER)))), said(h * EDIT_AT))).when(kind == "note", note).when(kind.isin("image", "signature"), F.array(box("image", colour))).otherwise(none)
    wanted = {"colour": "string", "fill": "string", "bg": "string", "opacity": "double", "width": "double", "size": "double", "text": "string", "n": "int"}
    rows = anns.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in anns.columns}).select("*", F.posexplode(steps).alias("_k", "_step"))
    order = Window.partitionBy("doc_id", "page").orderBy("z", "ann_id", "_k")
    return rows.select("doc_id", "page", F.row_number().over(order).cast("bigint").alias("step"), "ann_id", "_step.*")


def fields_on_pages(fields: DataFrame, widgets: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, name, kind, value, page, x, y, w, h): fields (doc_id, field, name, kind, value) that can be filled in, with the place of each
    of their widgets (doc_id, field, page, x0, y0, x1, y1) within its page's box (bx, by); the first page where none is named. Fields of
    other kinds, and widgets without a place, are left out."""
    own = fields.where(F.col("kind").isin("text", "checkbox", "radio", "dropdown"))
    known = widgets.where("x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL").withColumn("page", F.coalesce("page", F.lit(1).cast("bigint")))
    rows = own.join(known, ["doc_id", "field"]).join(pages.select("doc_id", "page", "bx", "by"), ["doc_id", "page"])
    x, y = F.least("x0", "x1"), F.least("y0", "y1")
    return rows.select("doc_id", "name", "kind", "value", "page", (x - F.col("bx")).alias("x"), (y - F.col("by")).alias("y"), F.abs(F.col("x1") - F.col("x0")).alias("w"), F.abs(F.col("y1") - F.col("y0")).alias("h"))


def stamps(pages: DataFrame, template: str, date: str, start: int = 1, skip_first: bool = False) -> DataFrame:
    """(doc_id, page, stamp): the text stamped on each page; numbers go from `start`, over the pages in order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    out = pages.withColumn("_row", row).withColumn("_n", n)
    out = out.where(F.col("_row") > 1) if skip_first else out
    return out.select("doc_id", "page", expand_tokens(template, F.col("_row") + start - 1, F.col("_n"), date, F.col("title")).alias("stamp"))


def fill_fields(fields: DataFrame, values: DataFrame) -> DataFrame:
    """Form fields with the given values (doc_id, name, new_value): a checkbox takes true or false, a choice one of its
    options; a value that a field cannot take leaves it as it is and is named in error."""
    joined = fields.join(values, ["doc_id", "name"], "left")
    new, kind = F.col("new_value"), F.col("kind")
    bad = new.isNotNull() & (((kind == "checkbox") & ~F.coalesce(F.lower(new).isin("true", "false"), F.lit(False))) | (kind.isin("radio", "dropdown") & ~F.coalesce(F.array_contains("options", new), F.lit(False))))
    return joined.select("doc_id", "name", "kind", F.when(bad | new.isNull(), F.col("value")).otherwise(new).alias("value"), F.when(bad, F.concat(F.lit("not a value of "), "name")).alias("error"))


def from_ocr(lines: DataFrame, pw: float, ph: float, scale: float) -> DataFrame:
    """Recognised lines (pixels, y down) as editable texts on a page of pw by ph points; texts of under 3 points either way
    are left out, sizes go from 5 to 40."""
    zero = F.lit(0.0)
    x = F.greatest(zero, F.least("x0", "x1") / scale)
    y = F.greatest(zero, ph - F.greatest("y0", "y1") / scale)
    w, h = F.least(pw - x, F.abs(F.col("x1") - F.col("x0")) / scale), F.least(ph - y, F.abs(F.col("y1") - F.col("y0")) / scale)
    rest = [c for c in lines.columns if c not in ("x0", "y0", "x1", "y1")]
    out = lines.select(*rest, F.lit("edit").alias("type"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), F.greatest(F.lit(5.0), F.least(F.lit(40.0), h * 0.85)).alias("size"))
    return out.where("w >= 3 AND h >= 3")


def unique_names(fields: DataFrame) -> DataFrame:
    """New widgets' names: the second and later of a name get _2, _3 and so on."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("seq"))
    return fields.withColumn("name", F.when(nth > 1, F.concat("name", F.lit("_"), nth.cast("string"))).otherwise(F.col("name")))
