"""Joins and closures over what a document parser finds: paint spans, images, widgets, structure, marked sections, nested forms.

Ranges are compared within the cells of a page's grid (grid). Closures follow references to their end (reach). What
cannot be compared counts as hit: everything fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .grid import meeting, that_meet
from .reach import reached

PAGE = ["doc_id", "page"]


def under(boxes: DataFrame, rects: DataFrame) -> DataFrame:
    """The boxes (doc_id, page, x0, y0, x1, y1, ...; corners in any order) under a rectangle (doc_id, page, rx, ry, rw, rh), that is,
    sharing more than an edge with it: a semi join, so a box under several rectangles is there once. A box with a missing
    coordinate counts as hit wherever its page has a rectangle."""
    known = F.col("x0").isNotNull() & F.col("x1").isNotNull() & F.col("y0").isNotNull() & F.col("y1").isNotNull()
    end = lambda pick, a, b: F.when(known, pick(a, b))
    box = [(end(F.least, f"{c}0", f"{c}1"), end(F.greatest, f"{c}0", f"{c}1")) for c in "xy"]
    r = rects.select(*PAGE, "rx", "ry", "rw", "rh").distinct()
    return that_meet(boxes, r, PAGE, box, [(F.col("rx"), F.col("rx") + F.col("rw")), (F.col("ry"), F.col("ry") + F.col("rh"))])


def image_pixels(images: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page, image, px0, py0, px1, py1): the pixels of each image (matrix m from the unit square to the page, pw by ph
    pixels, first row on top) that lie under rectangles, as one range per image; null where the matrix has no inverse,
    which refuses the page."""
    m, at = g.invert(F.col("m")), lambda x, y: g.apply(F.col("inv"), x, y)
    both = images.join(rects, PAGE).withColumn("inv", m)
    x0, y0, x1, y1 = F.col("rx"), F.col("ry"), F.col("rx") + F.col("rw"), F.col("ry") + F.col("rh")
    us, vs = zip(*(at(x, y) for x, y in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))), strict=True)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    cut = both.withColumns({"u0": clip(F.least(*us)), "u1": clip(F.greatest(*us)), "v0": clip(F.least(*vs)), "v1": clip(F.greatest(*vs))})
    cut = cut.where(F.col("inv").isNull() | (F.col("u0") < F.col("u1")) & (F.col("v0") < F.col("v1")))
    whole = lambda c: F.when(F.col("inv").isNotNull(), c).cast("bigint")
    return cut.groupBy(*PAGE, "image").agg(
        F.min(whole(F.floor(F.round(F.col("u0") * F.col("pw"), 6)))).alias("px0"), F.min(whole(F.floor(F.round((1 - F.col("v1")) * F.col("ph"), 6)))).alias("py0"),
        F.max(whole(F.ceil(F.round(F.col("u1") * F.col("pw"), 6)))).alias("px1"), F.max(whole(F.ceil(F.round((1 - F.col("v0")) * F.col("ph"), 6)))).alias("py1"),
    )


#: Forms may be nested this deep, the page's own being at 0 (a fixed value).
FORM_DEPTH = 8


def clear_fields(widgets: DataFrame, fields: DataFrame, rects: DataFrame) -> DataFrame:
    """fields (doc_id, field, parent, value, default_value) with the column cleared: the values of the fields whose widgets (doc_id,
    page, field, box) lie under a rectangle are gone, and those of all fields above them, however many."""
    hit = under(widgets, rects).select("doc_id", F.col("field").alias("node")).distinct()
    above = reached(fields.select("doc_id", F.col("field").alias("parent"), F.col("parent").alias("child")), hit, ["doc_id"])
    gone = above.select("doc_id", F.col("node").alias("field")).withColumn("_gone", F.lit(True))
    both = fields.join(gone, ["doc_id", "field"], "left").withColumn("cleared", F.col("_gone").isNotNull())
    keep = lambda c: F.when(~F.col("cleared"), F.col(c)).alias(c)
    return both.select("doc_id", "field", "parent", keep("value"), keep("default_value"), "cleared")


def clear_structure(elements: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, elem, alt, ok): alternative texts of structure elements without those under a rectangle. An element that
    has a text and no box cannot be placed: its document is not ok."""
    placed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    told = elements.where(F.col("alt").isNotNull())
    hit = under(told, rects).select("doc_id", "elem").distinct().withColumn("_hit", F.lit(True))
    bad = told.groupBy("doc_id").agg(F.bool_or(~placed).alias("_bad"))
    both = elements.join(hit, ["doc_id", "elem"], "left").join(bad, "doc_id", "left")
    return both.select("doc_id", "elem", F.when(F.col("_hit").isNull(), F.col("alt")).alias("alt"), (~F.coalesce("_bad", F.lit(False))).alias("ok"))


def clear_sections(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, page, section, secret, ok): marked sections (start, stop, secret) without their secrets, if all parts of the page
    (start, stop, removed) that overlap them were removed; else the section is not ok and keeps it."""
    stays = parts.where(~F.coalesce("removed", F.lit(False))).select(*PAGE, F.col("start").alias("_a"), F.col("stop").alias("_b")).distinct()
    told = sections.where(F.col("secret").isNotNull()).select(*PAGE, "section", "start", "stop").distinct()
    pairs = meeting(told, stays, PAGE, [(F.col("start"), F.col("stop"))], [(F.col("_a"), F.col("_b"))], side=1024.0)
    left = pairs.select(*(F.col(f"a.{c}") for c in (*PAGE, "section"))).distinct().withColumn("_left", F.lit(True))
    both = sections.join(left, [*PAGE, "section"], "left")
    return both.select(*PAGE, "section", F.when(F.col("_left").isNotNull(), F.col("secret")).alias("secret"), F.col("_left").isNull().alias("ok"))


def nested_forms(uses: DataFrame, most: int = FORM_DEPTH) -> DataFrame:
    """(doc_id, page, forms, deepest, images_within, ok) of each page that uses an object. uses: (doc_id, page, parent, child, kind);
    parent null: the page itself; kind: form or image. deepest: the most uses that lie between the page and a form, null if
    that is not known, as with a cycle. ok: it is known and at most `most`, and no form uses an image."""
    forms = uses.where("kind = 'form'")
    top = forms.where("parent IS NULL").select(*PAGE, F.col("child").alias("node"))
    found = reached(forms, top, PAGE)
    within = uses.where("kind = 'image' AND parent IS NOT NULL").select(*PAGE, F.col("parent").alias("node")).distinct().withColumn("_image", F.lit(True))
    each = found.join(within, [*PAGE, "node"], "left").groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("forms"), F.when(F.bool_and(F.col("deepest").isNotNull()), F.max("deepest")).alias("deepest"), F.count_if(F.col("_image")).alias("images_within"), F.lit(True).alias("_any"),
    )
    both = uses.select(*PAGE).distinct().join(each, PAGE, "left").fillna(0, ["forms", "images_within"])
    deepest = F.when(F.col("_any"), F.col("deepest")).otherwise(0)
    return both.select(*PAGE, "forms", deepest.alias("deepest"), "images_within", (F.coalesce(deepest <= most, F.lit(False)) & (F.col("images_within") == 0)).alias("ok"))


def purge(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """objects (doc_id, node, ...) without the roots (doc_id, node) and all that they refer to."""
    return objects.join(reached(edges, roots, ["doc_id"]).select("doc_id", "node"), ["doc_id", "node"], "left_anti")


def rebuilt(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots among objects and all that they refer to: a document written anew has no orphans."""
    return objects.join(reached(edges, roots, ["doc_id"]).select("doc_id", "node"), ["doc_id", "node"], "left_semi")


def fonts_of(segments: DataFrame, fonts: DataFrame) -> DataFrame:
    """segments with base_font and undecodable: is their font (named with or without a slash) unknown on the page?"""
    plain = lambda c: F.regexp_replace(c, "^/", "")
    f = fonts.select(*PAGE, plain(F.col("name")).alias("_name"), "base_font").dropDuplicates([*PAGE, "_name"])
    both = segments.withColumn("_name", plain(F.col("font"))).join(f, [*PAGE, "_name"], "left")
    return both.drop("_name").withColumn("undecodable", F.col("base_font").isNull())


def targets(uses: DataFrame, resources: DataFrame) -> DataFrame:
    """uses (doc_id, page, name) with outcome: ignored (no such resource), direct (no reference, which refuses the page) or the
    reference followed."""
    r = resources.select(*PAGE, "name", "ref", F.lit(True).alias("_there"))
    both = uses.join(r, [*PAGE, "name"], "left")
    return both.withColumn("outcome", F.when(F.col("_there").isNull(), "ignored").when(F.col("ref").isNull(), "direct").otherwise("reference")).drop("_there")


def best_lines(hits: DataFrame, lines: DataFrame, least: float = 1.2, bag: bool = True) -> DataFrame:
    """(doc_id, page, hit, line_no, score): for each hit (hit, htext, hx, hy) the line of its page that is most like it; the first of
    equals, none below `least`. Equal texts count 2, one within the other 1.4, else 0.8 times the share of common words;
    nearness within 60 points counts up to 1. bag: repeated words count each time, so that a long hit can be more like a short
    line than like itself; else each word counts once. The numbers are fixed values."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a, b = F.col("_a"), F.col("_b")
    at, bt = F.split(a, " "), F.split(b, " ")
    common = F.size(F.filter(bt, lambda t: F.array_contains(F.col("_at"), t))) if bag else F.size(F.array_intersect(bt, F.col("_at")))
    near = F.greatest(F.lit(0.0), 1 - F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy")) / 60)
    alike = F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.7)
    if not bag:  # the share is 1 at most: so far off, common words cannot make up for it
        alike = alike.when(near < least - 0.801, 0.0)
    alike = alike.otherwise(0.4 * (common / F.greatest(F.lit(1), F.least(F.size("_at"), F.size(bt)))))
    # Texts are dealt out as they are; what is made of them is made where they are compared.
    one = hits.select(*PAGE, "hit", "htext", "hx", "hy").repartition(*PAGE).select(*PAGE, "hit", "hx", "hy", norm(F.col("htext")).alias("_b"))
    other = lines.select(*PAGE, "line_no", "text", "x", "y").repartition(*PAGE).select(*PAGE, "line_no", "x", "y", norm(F.col("text")).alias("_a")).withColumn("_at", at)
    pair = F.when((a != "") & (b != ""), F.struct((alike * 2 + near).alias("score"), (-F.col("line_no")).alias("back")))
    best = one.join(other, PAGE).groupBy(*PAGE, "hit").agg(F.max(pair).alias("b")).where(F.col("b.score") >= least)
    return best.select(*PAGE, "hit", (-F.col("b.back")).alias("line_no"), F.col("b.score").alias("score"))


def features(resources: DataFrame) -> DataFrame:
    """(doc_id, page, has_images, has_forms, has_patterns, has_inline_images) from resource rows (doc_id, page, kind)."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    return resources.groupBy(*PAGE).agg(has("image").alias("has_images"), has("form").alias("has_forms"), has("pattern").alias("has_patterns"), has("inline").alias("has_inline_images"))


def vector_plan(lines: DataFrame, spans: DataFrame, sections: DataFrame, forms: DataFrame) -> DataFrame:
    """(doc_id, page, lines, spans, ok): what a page's redaction takes out, and whether it may. lines: covered lines, spans: paint
    spans under rectangles, each as rows of a page; sections: clear_sections' rows, forms: nested_forms' rows. A page of
    which one of the two is not ok may not be written; a page without anything to take out has no row."""
    n = lambda rows, name: rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias(name))
    out = n(lines, "lines").join(n(spans, "spans"), PAGE, "full").fillna(0, ["lines", "spans"])
    bad = sections.where(~F.coalesce("ok", F.lit(False))).select(*PAGE).unionByName(forms.where(~F.coalesce("ok", F.lit(False))).select(*PAGE)).distinct().withColumn("_bad", F.lit(True))
    return out.join(bad, PAGE, "left").select(*PAGE, "lines", "spans", F.col("_bad").isNull().alias("ok"))
