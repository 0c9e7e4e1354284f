"""What a parser would find in documents, derived from the lines and pages of text documents: object tables for joins and
closures. Names and numbers follow from doc_id, page and line, so that every case occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_documents import PAGE_LINES, lines


def boxes(lines: DataFrame) -> DataFrame:
    """A box around each line; every thirteenth line's has no left edge."""
    left = F.when(F.col("line_no") % 13 != 0, F.col("x"))
    return lines.select("doc_id", "page", "line_no", left.alias("x0"), (F.col("y") - 3).alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + 11).alias("y1"), "text")


def rects(pages: DataFrame, shapes: list[tuple[int | None, float, float, float, float]]) -> DataFrame:
    """The shapes (page, x, y, w, h; no page: every one) on each document's pages, as (doc_id, page, rx, ry, rw, rh)."""
    kinds = F.array(*(F.struct(F.lit(p).cast("bigint").alias("on"), *(F.lit(float(v)).alias(n) for n, v in zip(("rx", "ry", "rw", "rh"), r, strict=True))) for p, *r in shapes))
    return pages.select("doc_id", "page", F.inline(kinds)).where(F.col("on").isNull() | (F.col("on") == F.col("page"))).drop("on")


def images(pages: DataFrame) -> DataFrame:
    """An image of 400 by 500 points on each page, upright on odd pages and a quarter turned on even ones."""
    x, y = F.lit(50.0) + F.col("page") % 5, F.lit(100.0)
    flat = [F.lit(400.0), F.lit(0.0), F.lit(0.0), F.lit(500.0), x, y]
    turned = [F.lit(0.0), F.lit(500.0), F.lit(-400.0), F.lit(0.0), x + 400, y]
    return pages.select("doc_id", "page", F.lit(1).alias("image"), F.when(F.col("page") % 2 == 1, F.array(*flat)).otherwise(F.array(*turned)).alias("m"), F.lit(200).alias("pw"), F.lit(100).alias("ph"))


def form_tree(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, widgets): a field for each line of a document, within the one that stands one to three lines further up, as the line's
    length has it; its widget is the line's box."""
    rows = lines(docs)
    k = F.col("page") * PAGE_LINES + F.col("line_no") - PAGE_LINES
    up = k - 1 - F.length("text") % 3
    fields = rows.select("doc_id", k.alias("field"), F.when(up > 0, up).alias("parent"), F.col("text").alias("value"), F.concat(F.lit("default "), "text").alias("default_value"))
    return fields, boxes(rows).select("doc_id", "page", (F.col("page") * PAGE_LINES + F.col("line_no") - PAGE_LINES).alias("field"), "x0", "y0", "x1", "y1")


def structure(lines: DataFrame) -> DataFrame:
    """An element for each line, every third with an alternative text; in every eleventh document those at line 3 have no place."""
    missing = (F.col("doc_id") % 11 == 0) & (F.col("line_no") == 3)
    rows = boxes(lines).withColumn("x0", F.when(~missing, F.lit(50.0)))
    return rows.select("doc_id", "page", (F.col("page") * 100 + F.col("line_no")).alias("elem"), "x0", "y0", "x1", "y1", F.when(F.col("line_no") % 3 == 0, F.col("text")).alias("alt"))


def sections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, parts): a marked section for each line, with a secret if the line's length is a multiple of five, and parts that reach
    into the next section; those of lines with an e are removed."""
    at = F.col("line_no") * 100
    marked = lines.select("doc_id", "page", F.col("line_no").alias("section"), at.alias("start"), (at + 60).alias("stop"), F.when(F.length("text") % 5 == 0, F.concat(F.lit("secret "), "text")).alias("secret"))
    return marked, lines.select("doc_id", "page", (at + 10).alias("start"), (at + 110).alias("stop"), F.contains("text", F.lit("e")).alias("removed"))


def form_uses(docs: DataFrame) -> DataFrame:
    """A form for each line of a page. The page uses the forms of lines 1, 8, 15 and 22; a form uses the next one but for lines 7, 14
    and 21 and blank ones, the one two lines down, too, if its line has a z, and an earlier one, which is a cycle, if it has a
    capital Z; it draws an image if it has a digit. Pages draw one themselves."""
    cut = F.split("text", "\n")
    rows = docs.select("doc_id", F.size(cut).alias("all"), F.posexplode(cut).alias("pos", "text"))
    rows = rows.select("doc_id", (F.floor(F.col("pos") / PAGE_LINES).cast("bigint") + 1).alias("page"), (F.col("pos") % PAGE_LINES + 1).cast("bigint").alias("line_no"), "text", "all")
    rows = rows.withColumn("n", F.least(F.lit(PAGE_LINES), F.col("all") - (F.col("page") - 1) * PAGE_LINES))  # lines of the page
    k, n, has = F.col("line_no"), F.col("n"), lambda c: F.contains("text", F.lit(c))
    use = lambda p, c, kind: F.struct(p.cast("bigint").alias("parent"), c.cast("bigint").alias("child"), F.lit(kind).alias("kind"))
    found = F.array_compact(F.array(
        F.when(k % 7 == 1, use(F.lit(None), k, "form")), F.when(k == 1, use(F.lit(None), F.lit(1000), "image")), F.when((k < n) & (k % 7 != 0) & (F.col("text") != ""), use(k, k + 1, "form")),
        F.when((k + 2 <= n) & has("z"), use(k, k + 2, "form")), F.when(has("Z") & (k > 2), use(k, k - 2, "form")), F.when(F.col("text").rlike("[0-9]"), use(k, F.lit(1000), "image")),
    ))
    return rows.select("doc_id", "page", F.inline(found))


def objects(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, references): an object for each line. It refers to the next one, unless its length is a multiple of eight, and, if it holds 'the', to the one
    whose number is its length modulo the number of lines, so that references are shared and come back."""
    cut = docs.select("doc_id", F.split("text", "\n").alias("t")).select("doc_id", F.size("t").alias("n"), F.posexplode("t").alias("node", "text")).withColumn("node", F.col("node").cast("bigint"))
    refs = F.array_compact(F.array(F.when((F.length("text") % 8 != 0) & (F.col("node") + 1 < F.col("n")), F.col("node") + 1), F.when(F.contains("text", F.lit("the")), F.length("text") % F.col("n"))))
    return cut.select("doc_id", "node", "text"), cut.select("doc_id", F.col("node").alias("parent"), F.explode(refs).alias("child"))


#: Forms of a document, at most.
FORMS = 12


def shared_forms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses, segments): the first lines of a document are forms of one text each; a form uses the next one, twenty points further up, if
    its line is not blank and not a fourth one, and the one after that, forty points up, if its line holds an e. Every page uses the
    first form at its top and the one with the page's number modulo five lower down."""
    cut = docs.select("doc_id", F.split("text", "\n").alias("t")).select("doc_id", F.least(F.size("t"), F.lit(FORMS)).alias("n"), F.ceil(F.size("t") / PAGE_LINES).alias("pages"), "t")
    form = lambda k: F.concat(F.lit("f"), k.cast("string"))
    at = lambda x, y: F.array(*(F.lit(float(v)) for v in (1, 0, 0, 1)), *(v.cast("double") for v in (x, y)))
    use = lambda page, parent, name, child, m: F.struct(page.cast("bigint").alias("page"), parent.cast("string").alias("parent"), F.lit(name).alias("name"), child.alias("child"), F.lit("form").alias("kind"), m.alias("m"))
    rows = cut.select("doc_id", "n", F.posexplode(F.slice("t", 1, FORMS)).alias("k", "text")).withColumn("k", F.col("k") + 1)
    k, none, lit = F.col("k"), F.lit(None), F.lit
    inner = F.array_compact(F.array(
        F.when((k + 1 <= F.col("n")) & (F.col("text") != "") & (k % 4 != 0), use(none, form(k), "next", form(k + 1), at(lit(0), lit(20)))),
        F.when((k + 2 <= F.col("n")) & F.contains("text", lit("e")), use(none, form(k), "over", form(k + 2), at(lit(0), lit(40)))),
    ))
    pages = cut.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("p"))
    p = F.col("p")
    outer = F.array_compact(F.array(use(p, none, "top", form(lit(1)), at(lit(50), lit(680))), F.when(p % 5 + 1 <= F.col("n"), use(p, none, "low", form(p % 5 + 1), at(lit(50), 480 + p)))))
    uses = rows.select("doc_id", F.inline(inner)).unionByName(pages.select("doc_id", F.inline(outer)))
    segments = rows.select("doc_id", form(k).alias("form"), F.lit(1).alias("seq"), "text", F.lit(0.0).alias("x"), F.lit(10.0).alias("y"), (F.length("text") * 7.0).alias("w"), F.lit(14.0).alias("size"))
    return uses, segments


def edited_pages(docs: DataFrame) -> dict[str, DataFrame]:
    """What export_plan takes, from the lines of documents: redactions over lines about licenses, and over the left half of every fifth line
    with a z; notes, form fields and edits on other lines; widgets and structure elements of which some have no place. Sources hold
    six pages, pictures the odd ones; every ninth page of a document is blank."""
    rows = lines(docs)
    k, n, has = F.col("line_no"), F.length("text"), lambda c: F.contains("text", F.lit(c))
    ann = lambda kind, w, h, orig, text: F.struct(F.lit(kind).alias("type"), w.alias("w"), h.alias("h"), orig.cast("string").alias("orig_text"), F.lit(text).cast("string").alias("text2"))
    lit, none = (lambda v: F.lit(float(v))), F.lit(None)
    kinds = F.array_compact(F.array(
        F.when(F.contains(F.lower("text"), F.lit("license")), ann("redact", F.col("w"), lit(16.8), none, None)), F.when((k % 5 == 0) & has("z") & (n > 4), ann("redact", F.col("w") / 2, lit(16.8), none, None)),
        F.when(k % 6 == 1, ann("text", lit(70), lit(14), none, "note")), F.when(k % 9 == 2, ann("formfield", lit(90), lit(14), none, None)), F.when((k % 4 == 0) & has("the"), ann("edit", F.col("w"), lit(14), F.col("text"), "EDITED")),
    ))
    found = rows.select("doc_id", "page", "line_no", "x", "y", F.posexplode(kinds).alias("i", "a"))
    redacts = F.col("a.type") == "redact"
    anns = found.select(
        "doc_id", "page", (F.col("page") * 1000 + F.col("line_no") * 10 + F.col("i")).alias("ann_id"), F.col("line_no").alias("z"), F.col("a.type").alias("type"), "x",
        F.when(redacts, F.round(F.col("y") - 4.2, 6)).otherwise(F.col("y")).alias("y"), F.col("a.w").alias("w"), F.col("a.h").alias("h"), F.lit(None).cast("double").alias("x2"), F.lit(None).cast("double").alias("y2"),
        F.lit(None).cast("array<struct<x:double,y:double>>").alias("pts"), F.col("a.orig_text").alias("orig_text"), F.col("a.text2").alias("text"),
    )
    box = lambda where, known: rows.where(where).select("doc_id", "page", F.when(known, F.col("x")).alias("x0"), (F.col("y") - 3).alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + 11).alias("y1"), F.col("text").alias("alt"))
    pages = rows.groupBy("doc_id", "page").agg(F.first(F.lit(1))).select("doc_id", "page")
    p = F.col("page")
    return {
        "pages": pages.select("doc_id", "page", F.when(p % 9 != 0, "main").alias("src"), ((p - 1) * 90 % 360).cast("int").alias("rot"), F.when(p % 5 == 0, (p % 4).cast("int")).otherwise(0).alias("flip")),
        "sources": pages.where("page <= 6").select("doc_id", F.lit("main").alias("src"), "page", F.when(p % 2 == 0, 90).otherwise(0).alias("intrinsic")),
        "lines": rows, "anns": anns, "widgets": box(k == 3, n % 13 != 0), "source_anns": box(k == 7, n % 13 != 1), "elements": box(k % 3 == 0, n % 29 != 0), "rasters": pages.where("page % 2 = 1"),
    }
