"""Tables that no test file holds, derived row by row from the given ones: rasters, recognised words, annotations,
form fields, edit logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RASTERS
from .text_documents import WORDS_A_LINE

RASTER_W, RASTER_H = 96, 48


def _word_no(item: Column) -> Column:
    return item["seq"] % WORDS_A_LINE


def jittered(pages: DataFrame) -> DataFrame:
    """Pages of items whose baselines go up and down by 0.9 points from word to word."""
    return pages.withColumn("items", F.transform("items", lambda i: i.withField("y", i["y"] + (_word_no(i) % 3 - 1) * F.lit(0.9))))


def spread(pages: DataFrame) -> DataFrame:
    """Pages of items with a gap of 47 points behind each line's second word and one of 14 behind its fourth."""
    more = lambda i: F.when(_word_no(i) >= 4, 47.0).when(_word_no(i) >= 2, 40.0).otherwise(0.0)
    return pages.withColumn("items", F.transform("items", lambda i: i.withField("x", i["x"] + more(i))))


def ocr_words(pages: DataFrame) -> DataFrame:
    """Items as recognised words, y down, with heights and places that differ by word and every 17th word unsure."""
    bump = lambda i: (_word_no(i) % 3).cast("double")
    word = lambda i: F.struct(
        i["seq"].alias("seq"), i["str"].alias("text"), i["x"].alias("x0"), (i["x"] + i["w"]).alias("x1"), (800 - i["y"] - 10 + bump(i) * 1.5).alias("y0"), (800 - i["y"] + bump(i) / 2).alias("y1"),
        F.when(i["seq"] % 17 == 0, 30.0).otherwise(90.0).alias("confidence"),
    )
    return pages.select("doc_id", "page", F.transform("items", word).alias("items"))


def page_features(pages: DataFrame) -> DataFrame:
    """What a parser would say of each page: every nineteenth page each has one of the things that redaction refuses, or does
    not know it (null)."""
    f = (F.col("doc_id") * 7 + F.col("page")) % 19
    known = lambda k: f == k
    return pages.select(
        "doc_id", "page", (f != 1).alias("has_content"), F.when(known(2), "F1, F2").alias("bad_fonts"), known(3).alias("inline_images"), known(4).alias("patterns"), F.when(f != 6, known(5)).alias("unrecognized"),
        known(7).alias("nested_images"), F.when(known(8), "no decoder").alias("image_problem"), F.when(f != 10, known(9)).alias("form_problem"),
    )


def pdf_items(lines: DataFrame) -> DataFrame:
    """Lines as text items with a text matrix."""
    size = F.col("size")
    return lines.select("doc_id", "page", (F.col("page") * 100 + F.col("line_no")).alias("seq"), F.col("text").alias("str"), F.array(size, F.lit(0.0), F.lit(0.0), size, F.col("x"), F.col("y")).alias("transform"), F.col("w").alias("width"))


def rasters(docs: DataFrame) -> DataFrame:
    """One raster per document: white, with a dark box in three of four, glyph-like strokes, a speck, and, in every third
    document, light text on the box."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d in pdf["doc_id"].tolist():
                p = np.full((RASTER_H, RASTER_W, 4), 255, np.uint8)
                if d % 4:
                    x, w = 2 + d % 5, 60 + d % 7
                    p[4:24, x : x + w, :3] = 10
                    if d % 3 == 0:
                        p[7:13, [c for c in range(10, 34) if c % 5 < 3], :3] = 250
                p[30:32, 10:60:3, :3] = 0
                p[40:43, 80:83, :3] = 0
                rows.append((d, 1, RASTER_W, RASTER_H, p.tobytes()))
            yield pd.DataFrame(rows, columns=RASTERS.fieldNames())

    return docs.where(F.col("text").isNotNull()).select("doc_id").mapInPandas(run, RASTERS)


def raster_runs(docs: DataFrame) -> DataFrame:
    """A run of text through the place of the box, one below it."""
    word = F.coalesce(F.nullif(F.regexp_replace("text", r"\s+", "_"), F.lit("")), F.lit("empty"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.lit(1).cast("bigint").alias("page"), F.explode(F.array(F.lit(7.0), F.lit(34.0))).alias("y"), word.alias("text"))
    return rows.select("doc_id", "page", F.col("y").cast("bigint").alias("seq"), "text", F.lit(10.0).alias("x"), "y", F.lit(24.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(6.0).alias("height"))


def annotations(lines: DataFrame) -> DataFrame:
    """An annotation on each line of a page; types take turns."""
    kinds = F.array(*map(F.lit, ("text", "highlight", "arrow", "ink", "formfield")))
    kind = F.element_at(kinds, (F.col("line_no") % 5 + 1).cast("int"))
    point = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return lines.select(
        "doc_id", "page", (F.col("page") * 100 + F.col("line_no")).alias("ann_id"), F.col("line_no").alias("z"), kind.alias("type"), "x", "y", "w", F.col("size").alias("h"),
        (F.col("x") + F.col("w")).alias("x2"), (F.col("y") - 5).alias("y2"), F.array(point(0.0, 0.0), point(9.0, 4.0), point(-1.0, 2.0)).alias("pts"),
    )


def form_fields(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three fields per document, and values for four documents of five, some of which a field cannot take."""
    field = lambda n, k, v: F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), v.alias("value"))
    three = F.array(field("name", "text", F.col("text")), field("agree", "checkbox", F.lit("false")), field("choice", "dropdown", F.lit("a")))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.inline(three)).withColumn("options", F.array(F.lit("a"), F.lit("b")))
    new = (
        F.when(F.col("name") == "name", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
        .when(F.col("name") == "agree", F.when(F.col("doc_id") % 2 == 0, "true").otherwise("maybe"))
        .otherwise(F.when(F.col("doc_id") % 3 == 0, "b").otherwise("z"))
    )
    return rows, rows.where("doc_id % 5 <> 0").select("doc_id", "name", new.alias("new_value"))


def actions(conversations: DataFrame) -> DataFrame:
    """A log per conversation, one page a turn: page edits that are taken back and done again, annotations that are added, changed,
    mirrored and deleted with and without their page, a merge, a move, a blank page; every third takes its last step back."""
    ids = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat(F.lit("p"), k.cast("string")))
    own = lambda v, kind: F.lit(v).cast(kind)
    log = [
        ("open", None, None, None, ids, None), ("delete", "p1"), ("duplicate", "p2"), ("undo",), ("undo",), ("rotate", "p1", None, 90), ("undo",), ("redo",), ("redo",),
        ("annAdd", "p1", None, None, None, '{"x": 10, "y": 20, "w": 30, "h": 40, "text": "one"}'), ("annAdd", "p1", None, None, None, '{"x": 100, "y": 200, "w": 5, "h": 6, "text": "two"}'),
        ("annUpd", "a10", None, None, None, '{"text": "uno"}'), ("flip", "p1", None, 1), ("merge", "p1", None, None, F.array(F.lit("q1"), F.lit("q2"))), ("annAdd", "q1", None, None, None, '{"x": 1, "y": 2, "text": "gone"}'),
        ("reorder", "p1", "q2"), ("setRots", None, None, 180, F.array(F.lit("q2"))), ("blank", "p1", None, None, None, '{"w": 300, "h": 400}'), ("delete", "q1"), ("annDel", "a11"),
    ]
    steps = []
    for seq, step in enumerate(log, 1):
        kind, target, other, amount, pages, payload = (*step, *[None] * (6 - len(step)))
        pages = pages if pages is not None else own(None, "array<string>")
        steps.append(F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("type"), own(target, "string").alias("target"), own(other, "string").alias("other"), own(amount, "int").alias("amount"), pages.alias("ids"), own(payload, "string").alias("payload")))
    nothing = own(None, "string")
    last = F.when(F.col("doc_id") % 3 == 0, "undo").otherwise("redo")
    steps.append(F.struct(F.lit(len(log) + 1).cast("bigint").alias("seq"), last.alias("type"), nothing.alias("target"), nothing.alias("other"), own(None, "int").alias("amount"), own(None, "array<string>").alias("ids"), nothing.alias("payload")))
    return conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.inline(F.array(*steps)))


def planted(pages: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(output, covered): each document's pages as one text, and as content, before which its first covered string stands in a form that
    follows from doc_id; and a short string, which is covered, too."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n")
    kept = pages.groupBy("doc_id").agg(text.alias("text"))
    both = covered.groupBy("doc_id").agg(F.min("covered").alias("s")).join(kept, "doc_id")
    s, form = F.col("s"), F.col("doc_id") % 7
    utf8 = lambda c: F.encode(c, "UTF-8")
    latin1 = F.when(s.rlike("^[\\x00-\\xff]*$"), F.encode(s, "ISO-8859-1")).otherwise(F.encode(F.lit(""), "UTF-8"))
    forms = F.when(form == 1, utf8(s)).when(form == 2, F.encode(s, "UTF-16BE")).when(form == 3, F.encode(s, "UTF-16LE")).when(form == 4, utf8(F.hex(utf8(s)))).when(form == 5, utf8(F.regexp_replace(s, "(.)", "\\\\$1"))).when(form == 6, latin1).otherwise(utf8(F.lit("")))
    word = F.concat(F.lit("k"), (F.col("doc_id") % 10).cast("string"))
    way = F.col("doc_id") % 5
    short = F.when(way == 1, F.concat(F.lit(" "), word, F.lit(" "))).when(way == 2, F.concat(F.lit("x"), word, F.lit("x"))).when(way == 3, F.concat(F.lit("("), word, F.lit(")"))).when(way == 4, F.concat(F.lit("<"), F.hex(utf8(word)), F.lit(">"))).otherwise("")
    content = F.concat(forms, utf8(F.concat(F.lit("\n"), short, F.lit("\n"))), utf8(F.col("text")))
    return both.select("doc_id", "text", content.alias("content")), covered.unionByName(both.select("doc_id", word.alias("covered")))


def edited_versions(docs: DataFrame) -> DataFrame:
    """(left_doc, right_doc, a, b): each text and itself without every seventh line, every eleventh replaced."""
    kept = F.array_compact(F.transform(F.split("text", "\n", -1), lambda t, k: F.when(k % 7 != 3, F.when(k % 11 == 5, F.concat(F.lit("\u0001"), k.cast("string"))).otherwise(t))))
    return docs.where("text IS NOT NULL").select(F.col("doc_id").alias("left_doc"), F.col("doc_id").alias("right_doc"), F.col("text").alias("a"), F.array_join(kept, "\n").alias("b"))


def line_edits(docs: DataFrame) -> DataFrame:
    """Edits (doc_id, start, end, new): each line's first three characters become its number; spans that reach into that one, and over
    the line's end into the next line's, are there, too."""
    cut = F.split("text", "\n", -1)
    rows = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.transform(cut, lambda t: F.length(t))).alias("k", "n"))
    start = F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(start, F.lit(0)))
    at, n = F.col("at"), F.col("n")
    edit = lambda a, b, new: F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"), new.alias("new"))
    number = F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]"))
    found = F.array_compact(F.array(edit(at, at + F.least(n, F.lit(3)), number), F.when(n > 6, edit(at + 2, at + 5, F.lit("never"))), F.when((n > 0) & (n % 4 == 0), edit(at + n - 1, at + n + 2, F.lit("|")))))
    return rows.select("doc_id", F.inline(found))


def pixel_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, page, px0, py0, px1, py1): a range below each raster's box, as far right and as wide as the text's length has it; of every
    eleventh length it is not known."""
    n = F.length("text")
    px0 = F.when(n % 11 != 0, 20 + n % 30)
    return docs.where("text IS NOT NULL").select("doc_id", F.lit(1).cast("bigint").alias("page"), px0.cast("bigint").alias("px0"), F.lit(34).cast("bigint").alias("py0"), (px0 + 10 + n % 20).cast("bigint").alias("px1"), F.lit(47).cast("bigint").alias("py1"))


def image_files(docs: DataFrame) -> DataFrame:
    """(doc_id, content): heads of PNG and JPEG files whose sizes follow from the text's, the latter behind two other segments, and texts."""
    n, four, two = F.length("text"), lambda c: F.lpad(F.hex(c), 8, "0"), lambda c: F.lpad(F.hex(c % 65536), 4, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(F.col("n_chars")), four(n), F.lit("0806000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0004ABCDFFC0001108"), two(n), two(F.col("n_chars")), F.lit("03012200"))
    content = F.when(F.col("doc_id") % 3 == 0, F.unhex(png)).when(F.col("doc_id") % 3 == 1, F.unhex(jpeg)).otherwise(F.encode("text", "UTF-8"))
    return docs.where("text IS NOT NULL").select("doc_id", content.alias("content"))
