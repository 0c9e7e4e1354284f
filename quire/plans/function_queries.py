"""Registered queries over column functions and small operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.ranges import bad_part, parse_rect, strict_ranges
from ..functions.strings import encoded, file_name, iso_date
from ..operators import annots, grouping, leaks, redact, text
from ..sources import files, fixtures
from ..sources import text_documents as src
from .queries import ANN_SQL, COVER_SQL, LINES, N_SQL, PAGES, RECTS, WORDS_SQL, docs, page_rows, query

@query(r"""SELECT doc_id, list_filter(string_split('1-3,' || substr(text, 1, 3) || ',' || n_chars % 100, ','), lambda p: NOT regexp_matches(p, '^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$'))[1] AS bad FROM documents WHERE text IS NOT NULL""")
def bad_ranges(spark, sf_dir):
    """SEL2: the part that a strict caller refuses, here what texts begin with."""
    spec = F.concat(F.lit("1-3,"), F.substring("text", 1, 3), F.lit(","), (F.col("n_chars") % 100).cast("string"))
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", bad_part(spec).alias("bad"))


@query("SELECT doc_id, CASE length(text) % 3 WHEN 2 THEN '0,1,2' WHEN 1 THEN '0,1' ELSE '0' END AS listed FROM documents WHERE text IS NOT NULL")
def strict_range_lists(spark, sf_dir):
    """SEL3: sorted and distinct, clipped to the document."""
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.array_join(strict_ranges(F.lit("3-1, 2"), F.length("text") % 3 + 1), ",").alias("listed"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 <> 0 THEN length(text) % 9 END AS page, CASE WHEN n_chars % 3 <> 0 THEN -1.5::DOUBLE END AS x, CASE WHEN n_chars % 3 <> 0 THEN n_chars::DOUBLE END AS w FROM documents WHERE text IS NOT NULL")
def rect_specs(spark, sf_dir):
    """SEL5: pages and widths from the texts' lengths; of every third length a number is missing."""
    spec = F.concat((F.length("text") % 9).cast("string"), F.when(F.col("n_chars") % 3 == 0, ":1,2").otherwise(F.concat(F.lit(": -1.5, 2,"), F.col("n_chars").cast("string"), F.lit(",4"))))
    r = parse_rect(spec)
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", r["page"].alias("page"), r["x"].alias("x"), r["w"].alias("w"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def session_round_trip(spark, sf_dir):
    """SNK7 and SRC9: saved as JSON and restored, byte for byte."""
    pages = F.array(F.struct(F.lit(1).cast("bigint").alias("page"), F.lit(90).alias("rot"), F.lit(0).alias("flip")))
    rows = docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.lit("n").alias("name"), pages.alias("pages"), "text")
    return files.restore_session(files.session_json(rows)).select("doc_id", "text")


@query("SELECT doc_id, CAST(least(greatest(n_chars, 400), 4000) AS BIGINT) AS side, least(greatest((doc_id % 12)::DOUBLE / 10, 0.3::DOUBLE), 0.95::DOUBLE) AS quality FROM documents")
def export_settings(spark, sf_dir):
    """SNK9."""
    side, quality = files.clamp_compression(F.col("n_chars"), (F.col("doc_id") % 12) / F.lit(10.0))
    return docs(spark, sf_dir).select("doc_id", side.cast("bigint").alias("side"), quality.alias("quality"))


@query("SELECT doc_id, round((n_chars + 1) * least(1, 2000.0::DOUBLE / greatest(n_chars + 1, 1000)), 6) AS w, round(1000 * least(1, 2000.0::DOUBLE / greatest(n_chars + 1, 1000)), 6) AS h FROM documents")
def image_pages(spark, sf_dir):
    """SRC7: the longer side at most 2,000."""
    w, h = files.fit_page((F.col("n_chars") + 1).cast("double"), F.lit(1000.0))
    return docs(spark, sf_dir).select("doc_id", F.round(w, 6).alias("w"), F.round(h, 6).alias("h"))


@query("SELECT doc_id, regexp_replace(substr(text, 1, 24) || '(*)-' || doc_id || '.pdf', '[^A-Za-z0-9_.\\-]+', '_', 'g') AS name FROM documents WHERE text IS NOT NULL")
def safe_names(spark, sf_dir):
    """FN5: names from what texts begin with."""
    name = F.concat(F.substring("text", 1, 24), F.lit("(*)-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", file_name(name).alias("name"))


@query(f"WITH {LINES} SELECT doc_id, page, line_no, hex(encode(text)) AS utf8, CAST(length(text) * 2 AS BIGINT) AS utf16, CASE WHEN regexp_matches(text, '^[\\x00-\\xff]*$') THEN CAST(length(text) AS BIGINT) END AS latin1 FROM lines WHERE NOT regexp_matches(text, '[^\\x00-\\x{{ffff}}]')")
def byte_forms(spark, sf_dir):
    """FN9 and FN10: bytes of a text in UTF-8, sizes in UTF-16 and, where it fits, Latin-1."""
    rows = src.lines(docs(spark, sf_dir)).where(~F.col("text").rlike(r"[^\x00-\x{ffff}]"))
    form = encoded(F.col("text"))
    size = lambda c: F.length(c).cast("bigint")
    return rows.select("doc_id", "page", "line_no", F.decode(form["hex"], "UTF-8").alias("utf8"), size(form["utf16le"]).alias("utf16"), size(form["latin1"]).alias("latin1"))


@query("SELECT doc_id, round((length(text) % 256)::DOUBLE / 255, 9) AS r, 1.0::DOUBLE AS g, 0.0::DOUBLE AS b, round(0.2126::DOUBLE * ((length(text) % 256)::DOUBLE / 255) + 0.7152::DOUBLE, 9) AS luma FROM documents WHERE text IS NOT NULL")
def colours(spark, sf_dir):
    """FN23."""
    c = g.rgb(F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.length("text") % 256)), 2, "0"), F.lit("ff00")))
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.round(c["r"], 9).alias("r"), c["g"].alias("g"), c["b"].alias("b"), F.round(g.luminance(c["r"], c["g"], c["b"]), 9).alias("luma"))


@query(f"WITH {COVER_SQL} SELECT DISTINCT doc_id, trim(text, ' ') AS covered FROM marked WHERE coverage <> 'none' AND trim(text, ' ') <> ''")
def covered_strings(spark, sf_dir):
    """RW11 and AGG6: strings of partly covered lines, too."""
    return redact.covered_strings(redact.coverage(src.lines(docs(spark, sf_dir)), RECTS), partial_too=True)


@query(f"""WITH {WORDS_SQL}, h AS (SELECT doc_id, page, (10 + (k % 3)::DOUBLE / 2 - (k % 3)::DOUBLE * 1.5::DOUBLE) AS h FROM words), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY h) AS i, count(*) OVER (PARTITION BY doc_id, page) AS n FROM h)
SELECT doc_id, page, round(h, 6) AS height FROM r WHERE i = n // 2 + 1""")
def median_heights(spark, sf_dir):
    """AGG10: the upper median of a page's word heights."""
    words = fixtures.ocr_words(src.page_words(docs(spark, sf_dir))).select("doc_id", "page", F.inline("items"))
    return grouping.median_height(words).withColumn("height", F.round("height", 6))


@query(f"WITH {LINES}, n AS (SELECT doc_id, page, line_no, 'field' || line_no % 4 AS name, row_number() OVER (PARTITION BY doc_id, line_no % 4 ORDER BY page, line_no) AS i FROM lines) SELECT doc_id, page, line_no, CASE WHEN i > 1 THEN name || '_' || i ELSE name END AS name FROM n")
def widget_names(spark, sf_dir):
    """RW27."""
    rows = src.lines(docs(spark, sf_dir)).select("doc_id", "page", "line_no", F.concat(F.lit("field"), (F.col("line_no") % 4).cast("string")).alias("name"), (F.col("page") * 100 + F.col("line_no")).alias("seq"))
    return annots.unique_names(rows).drop("seq")


@query(f"WITH {PAGES} SELECT doc_id, page, CAST((rot + 90 * (page % 3)) % 360 AS INTEGER) AS rot FROM pages")
def shown_rotations(spark, sf_dir):
    """A page's own rotation and the user's, added up."""
    rows = page_rows(spark, sf_dir)
    own = rows.select("doc_id", "page", F.col("rot").alias("own"))
    user = rows.select("doc_id", "page", (90 * (F.col("page") % 3)).cast("int").alias("turned"))
    return user.join(own, ["doc_id", "page"], "left").select("doc_id", "page", F.pmod(F.col("own") + F.col("turned"), F.lit(360)).cast("int").alias("rot"))


PIXELS_SQL = """n AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 4 <> 0 THEN (60 + doc_id % 7) * 20 ELSE 0 END AS box, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN 90 ELSE 0 END AS light FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, 20 + n % 30 AS px0, 12 + n % 20 AS w FROM n)"""


@query(f"""WITH {PIXELS_SQL} SELECT doc_id, CAST(1 AS BIGINT) AS page, n % 11 <> 0 AS ok, CASE WHEN n % 11 <> 0 THEN round((255 * (96 * 48 - 43 - box - w * 15) + 10 * (box - light) + 250 * light)::DOUBLE / (96 * 48), 6) END AS mean FROM p""")
def redact_pixels(spark, sf_dir):
    """RW12: ranges of pixels made black, grown by one; a range that is not known refuses its page."""
    rows = docs(spark, sf_dir)
    out = leaks.blackened(fixtures.rasters(rows), fixtures.pixel_ranges(rows))
    means = leaks.canvases(out.where("ok")).select("doc_id", "page", F.round("r", 6).alias("mean"))
    return out.select("doc_id", "page", "ok").join(means, ["doc_id", "page"], "left")


@query(f"""WITH {PIXELS_SQL} SELECT doc_id, CAST(1 AS BIGINT) AS page, CAST(doc_id % 4 <> 0 AS INTEGER) AS box, CAST(px0 - 1 AS INTEGER) AS x, 33 AS y, CAST(w AS INTEGER) AS w, 15 AS h FROM p WHERE n % 11 <> 0""")
def redacted_boxes(spark, sf_dir):
    """RW12 and RW19: what was made black is found again as solid boxes."""
    rows = docs(spark, sf_dir)
    out = leaks.blackened(fixtures.rasters(rows), fixtures.pixel_ranges(rows)).where("ok")
    return leaks.solid_boxes(out).where("y > 24").select("doc_id", "page", "box", "x", "y", "w", "h")


@query("""WITH d AS (SELECT doc_id, length(text) AS n, make_timestamp(2000 + n_chars % 30, 1 + length(text) % 12, 1 + length(text) % 28, length(text) % 24, length(text) % 60, 0) AS t, (length(text) % 5) * 60 + 30 AS off FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN n % 3 = 0 THEN strftime(t - to_minutes(off), '%Y-%m-%dT%H:%M:%S') || '.000Z' WHEN n % 3 = 1 THEN strftime(date_trunc('month', t), '%Y-%m-%dT%H:%M:%S') || '.000Z' END AS iso FROM d""")
def iso_dates(spark, sf_dir):
    """FN26: dates of metadata with an offset, cut short, and none."""
    n, two = F.length("text"), lambda c: F.lpad(c.cast("string"), 2, "0")
    month = F.concat(F.lit("D:"), (2000 + F.col("n_chars") % 30).cast("string"), two(1 + n % 12))
    whole = F.concat(month, two(1 + n % 28), two(n % 24), two(n % 60), F.lit("00+"), two(n % 5), F.lit("'30'"))
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", iso_date(F.when(n % 3 == 0, whole).when(n % 3 == 1, month).otherwise(F.concat(month, F.lit("32")))).alias("iso"))


@query(f"""WITH {LINES}, a AS (SELECT *, cos(radians(line_no * 7.0::DOUBLE)) AS c, sin(radians(line_no * 7.0::DOUBLE)) AS s FROM lines),
q AS (SELECT doc_id, page, line_no, unnest([x, x + w, x, x + w]) - 300 AS px, unnest([y, y, y + 16.8::DOUBLE, y + 16.8::DOUBLE]) - 400 AS py, c, s FROM a)
SELECT doc_id, page, line_no, round(min(300 + px * c - py * s), 6) AS rx, round(min(400 + px * s + py * c), 6) AS ry, round(max(px * c - py * s) - min(px * c - py * s), 6) AS rw, round(max(px * s + py * c) - min(px * s + py * c), 6) AS rh FROM q GROUP BY doc_id, page, line_no""")
def turned_rects(spark, sf_dir):
    """FN16: a line's box after a turn by seven degrees for each line above it, and its own."""
    rows = src.lines(docs(spark, sf_dir))
    out = g.turned_rect(F.col("x"), F.col("y"), F.col("w"), F.lit(16.8), F.lit(600.0), F.lit(800.0), F.col("line_no") * 7.0)
    return rows.select("doc_id", "page", "line_no", *(F.round(c, 6).alias(n) for c, n in zip(out, ("rx", "ry", "rw", "rh"), strict=True)))


@query(f"""WITH {ANN_SQL}, t AS (SELECT *, (page - 1) * 90 % 360 AS rot, line_no_of % 4 AS flip FROM (SELECT *, ann_id % 100 AS line_no_of FROM anns)),
d AS (SELECT *, CASE rot WHEN 0 THEN x - 10 WHEN 90 THEN y - 20 WHEN 180 THEN 610 - x ELSE 820 - y END AS u, CASE rot WHEN 0 THEN 820 - y WHEN 90 THEN x - 10 WHEN 180 THEN y - 20 ELSE 610 - x END AS v,
  CASE WHEN rot IN (0, 180) THEN 600 ELSE 800 END AS pw, CASE WHEN rot IN (0, 180) THEN 800 ELSE 600 END AS ph FROM t),
f AS (SELECT *, CASE WHEN page % 4 IN (1, 3) THEN pw - u ELSE u END AS fu, CASE WHEN page % 4 IN (2, 3) THEN ph - v ELSE v END AS fv FROM d)
SELECT doc_id, page, ann_id, round(fu, 6) AS x, round(ph - fv, 6) AS y FROM f WHERE type IN ('text', 'arrow')""")
def anns_on_turned_pages(spark, sf_dir):
    """FN18 and FN19: points of annotations on pages that are turned, mirrored and do not begin at the origin."""
    rows = fixtures.annotations(src.lines(docs(spark, sf_dir)))
    p = F.col("page")
    pages = page_rows(spark, sf_dir).select("doc_id", "page", F.lit(10.0).alias("bx"), F.lit(20.0).alias("by"), F.lit(600.0).alias("bw"), F.lit(800.0).alias("bh"), "rot", (p % 4).cast("int").alias("flip"))
    out = annots.to_turned_display(rows, pages).where("type IN ('text', 'arrow')")
    return out.select("doc_id", "page", "ann_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""SELECT doc_id, '{{' || chr(10) || '  "page_count": ' || {N_SQL} || ',' || chr(10) || '  "n_lines": ' || len(string_split(text, chr(10))) || ',' || chr(10) || '  "width": 600.0,' || chr(10) || '  "height": 800.0' || chr(10) || '}}' AS json FROM documents WHERE text IS NOT NULL""")
def info_json_pretty(spark, sf_dir):
    """FN8: a field a line."""
    return text.as_pretty_json(text.info(docs(spark, sf_dir)).drop("title"))


@query(f"""WITH {PAGES}, f AS (SELECT doc_id, substr(string_agg('[page ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page), 1, 50000) AS t FROM pages GROUP BY doc_id)
SELECT doc_id, '{text.UNTRUSTED}' || chr(10) || '<document-text>' || chr(10) || t || chr(10) || '</document-text>' AS text FROM f""")
def delimited_text(spark, sf_dir):
    """PRJ5: capped text between marks that say it is data."""
    return text.delimited(text.framed(docs(spark, sf_dir), "[page {}]", 50_000))


@query("""SELECT doc_id, CAST(greatest(1, floor((n_chars + 1)::DOUBLE * least(3.0::DOUBLE, 1500.0::DOUBLE / greatest(n_chars + 1, 700)))) AS INTEGER) AS w, CAST(greatest(1, floor(700.0::DOUBLE * least(3.0::DOUBLE, 1500.0::DOUBLE / greatest(n_chars + 1, 700)))) AS INTEGER) AS h, 0.7::DOUBLE AS quality,
  CASE WHEN n_chars > 0 THEN round(length(text)::DOUBLE / 2 / n_chars, 9) ELSE 1.0::DOUBLE END AS ratio FROM documents WHERE text IS NOT NULL""")
def compression_plans(spark, sf_dir):
    """SNK9: a preset's pixels for a page, and what is left of the size."""
    rows = docs(spark, sf_dir).where("text IS NOT NULL")
    w, h, quality = files.compressed_size((F.col("n_chars") + 1).cast("double"), F.lit(700.0), "medium")
    return rows.select("doc_id", w.alias("w"), h.alias("h"), quality.alias("quality"), F.round(files.saved(F.col("n_chars"), F.length("text") / 2), 9).alias("ratio"))


@query("""SELECT doc_id, CAST(n_chars AS INTEGER) AS width, CAST(length(text) AS INTEGER) AS height FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0
UNION ALL SELECT doc_id, CAST(n_chars % 65536 AS INTEGER), CAST(length(text) % 65536 AS INTEGER) FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 1 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 2""")
def image_sizes(spark, sf_dir):
    """SRC7: sizes from the headers of PNG and JPEG files, none from others."""
    return fixtures.image_files(docs(spark, sf_dir)).select("doc_id", files.image_size(F.col("content")).alias("s")).select("doc_id", "s.width", "s.height")


@query(f"""WITH {ANN_SQL}, c AS (SELECT *, (ann_id % 7) / 10.0::DOUBLE AS opacity, 1.0::DOUBLE + page % 3 AS width, atan2(y2 - y, x2 - x) AS t FROM anns WHERE type <> 'formfield'),
h AS (SELECT *, greatest(8.0::DOUBLE, width * 4) AS head FROM c),
s AS (SELECT doc_id, page, ann_id, z, 0 AS k, 'fill' AS op, x AS x0, y AS y0, x + w AS x1, y + h AS y1, opacity, NULL::DOUBLE AS stroke, NULL::DOUBLE AS size, NULL AS text FROM h WHERE type = 'highlight'
  UNION ALL SELECT doc_id, page, ann_id, z, 0, 'line', x, y, x2, y2, opacity, width, NULL, NULL FROM h WHERE type = 'arrow'
  UNION ALL SELECT doc_id, page, ann_id, z, 1, 'line', x2, y2, x2 - head * cos(t - pi() / 7), y2 - head * sin(t - pi() / 7), opacity, width, NULL, NULL FROM h WHERE type = 'arrow'
  UNION ALL SELECT doc_id, page, ann_id, z, 2, 'line', x2, y2, x2 - head * cos(t + pi() / 7), y2 - head * sin(t + pi() / 7), opacity, width, NULL, NULL FROM h WHERE type = 'arrow'
  UNION ALL SELECT doc_id, page, ann_id, z, 0, 'line', x, y, x + 9, y + 4, opacity, width, NULL, NULL FROM h WHERE type = 'ink' UNION ALL SELECT doc_id, page, ann_id, z, 1, 'line', x + 9, y + 4, x - 1, y + 2, opacity, width, NULL, NULL FROM h WHERE type = 'ink'
  UNION ALL SELECT doc_id, page, ann_id, z, 0, 'text', x, y, x, y, 1.0, NULL, 4.0::DOUBLE + page, 'note ' || ann_id FROM h WHERE type = 'text')
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY z, ann_id, k) AS step, ann_id, op, x0, y0, round(x1, 6) AS x1, round(y1, 6) AS y1, 1.0::DOUBLE AS r, round((ann_id % 256)::DOUBLE / 255, 9) AS g, 0.0::DOUBLE AS b, opacity, stroke, size, text FROM s""")
def paint_steps(spark, sf_dir):
    """RW25: what is painted for each annotation, with colour, opacity, stroke and text."""
    anns = fixtures.annotations(src.lines(docs(spark, sf_dir)))
    n = F.col("ann_id")
    styled = anns.withColumns({
        "colour": F.concat(F.lit("#ff"), F.lpad(F.lower(F.hex(n % 256)), 2, "0"), F.lit("00")), "opacity": n % 7 / F.lit(10.0), "width": 1.0 + F.col("page") % 3, "size": F.col("page") + 4.0, "text": F.concat(F.lit(" note  "), n.cast("string")),
    })
    rounded = {c: F.round(c, 6) for c in ("x1", "y1")} | {"g": F.round("g", 9)}
    return annots.paint(styled).withColumns(rounded)


@query(f"""WITH {LINES} SELECT doc_id, 'f' || line_no AS name, CASE line_no % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' ELSE 'dropdown' END AS kind, text AS value, CASE WHEN line_no % 7 = 0 THEN 1 ELSE page END AS page,
  x - 10 AS x, y - 23 AS y, w, 14.0::DOUBLE AS h FROM lines WHERE line_no % 4 <> 3 AND line_no % 13 <> 0""")
def listed_fields(spark, sf_dir):
    """SRC10: fields that can be filled in, with their pages and places within the page's box; those of no page are on the first."""
    rows = src.lines(docs(spark, sf_dir))
    k = F.col("line_no")
    kind = F.when(k % 4 == 0, "text").when(k % 4 == 1, "checkbox").when(k % 4 == 2, "dropdown").otherwise("signature")
    key = F.col("page") * 100 + k
    fields = rows.select("doc_id", key.alias("field"), F.concat(F.lit("f"), k.cast("string")).alias("name"), kind.alias("kind"), F.col("text").alias("value"))
    left = F.when(k % 13 != 0, F.col("x"))
    widgets = rows.select("doc_id", key.alias("field"), F.when(k % 7 != 0, F.col("page")).alias("page"), (F.col("x") + F.col("w")).alias("x0"), (F.col("y") - 3).alias("y0"), left.alias("x1"), (F.col("y") + 11).alias("y1"))
    pages = page_rows(spark, sf_dir).select("doc_id", "page", F.lit(10.0).alias("bx"), F.lit(20.0).alias("by"))
    return annots.fields_on_pages(fields, widgets, pages)
