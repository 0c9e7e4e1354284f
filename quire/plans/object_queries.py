"""Registered queries over object tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annots, export, forms, leaks, objects, pages, redact, text
from ..sources import fixtures
from ..sources import object_fixtures as made
from ..sources import text_documents as src
from .queries import LINES, N_SQL, PAGES, docs, page_rows, query

RECT_SHAPES = [(1, 40.0, 700.0, 2000.0, 60.0), (2, 40.0, 500.0, 90.0, 33.0)]
BOXES_SQL = f"""{LINES}, boxes AS (SELECT doc_id, page, line_no, CASE WHEN line_no % 13 <> 0 THEN x END AS x0, y - 3 AS y0, x + w AS x1, y + 11 AS y1, text FROM lines),
rects(page, rx, ry, rw, rh) AS (VALUES {", ".join(f"({p}, {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for p, x, y, w, h in RECT_SHAPES)})"""
HIT_SQL = "coalesce(least(x0, x1) < rx + rw AND greatest(x0, x1) > rx AND y0 < ry + rh AND y1 > ry, true)"


def _rects(spark, sf_dir):
    return made.rects(page_rows(spark, sf_dir), RECT_SHAPES)


@query(f"WITH {BOXES_SQL} SELECT doc_id, page, line_no FROM boxes b WHERE EXISTS (SELECT 1 FROM rects r WHERE r.page = b.page AND CASE WHEN x0 IS NULL THEN true ELSE {HIT_SQL} END)")
def spans_under_rects(spark, sf_dir):
    """Paint spans under rectangles; one without a place counts as hit on pages with rectangles."""
    return objects.under(made.boxes(src.lines(docs(spark, sf_dir))), _rects(spark, sf_dir)).select("doc_id", "page", "line_no")


IMAGE_RECTS = [(None, 60.0, 150.0, 100.0, 80.0), (3, 200.0, 300.0, 50.0, 50.0)]


@query(f"""WITH {PAGES}, r(p, rx, ry, rw, rh) AS (VALUES (NULL, 60.0::DOUBLE, 150.0::DOUBLE, 100.0::DOUBLE, 80.0::DOUBLE), (3, 200.0::DOUBLE, 300.0::DOUBLE, 50.0::DOUBLE, 50.0::DOUBLE)),
q AS (SELECT doc_id, page, 50.0::DOUBLE + page % 5 AS x, rx, ry, rw, rh FROM pages JOIN r ON p IS NULL OR p = page),
u AS (SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN (rx - x) / 400 ELSE (ry - 100) / 500 END AS u0, CASE WHEN page % 2 = 1 THEN (rx + rw - x) / 400 ELSE (ry + rh - 100) / 500 END AS u1,
  CASE WHEN page % 2 = 1 THEN (ry - 100) / 500 ELSE (x + 400 - rx - rw) / 400 END AS v0, CASE WHEN page % 2 = 1 THEN (ry + rh - 100) / 500 ELSE (x + 400 - rx) / 400 END AS v1 FROM q)
SELECT doc_id, page, 1 AS image, CAST(min(floor(round(greatest(0, u0) * 200, 6))) AS BIGINT) AS px0, CAST(min(floor(round((1 - least(1, v1)) * 100, 6))) AS BIGINT) AS py0,
  CAST(max(ceil(round(least(1, u1) * 200, 6))) AS BIGINT) AS px1, CAST(max(ceil(round((1 - greatest(0, v0)) * 100, 6))) AS BIGINT) AS py1 FROM u GROUP BY doc_id, page""")
def image_pixels(spark, sf_dir):
    """Rectangles through the inverse of an image's matrix."""
    rows = page_rows(spark, sf_dir)
    return objects.image_pixels(made.images(rows), made.rects(rows, IMAGE_RECTS))


@query(f"""WITH RECURSIVE {BOXES_SQL}, f AS (SELECT doc_id, page * 25 + line_no - 25 AS field, text, CASE WHEN page * 25 + line_no - 26 - length(text) % 3 > 0 THEN page * 25 + line_no - 26 - length(text) % 3 END AS parent FROM lines),
up AS (SELECT doc_id, page * 25 + line_no - 25 AS field FROM boxes b WHERE EXISTS (SELECT 1 FROM rects r WHERE r.page = b.page AND CASE WHEN x0 IS NULL THEN true ELSE {HIT_SQL} END)
  UNION SELECT f.doc_id, f.parent FROM up JOIN f ON f.doc_id = up.doc_id AND f.field = up.field WHERE f.parent IS NOT NULL)
SELECT f.doc_id, f.field, parent, CASE WHEN up.field IS NULL THEN text END AS value, CASE WHEN up.field IS NULL THEN 'default ' || text END AS default_value, up.field IS NOT NULL AS cleared
FROM f LEFT JOIN up ON f.doc_id = up.doc_id AND f.field = up.field""")
def clear_fields(spark, sf_dir):
    """A hit widget's field and all fields above it, a page's worth and more, lose their values."""
    fields, widgets = made.form_tree(docs(spark, sf_dir).where("text IS NOT NULL"))
    return objects.clear_fields(widgets, fields, _rects(spark, sf_dir))


@query(f"""WITH {BOXES_SQL}, e AS (SELECT doc_id, page, page * 100 + line_no AS elem, CASE WHEN doc_id % 11 = 0 AND line_no = 3 THEN NULL ELSE 50.0::DOUBLE END AS x0, x1, y0, y1, CASE WHEN line_no % 3 = 0 THEN text END AS alt FROM boxes)
SELECT doc_id, elem, CASE WHEN EXISTS (SELECT 1 FROM rects r WHERE r.page = e.page AND CASE WHEN x0 IS NULL THEN true ELSE {HIT_SQL} END) THEN NULL ELSE alt END AS alt,
  NOT bool_or(alt IS NOT NULL AND x0 IS NULL) OVER (PARTITION BY doc_id) AS ok FROM e""")
def clear_structure(spark, sf_dir):
    """Alternative texts under rectangles go; one without a place fails its document."""
    return objects.clear_structure(made.structure(src.lines(docs(spark, sf_dir))), _rects(spark, sf_dir))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, page, line_no AS section, line_no * 100 AS a, line_no * 100 + 60 AS b, CASE WHEN length(text) % 5 = 0 THEN 'secret ' || text END AS secret FROM lines),
p AS (SELECT doc_id, page, line_no * 100 + 10 AS a, line_no * 100 + 110 AS b, contains(text, 'e') AS removed FROM lines),
o AS (SELECT s.*, secret IS NULL OR NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = s.doc_id AND p.page = s.page AND p.a < s.b AND p.b > s.a AND NOT removed) AS ok FROM s)
SELECT doc_id, page, section, CASE WHEN NOT ok THEN secret END AS secret, ok FROM o""")
def clear_sections(spark, sf_dir):
    """Intervals of marked sections against those of what was removed."""
    return objects.clear_sections(*made.sections(src.lines(docs(spark, sf_dir))))


# Walks over a page's forms by their number of steps; with 25 forms, one of 25 steps comes back to a form.
FORMS_SQL = """fl AS (SELECT doc_id, page, line_no AS k, text, max(line_no) OVER (PARTITION BY doc_id, page) AS n FROM lines),
fe AS (SELECT doc_id, page, k AS parent, k + 1 AS child FROM fl WHERE k < n AND k % 7 <> 0 AND text <> '' UNION ALL SELECT doc_id, page, k, k + 2 FROM fl WHERE k + 2 <= n AND contains(text, 'z')
  UNION ALL SELECT doc_id, page, k, k - 2 FROM fl WHERE contains(text, 'Z') AND k > 2),
fw AS (SELECT doc_id, page, k AS node, 0 AS steps FROM fl WHERE k % 7 = 1 UNION SELECT fe.doc_id, fe.page, child, steps + 1 FROM fw JOIN fe ON fe.doc_id = fw.doc_id AND fe.page = fw.page AND fe.parent = fw.node WHERE steps < 25),
nested AS (SELECT fw.doc_id, fw.page, count(DISTINCT node) AS forms, CASE WHEN max(steps) < 25 THEN CAST(max(steps) AS BIGINT) END AS deepest, count(DISTINCT node) FILTER (regexp_matches(text, '[0-9]')) AS images_within,
  max(steps) <= 8 AND NOT bool_or(regexp_matches(text, '[0-9]')) AS ok FROM fw JOIN fl ON fl.doc_id = fw.doc_id AND fl.page = fw.page AND fl.k = fw.node GROUP BY fw.doc_id, fw.page)"""


@query(f"WITH RECURSIVE {LINES}, {FORMS_SQL} SELECT * FROM nested")
def nested_forms(spark, sf_dir):
    """Forms within forms, shared ones, cycles, depth, images within."""
    return objects.nested_forms(made.form_uses(docs(spark, sf_dir)))


SECTIONS_SQL = """s AS (SELECT doc_id, page, line_no AS section, line_no * 100 AS a, line_no * 100 + 60 AS b, CASE WHEN length(text) % 5 = 0 THEN 'secret ' || text END AS secret FROM lines),
p AS (SELECT doc_id, page, line_no * 100 + 10 AS a, line_no * 100 + 110 AS b, contains(text, 'e') AS removed FROM lines),
o AS (SELECT s.*, secret IS NULL OR NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = s.doc_id AND p.page = s.page AND p.a < s.b AND p.b > s.a AND NOT removed) AS ok FROM s)"""


@query(f"""WITH RECURSIVE {BOXES_SQL}, {FORMS_SQL}, {SECTIONS_SQL}, sp AS (SELECT doc_id, page, count(*) AS spans FROM boxes b WHERE EXISTS (SELECT 1 FROM rects r WHERE r.page = b.page AND CASE WHEN x0 IS NULL THEN true ELSE {HIT_SQL} END) GROUP BY doc_id, page),
l AS (SELECT doc_id, page, count(*) AS lines FROM lines WHERE contains(lower(text), 'license') GROUP BY doc_id, page),
g AS (SELECT doc_id, page, bool_and(ok) AS fine FROM (SELECT doc_id, page, ok FROM nested UNION ALL SELECT doc_id, page, ok FROM o) GROUP BY doc_id, page)
SELECT doc_id, page, coalesce(lines, 0) AS lines, coalesce(spans, 0) AS spans, fine AS ok FROM l FULL JOIN sp USING (doc_id, page) JOIN g USING (doc_id, page)""")
def vector_plans(spark, sf_dir):
    """RW9: covered lines, paint spans, marked sections and nested forms put together."""
    rows = src.lines(docs(spark, sf_dir))
    covered = redact.find_rects(rows, "license")
    spans = objects.under(made.boxes(rows), _rects(spark, sf_dir))
    return objects.vector_plan(covered, spans, objects.clear_sections(*made.sections(rows)), objects.nested_forms(made.form_uses(docs(spark, sf_dir))))


# Uses of shared forms: only shifts, so a use is placed by its sum of them.
CLONES_SQL = f"""{{LINES}}, t AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, t, least(len(t), 12) AS n, CAST(ceil(len(t) / 25.0) AS BIGINT) AS pages FROM t),
fm AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS k, unnest(t[1:n]) AS text FROM d),
inner_use AS (SELECT doc_id, 'f' || k AS parent, 'next' AS name, 'f' || (k + 1) AS child, 20.0::DOUBLE AS dy FROM fm WHERE k + 1 <= n AND text <> '' AND k % 4 <> 0
  UNION ALL SELECT doc_id, 'f' || k, 'over', 'f' || (k + 2), 40.0::DOUBLE FROM fm WHERE k + 2 <= n AND contains(text, 'e')),
pg AS (SELECT doc_id, n, unnest(range(1, pages + 1)) AS page FROM d),
page_use AS (SELECT doc_id, page, 'top' AS name, 'f1' AS child, 680.0::DOUBLE AS dy FROM pg UNION ALL SELECT doc_id, page, 'low', 'f' || (page % 5 + 1), 480.0::DOUBLE + page FROM pg WHERE page % 5 + 1 <= n),
rc(page, rx, ry, rw, rh) AS (VALUES {", ".join(f"({p}, {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for p, x, y, w, h in RECT_SHAPES)}),
w AS (SELECT doc_id, page, name AS path, child AS form, dy, 0 AS depth FROM page_use WHERE page IN (SELECT page FROM rc)
  UNION ALL SELECT w.doc_id, w.page, w.path || '/' || i.name, i.child, w.dy + i.dy, depth + 1 FROM w JOIN inner_use i ON i.doc_id = w.doc_id AND i.parent = w.form WHERE depth <= 8),
bad AS (SELECT DISTINCT doc_id, page FROM w WHERE depth > 8),
u AS (SELECT w.*, fm.text, 50.0::DOUBLE AS x, w.dy + 10 AS y, 7.0::DOUBLE * length(fm.text) AS wd FROM w JOIN fm ON fm.doc_id = w.doc_id AND 'f' || fm.k = w.form ANTI JOIN bad ON bad.doc_id = w.doc_id AND bad.page = w.page),
m AS (SELECT *, EXISTS (SELECT 1 FROM rc WHERE rc.page = u.page AND x < rx + rw AND x + wd > rx AND y - 3.5 < ry + rh AND y + 11.9 > ry AND x >= rx - 0.5 AND x + wd <= rx + rw + 0.5 AND y - 3.5 >= ry - 0.5 AND y + 11.9 <= ry + rh + 0.5) AS gone FROM u),
c AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM m z WHERE z.gone AND z.doc_id = m.doc_id AND z.page = m.page AND (z.path = m.path OR starts_with(z.path, m.path || '/'))))"""


def _clones(spark, sf_dir):
    rows = docs(spark, sf_dir).where("text IS NOT NULL")
    return forms.clone_on_write(*made.shared_forms(rows), _rects(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLONES_SQL.replace("{LINES}", LINES)},
e AS (SELECT c.doc_id, c.page, 'p' || c.page || ':' || c.path AS parent, i.name, c.path || '/' || i.name AS path, i.child FROM c JOIN inner_use i ON i.doc_id = c.doc_id AND i.parent = c.form
  UNION ALL SELECT doc_id, page, NULL, name, name, child FROM page_use)
SELECT e.doc_id, e.page, e.parent, e.name, CASE WHEN c.path IS NULL THEN e.child ELSE 'p' || c.page || ':' || c.path END AS target FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.page = e.page AND c.path = e.path
UNION ALL SELECT doc_id, NULL, parent, name, child FROM inner_use""")
def clone_edges(spark, sf_dir):
    """RW10: uses of forms after a redaction of two pages; copies are used only where something was covered."""
    return _clones(spark, sf_dir).edges


@query(f"WITH RECURSIVE {CLONES_SQL.replace('{LINES}', LINES)} SELECT doc_id, 'p' || page || ':' || path AS form, 1 AS seq, text FROM c WHERE NOT gone")
def clone_segments(spark, sf_dir):
    """RW10: what is left of the copied forms' texts."""
    return _clones(spark, sf_dir).segments


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN (60 + doc_id % 7) * 20 ELSE 0 END AS box, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN 90 ELSE 0 END AS light FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, round((255 * (96 * 48 - 43 - box) + 10 * (box - light) + 250 * light)::DOUBLE / (96 * 48), 6) AS v FROM n)
SELECT doc_id, CAST(1 AS BIGINT) AS page, false AS blank, v AS r, v AS g, v AS b FROM m""")
def canvas_colours(spark, sf_dir):
    """PRD7 and AGG14."""
    out = leaks.canvases(fixtures.rasters(docs(spark, sf_dir)))
    return out.select("doc_id", "page", "blank", *(F.round(c, 6).alias(c) for c in "rgb"))


OBJECTS_SQL = """l AS (SELECT doc_id, unnest(range(len(t))) AS node, unnest(t) AS text, len(t) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)),
e AS (SELECT doc_id, node AS parent, node + 1 AS child FROM l WHERE length(text) % 8 <> 0 AND node + 1 < n UNION ALL SELECT doc_id, node, length(text) % n FROM l WHERE contains(text, 'the')),
r AS (SELECT doc_id, node FROM l WHERE {} UNION SELECT e.doc_id, e.child FROM r JOIN e ON e.doc_id = r.doc_id AND e.parent = r.node)"""


@query(f"WITH RECURSIVE {OBJECTS_SQL.format("contains(text, 'q')")} SELECT doc_id, node, text FROM l ANTI JOIN r ON r.doc_id = l.doc_id AND r.node = l.node")
def purge_objects(spark, sf_dir):
    """What lines with a q refer to goes with them."""
    rows, refs = made.objects(docs(spark, sf_dir).where("text IS NOT NULL"))
    return objects.purge(rows, refs, rows.where(F.contains("text", F.lit("q"))))


@query(f"WITH RECURSIVE {OBJECTS_SQL.format('node = 0')} SELECT doc_id, node, text FROM l SEMI JOIN r ON r.doc_id = l.doc_id AND r.node = l.node")
def rebuild_clean(spark, sf_dir):
    """RW15: only what the first object leads to is written anew."""
    rows, refs = made.objects(docs(spark, sf_dir).where("text IS NOT NULL"))
    return objects.rebuilt(rows, refs, rows.where("node = 0"))


@query(f"WITH {LINES} SELECT doc_id, page, line_no, CASE length(text) % 3 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'Times' END AS base_font, length(text) % 3 = 2 AS undecodable FROM lines")
def segment_fonts(spark, sf_dir):
    """Fonts by name, with or without a slash; a miss is text that cannot be decoded."""
    name = F.concat(F.when(F.col("line_no") % 2 == 0, "/F").otherwise("F"), (F.length("text") % 3).cast("string"))
    fonts = page_rows(spark, sf_dir).select("doc_id", "page", F.inline(F.array(F.struct(F.lit("F0").alias("name"), F.lit("Helvetica").alias("base_font")), F.struct(F.lit("/F1").alias("name"), F.lit("Times").alias("base_font")))))
    return objects.fonts_of(src.lines(docs(spark, sf_dir)).select("doc_id", "page", "line_no", name.alias("font")), fonts).drop("font")


@query(f"WITH {LINES} SELECT doc_id, page, line_no, CASE length(text) % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'direct' ELSE 'ignored' END AS outcome FROM lines")
def use_targets(spark, sf_dir):
    """Three outcomes of a name."""
    uses = src.lines(docs(spark, sf_dir)).select("doc_id", "page", "line_no", F.concat(F.lit("X"), (F.length("text") % 3).cast("string")).alias("name"))
    resources = page_rows(spark, sf_dir).select("doc_id", "page", F.inline(F.array(F.struct(F.lit("X0").alias("name"), F.lit("5 0 R").alias("ref")), F.struct(F.lit("X1").alias("name"), F.lit(None).cast("string").alias("ref")))))
    return objects.targets(uses, resources).select("doc_id", "page", "line_no", "outcome")


@query(f"""WITH {LINES}, n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) AS a FROM lines),
h AS (SELECT doc_id, page, line_no AS hit, lower(trim(regexp_replace(CASE line_no % 3 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN text || ' zzz' ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END, '\\s+', ' ', 'g'), ' ')) AS b, x + 3 AS hx, y + 4 AS hy FROM lines WHERE line_no % 5 = 0),
s AS (SELECT n.doc_id, n.page, hit, n.line_no, CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN 0.7::DOUBLE
  ELSE 0.4::DOUBLE * (len(list_filter(string_split(b, ' '), lambda t: list_contains(string_split(a, ' '), t)))::DOUBLE / greatest(1, least(len(string_split(a, ' ')), len(string_split(b, ' '))))) END * 2
  + greatest(0.0::DOUBLE, 1 - sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) / 60) AS score FROM n JOIN h ON n.doc_id = h.doc_id AND n.page = h.page WHERE a <> '' AND b <> '')
SELECT doc_id, page, hit, line_no, round(score, 6) AS score FROM s WHERE score >= 1.2::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id, page, hit ORDER BY round(score, 9) DESC, line_no) = 1""")
def best_lines(spark, sf_dir):
    """J18, AGG17 and LIM6: the line that a hit is most like."""
    rows = src.lines(docs(spark, sf_dir))
    changed = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).when(F.col("line_no") % 3 == 1, F.concat("text", F.lit(" zzz"))).otherwise(F.array_join(F.reverse(F.split("text", " ")), " "))
    hits = rows.where("line_no % 5 = 0").select("doc_id", "page", F.col("line_no").alias("hit"), changed.alias("htext"), (F.col("x") + 3).alias("hx"), (F.col("y") + 4).alias("hy"))
    return objects.best_lines(hits, rows).withColumn("score", F.round("score", 6))


@query(f"WITH {PAGES} SELECT doc_id, page, contains(text, 'z') AS has_images, true AS has_forms, contains(text, 'q') AS has_patterns, contains(text, 'x') AS has_inline_images FROM pages")
def page_features(spark, sf_dir):
    """PRD8: what a page's content uses, here told by letters in its text."""
    has = lambda c, kind: F.when(F.contains("text", F.lit(c)), kind)
    kinds = F.array_compact(F.array(F.lit("form"), has("z", "image"), has("q", "pattern"), has("x", "inline")))
    return objects.features(src.page_texts(docs(spark, sf_dir)).select("doc_id", "page", F.explode(kinds).alias("kind")))


EXPORT_SQL = f"""{LINES}, a AS (
  SELECT doc_id, page, line_no, 'redact' AS type, x, round(y - 4.2::DOUBLE, 6) AS y, w, 16.8::DOUBLE AS h FROM lines WHERE contains(lower(text), 'license')
  UNION ALL SELECT doc_id, page, line_no, 'redact', x, round(y - 4.2::DOUBLE, 6), w / 2, 16.8::DOUBLE FROM lines WHERE line_no % 5 = 0 AND contains(text, 'z') AND length(text) > 4
  UNION ALL SELECT doc_id, page, line_no, 'text', x, y, 70, 14 FROM lines WHERE line_no % 6 = 1 UNION ALL SELECT doc_id, page, line_no, 'formfield', x, y, 90, 14 FROM lines WHERE line_no % 9 = 2
  UNION ALL SELECT doc_id, page, line_no, 'edit', x, y, w, 14 FROM lines WHERE line_no % 4 = 0 AND contains(text, 'the')),
rc AS (SELECT doc_id, page, x AS rx, y AS ry, w AS rw, h AS rh FROM a WHERE type = 'redact'),
m AS (SELECT l.doc_id, l.page, l.line_no, l.text, max(CASE WHEN rx IS NULL THEN 0 WHEN x >= rx - 0.5 AND x + w <= rx + rw + 0.5 AND y - 3.5 >= ry - 0.5 AND y + 11.9 <= ry + rh + 0.5 THEN 2 ELSE 1 END) AS cov
  FROM lines l LEFT JOIN rc ON rc.doc_id = l.doc_id AND rc.page = l.page AND x < rx + rw AND x + w > rx AND y - 3.5 < ry + rh AND y + 11.9 > ry GROUP BY ALL),
t AS (SELECT doc_id, page, coalesce(string_agg(CASE WHEN line_no % 4 = 0 AND contains(text, 'the') THEN 'EDITED' ELSE text END, chr(10) ORDER BY line_no) FILTER (cov < 2), '') AS text, count(*) FILTER (cov = 1) AS partial,
  bool_or(line_no = 3 AND length(text) % 13 = 0) AS bad_w, bool_or(line_no = 7 AND length(text) % 13 = 1) AS bad_a, bool_or(line_no % 3 = 0 AND length(text) % 29 = 0) AS bad_s FROM m GROUP BY doc_id, page),
g AS (SELECT doc_id, page, count(*) AS regions FROM rc GROUP BY doc_id, page),
d AS (SELECT * FROM a WHERE type = 'redact' OR NOT EXISTS (SELECT 1 FROM rc WHERE rc.doc_id = a.doc_id AND rc.page = a.page AND a.x < rx + rw AND a.x + a.w > rx AND a.y < ry + rh AND a.y + a.h > ry)),
c AS (SELECT doc_id, page, count(*) FILTER (type <> 'formfield') AS "all", count(*) FILTER (type NOT IN ('formfield', 'edit')) AS rest, count(*) FILTER (type = 'formfield') AS widgets FROM d GROUP BY doc_id, page),
q AS (SELECT t.*, coalesce(regions, 0) AS regions, coalesce("all", 0) AS "all", coalesce(rest, 0) AS rest, coalesce(widgets, 0) AS widgets, t.page % 9 <> 0 AS own FROM t LEFT JOIN g USING (doc_id, page) LEFT JOIN c USING (doc_id, page) WHERE t.page <= 6 OR t.page % 9 = 0),
f AS (SELECT *, CASE WHEN own AND regions > 0 THEN CASE WHEN bad_w THEN 'widgets' WHEN bad_a THEN 'annotations' WHEN bad_s THEN 'structure' WHEN partial > 0 THEN 'vectors' END END AS failed FROM q),
r AS (SELECT *, CASE WHEN NOT own THEN 'blank' WHEN failed IS NOT NULL THEN CASE WHEN page % 2 = 1 THEN 'raster' ELSE 'refused' END WHEN page % 5 = 0 AND page % 4 <> 0 THEN 'mirror' WHEN regions > 0 THEN 'vector' ELSE 'copy' END AS route FROM f)"""


@query(f"""WITH {EXPORT_SQL} SELECT doc_id, page, route, CASE WHEN NOT own THEN '' WHEN regions = 0 THEN 'edits' WHEN failed = 'widgets' THEN '' WHEN failed = 'annotations' THEN 'widgets' WHEN failed = 'structure' THEN 'widgets,annotations'
  WHEN failed = 'vectors' THEN 'widgets,annotations,structure' ELSE 'widgets,annotations,structure,vectors,edits' END AS passes, failed, regions,
  CAST(CASE WHEN route IN ('copy', 'mirror', 'vector') THEN (CASE WHEN page % 2 = 0 THEN 90 ELSE 0 END + (page - 1) * 90) % 360 ELSE 0 END AS INTEGER) AS rotation,
  CASE WHEN route IN ('copy', 'mirror', 'vector') THEN text END AS text, CASE WHEN route IN ('copy', 'mirror', 'vector') THEN rest ELSE "all" END AS drawn, widgets FROM r""")
def export_pages(spark, sf_dir):
    """RW22, RW23, RW24 and J2: five passes over the rows of each page; the first that fails sends it to be drawn."""
    return export.export_plan(**made.edited_pages(docs(spark, sf_dir)))


@query(f"WITH {EXPORT_SQL} SELECT doc_id, min(page) AS page, 'page ' || min(page) || ' could not be securely redacted' AS reason FROM r WHERE route = 'refused' GROUP BY doc_id")
def export_refusals(spark, sf_dir):
    """RW22: a page with neither way refuses its document."""
    return export.export_refusals(export.export_plan(**made.edited_pages(docs(spark, sf_dir))))


@query(f"WITH {PAGES} SELECT doc_id, page, 'file ' || page AS name FROM pages WHERE page <= 3")
def pages_of_sources(spark, sf_dir):
    """Pages of sources that are not there are skipped."""
    rows = page_rows(spark, sf_dir)
    sources = rows.where("page <= 3").select("doc_id", F.col("page").alias("src"), F.concat(F.lit("file "), F.col("page").cast("string")).alias("name"))
    return pages.of_sources(rows.withColumn("src", F.col("page")), sources).select("doc_id", "page", "name")


@query(f"WITH {PAGES} SELECT doc_id, 'no pages selected' AS error FROM counts WHERE n < 2")
def empty_selections(spark, sf_dir):
    """PRJ3, SET2 and SET4: a selection without a page is an error of its document."""
    return pages.selection_errors(page_rows(spark, sf_dir), "2-3")


@query(f"WITH {PAGES} SELECT doc_id, 'cannot delete every page' AS error FROM counts WHERE n <= 3")
def delete_everything(spark, sf_dir):
    """SET4: what would delete all pages is an error of its document."""
    return pages.selection_errors(page_rows(spark, sf_dir), "1-3", deleting=True)


@query(f"WITH {PAGES} SELECT doc_id, page, 'doc-' || doc_id || '-p' || lpad(page::VARCHAR, CAST(greatest(3, length(page::VARCHAR)) AS INTEGER), '0') || '.pdf' AS file, 1::BIGINT AS pos FROM pages")
def one_file_per_page(spark, sf_dir):
    """SET8."""
    return pages.one_per_file(page_rows(spark, sf_dir), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).select("doc_id", "page", "file", "pos")


@query(f"WITH {LINES} SELECT doc_id, page, line_no FROM lines WHERE contains(lower(text), 'the') ORDER BY doc_id, page, line_no LIMIT 501")
def search_global_cap(spark, sf_dir):
    """LIM2: the first 501 hits of all."""
    return text.first_of_all(text.search_lines(docs(spark, sf_dir), "the")).select("doc_id", "page", "line_no")


@query(f"WITH {LINES} SELECT doc_id, page, string_agg(array_to_string(list_filter(string_split(text, ' '), lambda t: t <> ''), ' '), ' ' ORDER BY line_no) FILTER (replace(text, ' ', '') <> '') AS text FROM lines GROUP BY doc_id, page")
def page_plain_text(spark, sf_dir):
    """SRC13: a page's items joined by blanks."""
    return text.plain(src.page_words(docs(spark, sf_dir)))


@query(f"""SELECT doc_id, 'pages: ' || {N_SQL} || chr(10) || 'size: 600 x 800' || CASE WHEN string_split(text, chr(10))[1] <> '' THEN chr(10) || 'title: ' || string_split(text, chr(10))[1] ELSE '' END AS info FROM documents WHERE text IS NOT NULL""")
def info_text(spark, sf_dir):
    """PRJ2."""
    return text.info_text(text.info(docs(spark, sf_dir)))


@query(f"""SELECT doc_id, CAST(json_object('page_count', {N_SQL}, 'n_lines', CAST(len(string_split(text, chr(10))) AS BIGINT), 'width', 600.0::DOUBLE, 'height', 800.0::DOUBLE) AS VARCHAR) AS json FROM documents WHERE text IS NOT NULL""")
def info_json(spark, sf_dir):
    """SNK4 and FN8: one JSON object a row."""
    return text.as_json(text.info(docs(spark, sf_dir)).drop("title"))


@query("""SELECT doc_id, CAST(json_object('boxes', CAST(doc_id % 4 <> 0 AS BIGINT), 'leaked', CAST(doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS BIGINT), 'pages_with_leaks', CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN '1' ELSE '' END,
  'verdict', CASE WHEN doc_id % 4 = 0 THEN 'no-boxes' WHEN doc_id % 3 <> 0 THEN 'leaks' ELSE 'clean' END) AS VARCHAR) AS json FROM documents WHERE text IS NOT NULL""")
def checker_json(spark, sf_dir):
    """SNK6."""
    rasters = fixtures.rasters(docs(spark, sf_dir))
    found = leaks.solid_boxes(rasters)
    return text.as_json(leaks.verdicts(rasters, found, leaks.leaks(fixtures.raster_runs(docs(spark, sf_dir)), found, rasters)))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, page, line_no, 40 + 7.0::DOUBLE * (line_no % 3) AS x0, 100.0::DOUBLE + line_no * 20 AS y0, w, line_no % 5 * 12.0::DOUBLE + 1 AS h, text FROM lines WHERE text <> ''),
c AS (SELECT doc_id, page, line_no, x0 / 2 AS x, greatest(0, 800 - (y0 + h) / 2) AS y, w / 2 AS cw, h / 2 AS ch, text FROM l),
d AS (SELECT *, least(600 - x, cw) AS bw, least(800 - y, ch) AS bh FROM c)
SELECT doc_id, page, line_no, 'edit' AS type, text, round(x, 6) AS x, round(y, 6) AS y, round(bw, 6) AS w, round(bh, 6) AS h, round(greatest(5, least(40, bh * 0.85::DOUBLE)), 6) AS size FROM d WHERE bw >= 3 AND bh >= 3""")
def ocr_annotations(spark, sf_dir):
    """RW28 and FN18: recognised lines, in pixels at scale 2, as editable texts on their page."""
    rows = src.lines(docs(spark, sf_dir)).where("text <> ''")
    x0, y0 = 40 + F.lit(7.0) * (F.col("line_no") % 3), 100.0 + F.col("line_no") * 20
    lines = rows.select("doc_id", "page", "line_no", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("w")).alias("x1"), (y0 + F.col("line_no") % 5 * F.lit(12.0) + 1).alias("y1"))
    out = annots.from_ocr(lines, 600.0, 800.0, 2.0)
    return out.select("doc_id", "page", "line_no", "type", "text", *(F.round(c, 6).alias(c) for c in ("x", "y", "w", "h", "size")))


@query(f"WITH {LINES}, o AS (SELECT doc_id, page, line_no, text, length(text) AS n FROM lines) SELECT doc_id, page, line_no, round((n - length(replace(text, 'e', ''))) * 0.556::DOUBLE * 14 + length(replace(text, 'e', '')) * 0.5::DOUBLE * 14, 6) AS advance FROM o")
def line_advances(spark, sf_dir):
    """AGG7 and FN25: widths by character from a map, 500 where it has none."""
    from ..functions import geometry as g

    widths = F.create_map(F.lit("e"), F.lit(556.0))
    return src.lines(docs(spark, sf_dir)).select("doc_id", "page", "line_no", F.round(g.advance(F.col("text"), widths, F.col("size")), 6).alias("advance"))


@query(f"""WITH {LINES} SELECT doc_id, page, line_no, round(greatest(0, least(600 - least(w, 300), x + line_no * 30)), 6) AS px, round(least(w, 300), 6) AS pw, round(CASE WHEN w = 0 THEN 0 ELSE least(w, 300) * 14 / w END, 6) AS ph FROM lines""")
def placements(spark, sf_dir):
    """FN22: at most half a page wide, in its own proportions, within the page."""
    from ..functions import geometry as g

    rows = src.lines(docs(spark, sf_dir))
    x, w, h = g.placed(F.col("x") + F.col("line_no") * 30, F.col("w"), F.lit(14.0), F.lit(600.0), F.lit(300.0))
    return rows.select("doc_id", "page", "line_no", F.round(x, 6).alias("px"), F.round(w, 6).alias("pw"), F.round(h, 6).alias("ph"))
