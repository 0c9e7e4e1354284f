"""Registered queries over the document operators, and the DuckDB SQL that must give the same rows.

The canonical input is the text-document adapter: documents are cut into lines and pages of 25 lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.ranges import order_list, parse_ranges
from ..functions.strings import WORDS, collapse, keywords
from ..operators import annots, diff, edit, grouping, leaks, model, pages, publish, redact, text
from ..operators.joins import shared_folder
from ..sources import fixtures
from ..sources import text_documents as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, w, h, rot) of every page; rot repeats 0, 90, 180, 270."""
    rows = src.page_texts(docs(spark, sf_dir)).select("doc_id", "page")
    return rows.select("*", F.lit(src.PAGE_W).alias("w"), F.lit(src.PAGE_H).alias("h"), ((F.col("page") - 1) * 90 % 360).cast("int").alias("rot"))


# Common table expressions of the oracle.
LINES = """lines AS (
  SELECT doc_id, pos // 25 + 1 AS page, pos % 25 + 1 AS line_no, text, 50.0::DOUBLE AS x, 750.0::DOUBLE - 20.0 * (pos % 25) AS y, 7.0::DOUBLE * length(text) AS w, 14.0::DOUBLE AS size
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""
PAGES = LINES + """, pages AS (
  SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS text, 600.0::DOUBLE AS w, 800.0::DOUBLE AS h, CAST((page - 1) * 90 % 360 AS INTEGER) AS rot FROM lines GROUP BY doc_id, page),
counts AS (SELECT doc_id, max(page) AS n FROM pages GROUP BY doc_id)"""
SNIPPET = "CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '...' ELSE text END AS snippet"


# ---- extraction and search -----------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, page, line_no, {SNIPPET} FROM lines WHERE contains(lower(text), 'the')")
def search_ci(spark, sf_dir):
    """SCH1, case-folded."""
    return text.search_lines(docs(spark, sf_dir), "the")


@query(f"WITH {LINES} SELECT doc_id, page, line_no, {SNIPPET} FROM lines WHERE contains(text, 'The')")
def search_cs(spark, sf_dir):
    """SCH1, case-sensitive."""
    return text.search_lines(docs(spark, sf_dir), "The", case_sensitive=True)


@query(f"WITH {PAGES} SELECT doc_id, page, text FROM pages WHERE page IN (1, 3)")
def extract_text(spark, sf_dir):
    """PRJ3 with a page list that repeats."""
    return text.extract(docs(spark, sf_dir), [3, 1, 3])


@query("""SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 25.0) AS BIGINT) AS page_count, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
  nullif(string_split(text, chr(10))[1], '') AS title, 600.0::DOUBLE AS width, 800.0::DOUBLE AS height FROM documents WHERE text IS NOT NULL""")
def doc_info(spark, sf_dir):
    """PRJ1."""
    return text.info(docs(spark, sf_dir))


@query(f"WITH {PAGES} SELECT doc_id, string_agg('--- page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text FROM pages GROUP BY doc_id")
def framed_text(spark, sf_dir):
    """PRJ4."""
    return text.framed(docs(spark, sf_dir), "--- page {} ---")


@query(f"WITH {PAGES} SELECT doc_id, substr(string_agg('[page ' || page || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY page), 1, 50000) AS text FROM pages GROUP BY doc_id")
def framed_text_capped(spark, sf_dir):
    """PRJ5."""
    return text.framed(docs(spark, sf_dir), "[page {}]", 50_000)


@query(f"WITH {PAGES} SELECT doc_id, substr(string_agg('[Page ' || page || ']' || chr(10) || CASE WHEN trim(text, ' ') = '' THEN '(blank)' ELSE text END, chr(10) || chr(10) ORDER BY page), 1, 24000) AS text FROM pages GROUP BY doc_id")
def reading_context(spark, sf_dir):
    """PRJ6."""
    return text.framed(docs(spark, sf_dir), "[Page {}]", 24_000, "(blank)")


HITS = f"{LINES}, hits AS (SELECT doc_id, page, line_no, {SNIPPET} FROM lines WHERE contains(lower(text), 'the'))"


@query(f"WITH {HITS} SELECT doc_id, page, line_no, snippet FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) <= 5")
def search_limit(spark, sf_dir):
    """LIM1."""
    return text.first_hits(text.search_lines(docs(spark, sf_dir), "the"), 5)


@query(f"""WITH {HITS}, n AS (SELECT doc_id, page, count(*) AS c FROM hits GROUP BY doc_id, page),
b AS (SELECT doc_id, page, coalesce(sum(c) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT doc_id, page, line_no, snippet FROM hits JOIN b USING (doc_id, page) WHERE before < 5""")
def search_limit_page_granular(spark, sf_dir):
    """LIM1 as the reference stops: after a page."""
    return text.first_hits_by_page(text.search_lines(docs(spark, sf_dir), "the"), 5)


@query(f"""WITH {LINES}, p AS (SELECT *, string_split(lower(text), 'th') AS parts FROM lines WHERE contains(lower(text), 'th')),
k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM p),
o AS (SELECT *, CAST(coalesce(list_sum(list_transform(parts[1:k], lambda s: length(s))), 0) + (k - 1) * 2 AS BIGINT) AS char_at FROM k)
SELECT doc_id, page, line_no, k AS occurrence, char_at, round(x + w * char_at / length(text), 6) AS x, y, round(w * 2 / length(text), 6) AS w,
  substr(text, greatest(char_at - 16, 0) + 1, char_at + 2 + 16 - greatest(char_at - 16, 0)) AS snippet FROM o""")
def search_occurrences(spark, sf_dir):
    """SCH2 and WIN16."""
    return text.search_occurrences(docs(spark, sf_dir), " tH ")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, page, line_no, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS occurrences FROM lines WHERE contains(lower(text), 'the'))
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, page, line_no) AS INTEGER) AS rank FROM c QUALIFY rank <= 3""")
def search_topk_per_doc(spark, sf_dir):
    return text.busiest_lines(docs(spark, sf_dir), "the", 3)


@query(f"""WITH {HITS}, r AS (SELECT doc_id, page, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM hits)
SELECT doc_id, page, line_no, (i + 1) % n AS following, (i - 1 + n) % n AS previous FROM r""")
def search_cycle(spark, sf_dir):
    """WIN14."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    hits = text.search_lines(docs(spark, sf_dir), "the").withColumn("i", (F.row_number().over(w.orderBy("page", "line_no")) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    return hits.select("doc_id", "page", "line_no", text.cycle(F.col("i"), 1, F.col("n")).alias("following"), text.cycle(F.col("i"), -1, F.col("n")).alias("previous"))


# ---- page selection and algebra ------------------------------------------------------------------------------------

SPEC_SQL = "CAST(doc_id % 3 + 1 AS VARCHAR) || '-' || CAST(doc_id % 7 + 1 AS VARCHAR) || ', ' || CAST(doc_id % 5 + 1 AS VARCHAR) || ',x,9-7'"
N_SQL = "CAST(ceil(len(string_split(text, chr(10))) / 25.0) AS BIGINT)"
PARTS_SQL = f"""s AS (SELECT doc_id, {SPEC_SQL} AS spec, {N_SQL} AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, spec, n, trim(unnest(string_split(spec, ',')), ' ') AS part, unnest(range(len(string_split(spec, ',')))) AS k FROM s),
e AS (SELECT *, TRY_CAST(regexp_extract(part, '^(\\d+)', 1) AS BIGINT) AS a, coalesce(TRY_CAST(regexp_extract(part, '^\\d+-(\\d+)$', 1) AS BIGINT), TRY_CAST(regexp_extract(part, '^(\\d+)', 1) AS BIGINT)) AS b FROM t WHERE regexp_matches(part, '^\\d+(-\\d+)?$')),
p AS (SELECT doc_id, k, a, b, unnest(range(greatest(least(a, b), 1), least(greatest(a, b), n) + 1)) AS page FROM e)"""


def _specs(spark, sf_dir):
    spec = F.concat((F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), (F.col("doc_id") % 7 + 1).cast("string"), F.lit(", "), (F.col("doc_id") % 5 + 1).cast("string"), F.lit(",x,9-7"))
    return text.info(docs(spark, sf_dir)).select("doc_id", spec.alias("spec"), F.col("page_count").alias("n"))


@query(f"WITH {PARTS_SQL}, u AS (SELECT DISTINCT doc_id, page FROM p) SELECT s.doc_id, s.spec, coalesce(string_agg((page - 1)::VARCHAR, ',' ORDER BY page), '') AS page_indexes FROM s LEFT JOIN u ON s.doc_id = u.doc_id GROUP BY s.doc_id, s.spec")
def parse_range_specs(spark, sf_dir):
    """SEL1."""
    return _specs(spark, sf_dir).select("doc_id", "spec", F.array_join(parse_ranges(F.col("spec"), F.col("n")), ",").alias("page_indexes"))


@query(f"""WITH {PARTS_SQL}, o AS (SELECT doc_id, page, min(k * 1000000 + CASE WHEN a <= b THEN page ELSE 999999 - page END) AS place FROM p GROUP BY doc_id, page)
SELECT s.doc_id, s.spec, coalesce(string_agg(page::VARCHAR, ',' ORDER BY place), '') AS listed FROM s LEFT JOIN o ON s.doc_id = o.doc_id GROUP BY s.doc_id, s.spec""")
def order_specs(spark, sf_dir):
    """SEL4."""
    return _specs(spark, sf_dir).select("doc_id", "spec", F.array_join(order_list(F.col("spec"), F.col("n")), ",").alias("listed"))


@query(f"""WITH {PAGES} SELECT doc_id // 4 AS merged_id, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id % 2, doc_id, page) AS pos, doc_id, page FROM pages""")
def merge_docs(spark, sf_dir):
    """SET1: even documents first, then odd ones, four documents to one."""
    rows = page_rows(spark, sf_dir)
    out = pages.merge([rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")], F.floor(F.col("doc_id") / 4))
    return out.select("merged_id", "pos", "doc_id", "page")


@query(f"""WITH {PAGES}, s(part_no, lo, hi, name) AS (VALUES (1, 1, 2, 'part-1-1-2.pdf'), (2, 2, 99999, 'part-2-2-99999.pdf'))
SELECT doc_id, CAST(part_no AS BIGINT) AS part_no, row_number() OVER (PARTITION BY doc_id, part_no ORDER BY page) AS out_page, page, name FROM pages JOIN s ON page BETWEEN lo AND hi""")
def split_docs(spark, sf_dir):
    """SET2 and SNK3."""
    out = pages.split(page_rows(spark, sf_dir), ["1-2", "2-99999"])
    name = F.concat(F.lit("part-"), F.col("part_no").cast("string"), F.lit("-"), F.regexp_replace("spec", r"[^\w-]", "_"), F.lit(".pdf"))
    return out.select("doc_id", "part_no", "out_page", "page", name.alias("name"))


@query(f"WITH {PAGES} SELECT doc_id, page, CAST(CASE WHEN page IN (1, 3) THEN (rot + 270) % 360 ELSE rot END AS INTEGER) AS rot FROM pages")
def rotate_docs(spark, sf_dir):
    """SET3 with a negative angle."""
    return pages.rotate(page_rows(spark, sf_dir), -90, "3,1").select("doc_id", "page", "rot")


@query(f"WITH {PAGES} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS pos FROM pages WHERE page <> 2")
def delete_pages(spark, sf_dir):
    """SET5."""
    return pages.delete(page_rows(spark, sf_dir), "2").select("doc_id", "page", "pos")


@query(f"""WITH {PAGES} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY CASE page WHEN 4 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 ELSE 9 END, page) AS pos FROM pages WHERE page <> 2""")
def arrange_pages(spark, sf_dir):
    """SET4: 2 is deleted, 4, 3 and 1 come first."""
    return pages.arrange(page_rows(spark, sf_dir), "2", "4-2,1,3").select("doc_id", "page", "pos")


@query(f"WITH {PAGES} SELECT doc_id, page, c AS copy, row_number() OVER (PARTITION BY doc_id ORDER BY page, c) AS pos FROM (SELECT doc_id, page, unnest(CASE WHEN page = 1 THEN [0, 1] ELSE [0] END) AS c FROM pages)")
def duplicate_page(spark, sf_dir):
    return pages.duplicate(page_rows(spark, sf_dir), 1).select("doc_id", "page", "copy", "pos")


@query(f"""WITH {PAGES}, a AS (SELECT doc_id, page, 0 AS k, page AS src_page, w, h FROM pages UNION ALL SELECT doc_id, least(1, n), 1, NULL, 595.0, 842.0 FROM counts)
SELECT doc_id, src_page, w, h, row_number() OVER (PARTITION BY doc_id ORDER BY page, k) AS pos FROM a""")
def insert_blank_page(spark, sf_dir):
    return pages.insert_blank(page_rows(spark, sf_dir), 1, 595.0, 842.0)


@query(f"WITH {PAGES} SELECT doc_id, page, rot FROM pages WHERE page BETWEEN 2 AND 3")
def export_page_range(spark, sf_dir):
    """SET7."""
    return pages.export_range(page_rows(spark, sf_dir), "3-2").select("doc_id", "page", "rot")


@query(f"WITH {PAGES} SELECT doc_id, page, rot <> 0 AS sideways, (360 - rot) % 360 AS rot FROM pages")
def upright_pages(spark, sf_dir):
    """PRD6 and J20."""
    rows = page_rows(spark, sf_dir).withColumn("intrinsic", F.col("rot")).withColumn("rot", F.lit(0))
    return pages.upright(rows).select("doc_id", "page", "sideways", F.col("rot").cast("int").alias("rot"))


@query(f"WITH {PAGES} SELECT doc_id, page, 'Page ' || (page + 4) || ' of ' || (n - 0) || ' - 2024-01-01 - doc ' || doc_id AS stamp FROM pages JOIN counts USING (doc_id) WHERE page > 1")
def page_stamps(spark, sf_dir):
    """WIN15 and token expansion."""
    rows = page_rows(spark, sf_dir).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return annots.stamps(rows, "Page {page} of {pages} - {date} - {title}", "2024-01-01", start=5, skip_first=True)


# ---- redaction, verification, editing ------------------------------------------------------------------------------

RECTS = [(1, 40.0, 700.0, 2000.0, 60.0), (2, 40.0, 500.0, 900.0, 33.0)]
RECT_SQL = "rects(page, rx, ry, rw, rh) AS (VALUES " + ", ".join(f"({p}, {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for p, x, y, w, h in RECTS) + ")"
COVER_SQL = f"""{LINES}, {RECT_SQL}, touch AS (
  SELECT l.*, rx IS NOT NULL AS t, coalesce(x >= rx - 0.5 AND x + l.w <= rx + rw + 0.5 AND y - 3.5 >= ry - 0.5 AND y + 11.9 <= ry + rh + 0.5, false) AS f
  FROM lines l LEFT JOIN rects r ON l.page = r.page AND x < rx + rw AND x + l.w > rx AND y - 3.5 < ry + rh AND y + 11.9 > ry),
marked AS (SELECT doc_id, page, line_no, text, CASE WHEN bool_or(f) THEN 'full' WHEN bool_or(t) THEN 'partial' ELSE 'none' END AS coverage FROM touch GROUP BY doc_id, page, line_no, text)"""


@query(f"WITH {LINES} SELECT doc_id, page, line_no, x AS rx, round(y - size * 0.3, 6) AS ry, w AS rw, round(size * 1.2, 6) AS rh FROM lines WHERE contains(lower(text), 'license')")
def find_text_rects(spark, sf_dir):
    """RW4."""
    return redact.find_rects(src.lines(docs(spark, sf_dir)), "license")


@query(f"WITH {COVER_SQL} SELECT doc_id, page, line_no, coverage FROM marked")
def coverage_class(spark, sf_dir):
    """PRD2 and J6."""
    return redact.coverage(src.lines(docs(spark, sf_dir)), RECTS).select("doc_id", "page", "line_no", "coverage")


@query(f"""WITH {LINES}, r AS (SELECT doc_id, page, x AS rx, y - size * 0.3 AS ry, w AS rw, size * 1.2 AS rh FROM lines WHERE contains(lower(text), 'license'))
SELECT l.doc_id, l.page, l.line_no, CASE max(CASE WHEN rx IS NULL THEN 0 WHEN x >= rx - 0.5 AND x + w <= rx + rw + 0.5 AND y - 3.5 >= ry - 0.5 AND y + 11.9 <= ry + rh + 0.5 THEN 2
    WHEN x < rx + rw AND x + w > rx AND y - 3.5 < ry + rh AND y + 11.9 > ry THEN 1 ELSE 0 END) WHEN 2 THEN 'full' WHEN 1 THEN 'partial' ELSE 'none' END AS coverage
FROM lines l LEFT JOIN r ON l.doc_id = r.doc_id AND l.page = r.page GROUP BY l.doc_id, l.page, l.line_no""")
def coverage_join(spark, sf_dir):
    """J6 against a table of rectangles, one per hit."""
    rows = src.lines(docs(spark, sf_dir))
    return redact.coverage_by(rows, redact.find_rects(rows, "license").drop("line_no"))


@query(f"WITH {LINES} SELECT doc_id, page, coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (NOT contains(lower(text), 'license')), '') AS text FROM lines GROUP BY doc_id, page")
def redact_find(spark, sf_dir):
    """RW5."""
    return redact.redacted_pages(redact.find_or_rects(src.lines(docs(spark, sf_dir)), "license", []))


@query(f"WITH {COVER_SQL} SELECT doc_id, page, coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (coverage <> 'full'), '') AS text FROM marked GROUP BY doc_id, page")
def redact_rect(spark, sf_dir):
    """RW6, partly covered lines left."""
    return redact.redacted_pages(redact.coverage(src.lines(docs(spark, sf_dir)), RECTS))


@query(f"""WITH {COVER_SQL}, c AS (SELECT doc_id, count(*) FILTER (coverage = 'full') AS covered_lines, count(*) FILTER (coverage = 'partial') AS partial_lines,
  coalesce(list_sort(list(DISTINCT page) FILTER (coverage <> 'none')), []) AS p FROM marked GROUP BY doc_id)
SELECT doc_id, covered_lines, partial_lines, coalesce(array_to_string(p, ','), '') AS pages, CASE WHEN partial_lines > 0 THEN 3 WHEN covered_lines = 0 THEN 2 ELSE 0 END AS exit_code,
  partial_lines = 0 AND covered_lines > 0 AS pass, CASE WHEN partial_lines > 0 THEN partial_lines || ' line(s) only partly covered' END AS refusal FROM c""")
def redact_report(spark, sf_dir):
    """RW7, AGG4 and AGG5: fails closed on partly covered lines."""
    return redact.covered_report(redact.coverage(src.lines(docs(spark, sf_dir)), RECTS))


@query("SELECT doc_id, text, 'lang,n_chars,source' AS scrubbed FROM documents")
def scrub_metadata(spark, sf_dir):
    """RW14."""
    return redact.scrub(docs(spark, sf_dir))


# Lines with a needle are taken out of their documents, but for every third document, whose output still has them.
GATE_SQL = f"""{LINES}, marked AS (SELECT doc_id, page, line_no, text, contains(lower(text), 'license') AS hit FROM lines),
covered AS (SELECT DISTINCT doc_id, trim(text, ' ') AS covered FROM marked WHERE hit AND trim(text, ' ') <> ''),
output AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY page, line_no) FILTER (NOT hit OR doc_id % 3 = 0), '') AS text FROM marked GROUP BY doc_id),
checks AS (SELECT doc_id, covered, contains(coalesce(text, ''), covered) AS found,
  contains(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' '), trim(regexp_replace(covered, '\\s+', ' ', 'g'), ' ')) AS seen FROM covered LEFT JOIN output USING (doc_id)),
verdicts AS (SELECT doc_id, count(*) AS strings, bool_or(found) AS b, bool_or(seen) AS e FROM checks GROUP BY doc_id)"""


def _gate(spark, sf_dir):
    marked = redact.find_or_rects(src.lines(docs(spark, sf_dir)), "license", [])
    faulty = marked.withColumn("coverage", F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.col("coverage")))
    lines = F.array_sort(F.collect_list(F.when(F.col("coverage") != "full", F.struct("page", "line_no", "text"))))
    output = faulty.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda s: s["text"]), "\n").alias("text"))
    return output, redact.verify(output, redact.covered_strings(marked)), marked


@query(f"""WITH {GATE_SQL} SELECT doc_id, covered, CASE WHEN length(covered) > 160 THEN substr(covered, 1, 160) || '…' ELSE covered END AS shown, found AS utf8, false AS utf16be, false AS utf16be_bom,
  false AS utf16le, false AS utf16le_bom, found AS present_in_bytes, seen AS present_in_extraction FROM checks""")
def verify_strings(spark, sf_dir):
    """RW16: byte forms and extraction of every covered string; UTF-16 forms cannot be in UTF-8 text without NUL."""
    return _gate(spark, sf_dir)[1]


@query(f"WITH {GATE_SQL} SELECT doc_id, strings, CASE WHEN b THEN 'fail' ELSE 'pass' END AS byte_scan, CASE WHEN e THEN 'fail' ELSE 'pass' END AS extraction, NOT b AND NOT e AS pass FROM verdicts")
def verify_documents(spark, sf_dir):
    return redact.verification(_gate(spark, sf_dir)[1])


@query(f"WITH {GATE_SQL} SELECT doc_id, text FROM output WHERE doc_id NOT IN (SELECT doc_id FROM verdicts WHERE b OR e)")
def redact_gate(spark, sf_dir):
    """RW18."""
    output, checks, marked = _gate(spark, sf_dir)
    return redact.gate(output, redact.verification(checks), redact.covered_report(marked))


@query(f"WITH {GATE_SQL} SELECT doc_id, text FROM output WHERE doc_id NOT IN (SELECT doc_id FROM verdicts WHERE b OR e)")
def redact_published(spark, sf_dir):
    """RW18, SNK2 and SNK5: the same through the writer, which reads what it has written before anyone else can."""
    output, _, marked = _gate(spark, sf_dir)
    target = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    publish.publish(output, redact.covered_strings(marked), redact.covered_report(marked), target, on_failure="leave out")
    return spark.read.parquet(target).select("doc_id", "text")


@query(f"""WITH {GATE_SQL}, r AS (SELECT DISTINCT doc_id, trim(regexp_replace(covered, '\\s+', ' ', 'g'), ' ') AS covered FROM covered)
SELECT doc_id, covered, contains(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), covered) AS recoverable FROM r JOIN output USING (doc_id)""")
def verify_recoverable(spark, sf_dir):
    """RW17: every byte form, hexadecimal digits and escapes; text documents hold a string as text or not at all."""
    output, _, marked = _gate(spark, sf_dir)
    return redact.recoverable(output, redact.covered_strings(marked))


# A document's first covered string, planted in one of six forms in front of what is left, and a short one in one of four.
PLANTED_SQL = f"""{LINES}, marked AS (SELECT doc_id, page, line_no, text, contains(lower(text), 'license') AS hit FROM lines),
covered AS (SELECT DISTINCT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS covered FROM marked WHERE hit),
output AS (SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY page, line_no) FILTER (NOT hit), '') AS text FROM marked GROUP BY doc_id),
planted AS (SELECT doc_id, min(covered) AS planted FROM covered GROUP BY doc_id)"""


@query(f"""WITH {PLANTED_SQL}, long AS (SELECT doc_id, covered, doc_id % 7 <> 0 AND contains(planted, covered) AND (doc_id % 7 <> 6 OR NOT regexp_matches(planted, '[^\\x00-\\xFF]')) AS recoverable FROM covered JOIN planted USING (doc_id)),
short AS (SELECT doc_id, 'k' || doc_id % 10 AS covered, doc_id % 5 IN (1, 3, 4) OR regexp_matches(text, '(^|[^\\pL\\pN_])k' || doc_id % 10 || '([^\\pL\\pN_]|$)') OR contains(text, '(k' || doc_id % 10 || ')') AS recoverable FROM output JOIN planted USING (doc_id))
SELECT * FROM long UNION ALL SELECT * FROM short""")
def verify_planted(spark, sf_dir):
    """RW17 and J17: strings planted as UTF-8, UTF-16 of either order, Latin-1, hexadecimal digits and escapes; short ones as words, within
    words, and as strings of the file."""
    lines = src.lines(docs(spark, sf_dir))
    marked = redact.find_or_rects(lines, "license", [])
    covered = redact.covered_strings(marked).select("doc_id", collapse(F.col("covered")).alias("covered"))
    return redact.recoverable(*fixtures.planted(redact.redacted_pages(marked), covered))


FEATURES_SQL = f"""{COVER_SQL}, k AS (SELECT doc_id, page, count(*) FILTER (coverage = 'full') AS covered_lines FROM marked GROUP BY doc_id, page),
f AS (SELECT *, (doc_id * 7 + page) % 19 AS f FROM k),
r AS (SELECT doc_id, page, f <> 1 AND f IN (2, 3, 4, 5, 6, 7, 8, 9, 10) AS unprovable, CASE WHEN f = 1 THEN '{redact.NO_CONTENT}' WHEN f = 2 THEN replace('{redact.REFUSALS["bad_fonts"]}', '{{}}', 'F1, F2') WHEN f = 3 THEN '{redact.REFUSALS["inline_images"]}'
  WHEN f = 4 THEN '{redact.REFUSALS["patterns"]}' WHEN f IN (5, 6) THEN '{redact.REFUSALS["unrecognized"]}' WHEN f = 7 THEN '{redact.REFUSALS["nested_images"]}' WHEN f = 8 THEN replace('{redact.REFUSALS["image_problem"]}', '{{}}', 'no decoder')
  WHEN f IN (9, 10) THEN '{redact.REFUSALS["form_problem"]}' WHEN covered_lines = 0 THEN '{redact.NO_COVERAGE}' END AS reason FROM f)"""


def _refusals(spark, sf_dir):
    marked = redact.coverage(src.lines(docs(spark, sf_dir)), RECTS)
    covered = marked.groupBy("doc_id", "page").agg(F.count_if(F.col("coverage") == "full").alias("covered_lines"))
    return marked, redact.page_refusals(fixtures.page_features(covered.select("doc_id", "page")), covered)


@query(f"WITH {FEATURES_SQL} SELECT doc_id, page, reason, unprovable FROM r WHERE reason IS NOT NULL")
def redact_refusals(spark, sf_dir):
    """RW7 and RW13: seven ordered stages per page; an unknown feature refuses."""
    return _refusals(spark, sf_dir)[1]


@query(f"""WITH {FEATURES_SQL}, c AS (SELECT doc_id, count(*) FILTER (coverage = 'full') AS covered_lines, count(*) FILTER (coverage = 'partial') AS partial_lines FROM marked GROUP BY doc_id),
b AS (SELECT doc_id, arg_min(reason, page) AS why FROM r WHERE unprovable GROUP BY doc_id)
SELECT doc_id, covered_lines, partial_lines, CASE WHEN why IS NOT NULL OR partial_lines > 0 THEN 3 WHEN covered_lines = 0 THEN 2 ELSE 0 END AS exit_code, why IS NULL AND partial_lines = 0 AND covered_lines > 0 AS pass,
  coalesce(why, CASE WHEN partial_lines > 0 THEN partial_lines || ' line(s) only partly covered' END) AS refusal FROM c LEFT JOIN b USING (doc_id)""")
def redact_report_refused(spark, sf_dir):
    """RW7: an unprovable page refuses its whole document."""
    marked, refusals = _refusals(spark, sf_dir)
    return redact.refused_report(redact.covered_report(marked), refusals).drop("pages")


EDIT_SQL = f"""{LINES}, m AS (SELECT doc_id, (page - 1) * 25 + line_no AS k, text, contains(lower(text), 'license') AS hit FROM lines),
f AS (SELECT doc_id, min(k) AS k0, count(*) AS n FROM m WHERE hit GROUP BY doc_id)"""


@query(f"WITH {EDIT_SQL} SELECT doc_id, string_agg(CASE WHEN k = k0 THEN regexp_replace(text, '(?i)license', 'permit $1', 'g') ELSE text END, chr(10) ORDER BY k) AS text, CAST(1 AS BIGINT) AS replaced, any_value(n) - 1 AS skipped FROM m JOIN f USING (doc_id) GROUP BY doc_id")
def edit_first(spark, sf_dir):
    """RW1: the first matching line of a document."""
    return edit.replacements(docs(spark, sf_dir), "license", "permit $1")


@query(f"WITH {EDIT_SQL} SELECT doc_id, string_agg(regexp_replace(text, '(?i)license', 'permit', 'g'), chr(10) ORDER BY k) AS text, any_value(n) AS replaced, CAST(0 AS BIGINT) AS skipped FROM m JOIN f USING (doc_id) GROUP BY doc_id")
def edit_all(spark, sf_dir):
    return edit.replacements(docs(spark, sf_dir), "license", "permit", every=True)


@query(f"WITH {EDIT_SQL} SELECT doc_id, string_agg(regexp_replace(text, '(?i)license', '', 'g'), chr(10) ORDER BY k) AS text, any_value(n) AS replaced, CAST(0 AS BIGINT) AS skipped FROM m JOIN f USING (doc_id) GROUP BY doc_id")
def edit_delete(spark, sf_dir):
    return edit.replacements(docs(spark, sf_dir), "license", "", every=True)


@query(f"""WITH {LINES}, m AS (SELECT doc_id, (page - 1) * 25 + line_no AS k, text, contains(lower(text), 'the') AND page IN (1, 3) AS hit FROM lines), f AS (SELECT doc_id, min(k) AS k0, count(*) AS n FROM m WHERE hit GROUP BY doc_id)
SELECT doc_id, string_agg(CASE WHEN k = k0 THEN regexp_replace(text, '(?i)the', 'a', 'g') ELSE text END, chr(10) ORDER BY k) AS text, CAST(1 AS BIGINT) AS replaced, any_value(n) - 1 AS skipped FROM m JOIN f USING (doc_id) GROUP BY doc_id""")
def edit_pages(spark, sf_dir):
    """RW1 with a page selection: the first matching line of those pages."""
    return edit.replacements(docs(spark, sf_dir), "the", "a", pages=[3, 1])


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda t: contains(t, 'the'))) AS BIGINT) AS lines_changed FROM documents WHERE contains(text, 'the')")
def edit_report(spark, sf_dir):
    """AGG15."""
    return edit.replacements(docs(spark, sf_dir), "the", "THE", every=True, case_sensitive=True).select("doc_id", F.col("replaced").alias("lines_changed"))


@query("SELECT doc_id, list_aggregate(list_filter(list_transform(string_split(replace(text, chr(10), ','), ','), lambda x: trim(x, ' ')), lambda x: x <> ''), 'string_agg', '|') AS kw FROM documents WHERE len(list_filter(list_transform(string_split(replace(text, chr(10), ','), ','), lambda x: trim(x, ' ')), lambda x: x <> '')) > 0")
def keyword_lists(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", keywords(F.col("text")).alias("k")).where(F.size("k") > 0).select("doc_id", F.array_join("k", "|").alias("kw"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, text, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(range(len(t))) AS k, length(unnest(t)) AS n FROM t),
p AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l),
e AS (SELECT doc_id, a AS s, a + least(n, 3) AS f, '[' || k || ']' AS new FROM p UNION ALL SELECT doc_id, a + 2, a + 5, 'never' FROM p WHERE n > 6 UNION ALL SELECT doc_id, a + n - 1, a + n + 2, '|' FROM p WHERE n > 0 AND n % 4 = 0),
o AS (SELECT e.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY s, f, new) AS i, length(text) AS size FROM e JOIN t ON t.doc_id = e.doc_id), c AS (SELECT doc_id, count(*) AS c FROM o GROUP BY doc_id),
w AS (SELECT doc_id, 0::BIGINT AS i, 0::HUGEINT AS at, '' AS done, 0::BIGINT AS applied FROM c
  UNION ALL SELECT w.doc_id, o.i, CASE WHEN o.s >= w.at AND o.f <= size THEN o.f ELSE w.at END, CASE WHEN o.s >= w.at AND o.f <= size THEN done || substr(t.text, (w.at + 1)::BIGINT, (o.s - w.at)::BIGINT) || o.new ELSE done END,
    applied + CAST(o.s >= w.at AND o.f <= size AS BIGINT) FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1 JOIN t ON t.doc_id = w.doc_id)
SELECT w.doc_id, done || substr(t.text, (w.at + 1)::BIGINT) AS text, applied, c - applied AS skipped FROM w JOIN c ON c.doc_id = w.doc_id AND w.i = c.c JOIN t ON t.doc_id = w.doc_id""")
def splice_lines(spark, sf_dir):
    """WIN12: spans replaced from left to right, those that overlap one before them skipped."""
    return edit.splices(docs(spark, sf_dir), fixtures.line_edits(docs(spark, sf_dir)))


@query("""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[\\s,]+'), lambda x: x <> ''), '|') AS kw FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[\\s,]+'), lambda x: x <> '')) > 0""")
def keyword_words(spark, sf_dir):
    """FN7 between commas and any white space."""
    return docs(spark, sf_dir).select("doc_id", keywords(F.col("text"), WORDS).alias("k")).where(F.size("k") > 0).select("doc_id", F.array_join("k", "|").alias("kw"))


# ---- grouping, diff, geometry --------------------------------------------------------------------------------------


@query(f"""WITH {LINES} SELECT doc_id, page, CAST(floor(y / 2 + 0.5) * 2 AS BIGINT) AS y, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM lines WHERE trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') <> ''""")
def group_lines_compare(spark, sf_dir):
    """WIN3: words put together again, from baselines that go up and down within a line."""
    return grouping.compare_lines(fixtures.jittered(src.page_words(docs(spark, sf_dir))))


@query(f"""WITH {LINES}, t AS (SELECT doc_id, page, y, replace(text, ' ', '') AS text, length(text) - length(ltrim(text, ' ')) AS k FROM lines WHERE replace(text, ' ', '') <> '')
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS line_no, text, 50.0::DOUBLE + 7.0::DOUBLE * k AS x, y + (k % 3 - 1)::DOUBLE * 0.9::DOUBLE AS y FROM t""")
def group_lines_core(spark, sf_dir):
    """WIN2: words up to 1.8 points off their line's first one come back joined without blanks."""
    return grouping.baseline_lines(fixtures.jittered(src.page_words(docs(spark, sf_dir))))


WORDS_SQL = f"""{LINES}, q AS (SELECT doc_id, page, line_no, y, string_split(text, ' ') AS parts FROM lines), k AS (SELECT *, unnest(parts) AS str, unnest(range(len(parts))) AS k FROM q),
words AS (SELECT doc_id, page, line_no, k, y, str, 7.0::DOUBLE * length(str) AS w, 50.0::DOUBLE + 7.0::DOUBLE * (CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(parts[1:k], ' ')) + 1 END) AS x FROM k WHERE str <> '')"""


@query(f"""WITH {WORDS_SQL}, ws AS (SELECT * REPLACE (x + CASE WHEN k >= 4 THEN 47.0::DOUBLE WHEN k >= 2 THEN 40.0::DOUBLE ELSE 0.0::DOUBLE END AS x) FROM words), starts AS (SELECT doc_id, page, x FROM ws GROUP BY doc_id, page, x
  HAVING count(DISTINCT line_no) >= (SELECT CASE WHEN count(DISTINCT v.line_no) >= 3 THEN 3 ELSE 2 END FROM ws v WHERE v.doc_id = ws.doc_id AND v.page = ws.page)),
a AS (SELECT w.*, s.x IS NOT NULL AS known, w.x - lag(w.x + w.w) OVER l AS gap
  FROM ws w LEFT JOIN starts s ON w.doc_id = s.doc_id AND w.page = s.page AND w.x = s.x WINDOW l AS (PARTITION BY w.doc_id, w.page, w.line_no ORDER BY w.k)),
b AS (SELECT *, CAST(gap IS NULL OR gap > 22.4::DOUBLE OR known AND gap > 12.6::DOUBLE AS INTEGER) AS opens FROM a),
c AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, page, line_no ORDER BY k) AS cell_seq, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS row_seq FROM b)
SELECT doc_id, page, row_seq, CAST(cell_seq AS BIGINT) AS cell_seq, string_agg(CASE WHEN opens = 1 THEN '' ELSE repeat(' ', least(4, CAST(floor(gap / 4.2::DOUBLE + 0.5::DOUBLE) AS INTEGER))) END || str, '' ORDER BY k) AS text,
  min(x) AS x, any_value(y) - 14.0::DOUBLE * 0.3::DOUBLE AS y, max(x + w) - min(x) AS w, 14.0::DOUBLE * 1.2::DOUBLE AS h, 14.0::DOUBLE AS size,
  arg_min(known, k) AND cell_seq > 1 AS cell, CASE WHEN cell_seq > 1 THEN arg_min(gap, k) ELSE 0.0::DOUBLE END AS gap_before
FROM c GROUP BY doc_id, page, row_seq, cell_seq""")
def group_cells(spark, sf_dir):
    """WIN4, WIN5 and WIN7: cells start at wide gaps, and past a gap of 0.9 sizes at columns that recur."""
    return grouping.table_cells(fixtures.spread(src.page_words(docs(spark, sf_dir))))


@query(f"""WITH {WORDS_SQL}, o AS (SELECT *, (line_no * 4294967296 + k) % 17 = 0 AS unsure, (k % 3)::DOUBLE AS bump FROM words),
t AS (SELECT doc_id, page, line_no, string_agg(str, ' ' ORDER BY k) AS text, min(x) AS x0, min(800::DOUBLE - y - 10::DOUBLE + bump * 1.5::DOUBLE) AS y0, max(x + w) AS x1, max(800::DOUBLE - y + bump / 2) AS y1, bool_or(unsure) AS unsure FROM o GROUP BY doc_id, page, line_no)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0) AS line_no, text, x0, y0, x1, y1, 90.0::DOUBLE AS confidence FROM t WHERE NOT unsure""")
def group_lines_ocr(spark, sf_dir):
    """WIN6, AGG8 and AGG9 over words as a recogniser would give them, their middles up to 2 points apart in a line."""
    return grouping.ocr_lines(fixtures.ocr_words(src.page_words(docs(spark, sf_dir))))


@query(f"""WITH {WORDS_SQL}, n AS (SELECT doc_id, page, floor(x * 2 + 0.5) / 2 AS "column", count(DISTINCT y) AS n FROM words GROUP BY ALL), r AS (SELECT doc_id, page, count(DISTINCT y) AS rows FROM words GROUP BY ALL)
SELECT doc_id, page, "column", n FROM n JOIN r USING (doc_id, page) WHERE n >= CASE WHEN rows >= 3 THEN 3 ELSE 2 END""")
def recurring_columns(spark, sf_dir):
    """AGG11."""
    return grouping.recurring_columns(src.words(docs(spark, sf_dir)))


@query()
def diff_lines(spark, sf_dir):
    """J19 and RW30."""
    return diff.compare(docs(spark, sf_dir))


@query("""WITH h AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, string_split(text, chr(10))[1] AS head FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY head) AS left_doc FROM h)
SELECT f.left_doc, f.doc_id AS right_doc, CAST(f.n AS BIGINT) AS right_lines, CAST(l.n AS BIGINT) AS left_lines FROM f JOIN h l ON f.left_doc = l.doc_id WHERE f.doc_id <> f.left_doc""")
def diff_sizes(spark, sf_dir):
    """What every alignment must add up to: added + same lines on the right, removed + same on the left."""
    s = diff.summary(diff.compare(docs(spark, sf_dir)))
    return s.select("left_doc", "right_doc", (F.col("added") + F.col("same")).alias("right_lines"), (F.col("removed") + F.col("same")).alias("left_lines"))


@query()
def diff_summary(spark, sf_dir):
    """AGG1."""
    return diff.summary(diff.compare(docs(spark, sf_dir)))


# Every seventh line is taken out and every eleventh of the rest replaced by one that stands nowhere else, so the longest alignment
# is that of the lines that stay.
EDITED_SQL = """t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL)"""


@query(f"""WITH {EDITED_SQL} SELECT doc_id AS left_doc, doc_id AS right_doc, count(*) FILTER (k % 7 <> 3 AND k % 11 <> 5) AS same, true AS valid FROM t GROUP BY doc_id""")
def diff_checked(spark, sf_dir):
    """Alignments of texts with edited ones lead through all lines of both, in order, and are as long as can be."""
    pairs = fixtures.edited_versions(docs(spark, sf_dir))
    return diff.checked(diff.diff(pairs), pairs)


@query(f"""WITH {EDITED_SQL} SELECT doc_id AS left_doc, doc_id AS right_doc, count(*) FILTER (k % 7 <> 3 AND k % 11 = 5) AS added, count(*) FILTER (k % 7 = 3 OR k % 11 = 5) AS removed, count(*) FILTER (k % 7 <> 3 AND k % 11 <> 5) AS same FROM t GROUP BY doc_id""")
def diff_counts(spark, sf_dir):
    """AGG1 on texts and edited ones."""
    return diff.summary(diff.diff(fixtures.edited_versions(docs(spark, sf_dir))))


@query(f"""WITH {PAGES} SELECT l.doc_id, l.page, l.line_no,
  round(CASE p.rot WHEN 0 THEN l.x - 10 WHEN 90 THEN l.y - 20 WHEN 180 THEN 610 - l.x ELSE 820 - l.y END * 1.5, 6) AS vx,
  round(CASE p.rot WHEN 0 THEN 820 - l.y WHEN 90 THEN l.x - 10 WHEN 180 THEN l.y - 20 ELSE 610 - l.x END * 1.5, 6) AS vy
FROM lines l JOIN pages p ON l.doc_id = p.doc_id AND l.page = p.page""")
def viewport_points(spark, sf_dir):
    """makeViewport on an offset page box, for the page's rotation."""
    rows = src.lines(docs(spark, sf_dir)).withColumn("rot", (F.col("page") - 1) * 90 % 360)
    lit = lambda v: F.lit(float(v))
    m, _, _ = g.viewport(lit(10), lit(20), lit(600), lit(800), 1.5, F.col("rot"))
    x, y = g.apply(m, F.col("x"), F.col("y"))
    return rows.select("doc_id", "page", "line_no", F.round(x, 6).alias("vx"), F.round(y, 6).alias("vy"))


@query(f"WITH {LINES} SELECT doc_id, page, line_no, x, y FROM lines")
def viewport_round_trip(spark, sf_dir):
    """A point through the viewport and back by the inverse matrix."""
    rows = src.lines(docs(spark, sf_dir)).withColumn("rot", (F.col("page") - 1) * 90 % 360)
    lit = lambda v: F.lit(float(v))
    m, _, _ = g.viewport(lit(10), lit(20), lit(600), lit(800), 1.5, F.col("rot"))
    there = rows.withColumn("m", m).withColumn("vx", g.apply(F.col("m"), F.col("x"), F.col("y"))[0]).withColumn("vy", g.apply(F.col("m"), F.col("x"), F.col("y"))[1])
    x, y = g.apply(g.invert(F.col("m")), F.col("vx"), F.col("vy"))
    return there.select("doc_id", "page", "line_no", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"WITH {LINES} SELECT doc_id, page, line_no, CASE WHEN page % 4 IN (1, 3) THEN 600 - x ELSE x END AS fx, CASE WHEN page % 4 IN (2, 3) THEN 800 - y ELSE y END AS fy FROM lines")
def flip_points(spark, sf_dir):
    rows = src.lines(docs(spark, sf_dir))
    x, y = g.flipped(F.col("x"), F.col("y"), F.lit(600.0), F.lit(800.0), (F.col("page") % 4).cast("int"))
    return rows.select("doc_id", "page", "line_no", x.alias("fx"), y.alias("fy"))


@query(f"""WITH {LINES} SELECT doc_id, page, line_no, round(300 - (y + 8.4 - 400) - 8.4, 6) AS rx, round(400 + (x + w / 2 - 300) - w / 2, 6) AS ry, round(16.8::DOUBLE, 6) AS rw, w AS rh FROM lines""")
def rotate_rects(spark, sf_dir):
    """A line's box after a quarter turn about the middle of the page."""
    rows = src.lines(docs(spark, sf_dir))
    out = g.rotated_rect(F.col("x"), F.col("y"), F.col("w"), F.lit(16.8), F.lit(600.0), F.lit(800.0), 90)
    return rows.select("doc_id", "page", "line_no", *(F.round(c, 6).alias(n) for c, n in zip(out, ("rx", "ry", "rw", "rh"), strict=True)))


@query(f"WITH {LINES} SELECT doc_id, page, (page * 100 + line_no) AS seq, text, round(x * 2, 6) AS x, round((800 - y) * 2, 6) AS y, round(w * 2, 6) AS dx, 0.0::DOUBLE AS dy, round(size * 2, 6) AS height FROM lines WHERE trim(text, ' ') <> ''")
def text_runs(spark, sf_dir):
    """toTextRuns at scale 2."""
    items = fixtures.pdf_items(src.lines(docs(spark, sf_dir)))
    lit = lambda v: F.lit(float(v))
    runs = leaks.text_runs(items, g.viewport(lit(0), lit(0), lit(600), lit(800), 2.0, F.lit(0))[0], 2.0)
    return runs.select("doc_id", "page", "seq", "text", *(F.round(F.col(c) + 0.0, 6).alias(c) for c in ("x", "y", "dx", "dy", "height")))


@query(f"""WITH {LINES}, s AS (SELECT *, greatest(0.0, 100.0 - x) AS s0, least(w, 220.0 - x) AS s1, least(size, 760.0 - y) - greatest(0.0, 700.0 - y) AS band FROM lines WHERE length(text) > 0),
k AS (SELECT *, CAST(floor(s0 / w * length(text)) AS INTEGER) AS a, CAST(least(length(text), ceil(s1 / w * length(text))) AS INTEGER) AS b FROM s WHERE s1 > s0 AND band / size >= 0.45 AND (s1 - s0) / w >= 0.02)
SELECT doc_id, page, line_no, a AS span_start, b AS span_end, round((s1 - s0) / w, 6) AS frac FROM k WHERE b > a""")
def covered_span(spark, sf_dir):
    """coveredSpan of each line under one box, y up being as good as y down for a box of its own frame."""
    rows = src.lines(docs(spark, sf_dir))
    lit = lambda v: F.lit(float(v))
    span = g.covered(F.col("text"), F.col("x"), F.col("y"), F.col("w"), lit(0), F.col("size"), lit(100), lit(700), lit(120), lit(60))
    return rows.withColumn("s", span).where(F.col("s").isNotNull()).select("doc_id", "page", "line_no", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.round("s.frac", 6).alias("frac"))


# ---- rasters, leaks, annotations, forms, model ---------------------------------------------------------------------


@query("""SELECT doc_id, CAST(1 AS BIGINT) AS page, CAST(0 AS INTEGER) AS box, CAST(2 + doc_id % 5 AS INTEGER) AS x, CAST(4 AS INTEGER) AS y, CAST(60 + doc_id % 7 AS INTEGER) AS w, CAST(20 AS INTEGER) AS h,
  CASE WHEN doc_id % 3 = 0 THEN ((60 + doc_id % 7) * 20 - 90) / ((60 + doc_id % 7) * 20)::DOUBLE ELSE 1.0::DOUBLE END AS solidity FROM documents WHERE doc_id % 4 <> 0 AND text IS NOT NULL""")
def solid_boxes(spark, sf_dir):
    """AGG13 and RW19 on painted rasters, specks and strokes included."""
    return leaks.solid_boxes(fixtures.rasters(docs(spark, sf_dir)))


@query("""SELECT doc_id, CAST(1 AS BIGINT) AS page, CAST(7 AS BIGINT) AS seq, CAST(0 AS INTEGER) AS box, coalesce(nullif(regexp_replace(text, '\\s+', '_', 'g'), ''), 'empty') AS text, 1.0::DOUBLE AS frac, round(10 * (0.2126::DOUBLE + 0.7152::DOUBLE + 0.0722::DOUBLE), 6) AS luma
FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 0 AND doc_id % 3 <> 0""")
def find_leaks(spark, sf_dir):
    """RW20."""
    rasters = fixtures.rasters(docs(spark, sf_dir))
    return leaks.leaks(fixtures.raster_runs(docs(spark, sf_dir)), leaks.solid_boxes(rasters), rasters).withColumn("luma", F.round("luma", 6))


@query("""SELECT doc_id, CAST(doc_id % 4 <> 0 AS BIGINT) AS boxes, CAST(doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS BIGINT) AS leaked, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 <> 0 THEN '1' ELSE '' END AS pages_with_leaks,
  CASE WHEN doc_id % 4 = 0 THEN 'no-boxes' WHEN doc_id % 3 <> 0 THEN 'leaks' ELSE 'clean' END AS verdict FROM documents WHERE text IS NOT NULL""")
def leak_verdict(spark, sf_dir):
    """AGG2, AGG3 and RW21: every third document has light text on its box, which is no leak."""
    rows = docs(spark, sf_dir)
    return leaks.judged(leaks.analysed(fixtures.rasters(rows), fixtures.raster_runs(rows)))


def _anns(spark, sf_dir):
    return fixtures.annotations(src.lines(docs(spark, sf_dir)))


ANN_SQL = f"""{LINES}, anns AS (SELECT doc_id, page, page * 100 + line_no AS ann_id, line_no AS z, ['text', 'highlight', 'arrow', 'ink', 'formfield'][line_no % 5 + 1] AS type, x, y, w, size AS h, x + w AS x2, y - 5 AS y2 FROM lines)"""


@query(f"""WITH {ANN_SQL} SELECT doc_id, page, ann_id, CASE WHEN type = 'ink' THEN x - 1 ELSE x END AS x0, CASE type WHEN 'arrow' THEN y - 5 WHEN 'ink' THEN y ELSE y END AS y0,
  CASE WHEN type = 'ink' THEN x + 9 ELSE x + w END AS x1, CASE type WHEN 'arrow' THEN y WHEN 'ink' THEN y + 4 ELSE y + h END AS y1 FROM anns""")
def annotation_bounds(spark, sf_dir):
    """PRD4."""
    return _anns(spark, sf_dir).withColumn("b", annots.bounds()).select("doc_id", "page", "ann_id", "b.x0", "b.y0", "b.x1", "b.y1")


@query(f"""WITH {ANN_SQL}, o AS (SELECT *, unnest(CASE type WHEN 'text' THEN ['text'] WHEN 'highlight' THEN ['fill'] WHEN 'arrow' THEN ['line', 'head'] ELSE ['path'] END) AS op, unnest(range(CASE WHEN type = 'arrow' THEN 2 ELSE 1 END)) AS k FROM anns WHERE type <> 'formfield')
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY z, k) AS step, ann_id, op FROM o""")
def draw_ops(spark, sf_dir):
    """RW25."""
    return annots.draw_ops(_anns(spark, sf_dir)).drop("x0", "y0", "x1", "y1")


@query(f"""WITH {ANN_SQL} SELECT doc_id, page, ann_id, round(x * 1.5, 6) AS dx, round((800 - y - CASE WHEN type = 'arrow' THEN 0 ELSE h END) * 1.5, 6) AS dy FROM anns""")
def anns_to_display(spark, sf_dir):
    return annots.to_display(_anns(spark, sf_dir), 800.0, 1.5).select("doc_id", "page", "ann_id", F.round("x", 6).alias("dx"), F.round("y", 6).alias("dy"))


@query(f"""WITH {ANN_SQL}, b AS (SELECT doc_id, page, ann_id, z, CASE WHEN type = 'ink' THEN x - 1 ELSE x END AS x0, CASE type WHEN 'arrow' THEN y - 5 ELSE y END AS y0,
  CASE WHEN type = 'ink' THEN x + 9 ELSE x + w END AS x1, CASE type WHEN 'arrow' THEN y WHEN 'ink' THEN y + 4 ELSE y + h END AS y1 FROM anns)
SELECT doc_id, page, arg_max(ann_id, z) AS ann_id FROM b WHERE 55 >= x0 - greatest(5, (14 - (x1 - x0)) / 2) AND 55 <= x1 + greatest(5, (14 - (x1 - x0)) / 2) AND 705 >= y0 - greatest(5, (14 - (y1 - y0)) / 2) AND 705 <= y1 + greatest(5, (14 - (y1 - y0)) / 2) GROUP BY doc_id, page""")
def annotation_hits(spark, sf_dir):
    """PRD5."""
    return annots.hit_test(_anns(spark, sf_dir), 55.0, 705.0)


@query(f"""WITH {ANN_SQL}, b AS (SELECT doc_id, page, ann_id, CASE WHEN type = 'ink' THEN x - 1 ELSE x END AS x0, CASE type WHEN 'arrow' THEN y - 5 ELSE y END AS y0,
  CASE WHEN type = 'ink' THEN x + 9 ELSE x + w END AS x1, CASE type WHEN 'arrow' THEN y WHEN 'ink' THEN y + 4 ELSE y + h END AS y1 FROM anns),
v(vx, vy, vw, vh) AS (VALUES (40.0, 690.0, 200.0, 30.0), (600.0 - 690.0 - 30.0 + 100.0, 140.0, 30.0, 200.0), (360.0, 80.0, 200.0, 30.0), (590.0, 460.0, 30.0, 200.0))
SELECT doc_id, page, ann_id FROM b WHERE page <> 1 OR NOT EXISTS (SELECT 1 FROM v WHERE x0 < vx + vw AND x1 > vx AND y0 < vy + vh AND y1 > vy)""")
def annotations_redacted(spark, sf_dir):
    """An anti join on a rectangle's four turnings."""
    rows = _anns(spark, sf_dir)
    rects = rows.where("page = 1").select("doc_id", "page").distinct().select("*", F.lit(40.0).alias("rx"), F.lit(690.0).alias("ry"), F.lit(200.0).alias("rw"), F.lit(30.0).alias("rh"))
    return annots.surviving(rows, rects, 600.0, 800.0).select("doc_id", "page", "ann_id")


@query("""WITH f AS (SELECT doc_id, unnest(['name', 'agree', 'choice']) AS name, unnest(['text', 'checkbox', 'dropdown']) AS kind, unnest([text, 'false', 'a']) AS value FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, name, CASE name WHEN 'name' THEN 'doc ' || doc_id WHEN 'agree' THEN CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'maybe' END ELSE CASE WHEN doc_id % 3 = 0 THEN 'b' ELSE 'z' END END AS new_value FROM f WHERE doc_id % 5 <> 0),
j AS (SELECT f.*, new_value, new_value IS NOT NULL AND (f.name = 'agree' AND new_value = 'maybe' OR f.name = 'choice' AND new_value = 'z') AS bad FROM f LEFT JOIN v ON f.doc_id = v.doc_id AND f.name = v.name)
SELECT doc_id, name, kind, CASE WHEN bad OR new_value IS NULL THEN value ELSE new_value END AS value, CASE WHEN bad THEN 'not a value of ' || name END AS error FROM j""")
def fill_fields(spark, sf_dir):
    """J3 and RW26."""
    fields, values = fixtures.form_fields(docs(spark, sf_dir))
    return annots.fill_fields(fields, values)


@query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, unnest(range(2, n + 1)) AS k FROM c),
a AS (SELECT conv_id, unnest([1, 2, 3]) AS pos, unnest(['q2', 'p1', 'blank18']) AS page_id, unnest([180, 90, 0]) AS rot, unnest([0, 1, 0]) AS flip, unnest([600.0, 600.0, 300.0])::DOUBLE AS w, unnest([800.0, 800.0, 400.0])::DOUBLE AS h FROM c
  UNION ALL SELECT conv_id, k + 2, 'p' || k, 0, 0, 600.0, 800.0 FROM p)
SELECT conv_id AS doc_id, CAST(pos AS BIGINT) AS pos, page_id, rot, flip, page_id = 'blank18' AS blank, w, h FROM a""")
def model_replay(spark, sf_dir):
    """2.10: opens, merges, moves, turns, flips, blank pages; edits that are undone and redone."""
    return model.replay(fixtures.actions(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), a(z, ann_id, x, y, w, h, text) AS (VALUES (1, 'a10', 560.0, 20.0, 30.0, 40.0, 'uno'), (2, 'a11', 495.0, 200.0, 5.0, 6.0, 'two'))
SELECT conv_id AS doc_id, CAST(z AS BIGINT) AS z, ann_id, 'p1' AS page_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h, text FROM c, a WHERE z = 1 OR conv_id % 3 = 0""")
def model_annotations(spark, sf_dir):
    """Annotations added, changed, mirrored, deleted, gone with their page, brought back."""
    return model.annotations(fixtures.actions(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


from . import function_queries, object_queries  # noqa: E402, F401  they register more queries
