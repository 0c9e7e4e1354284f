"""Redaction of text documents, its report and the proof that what was covered is gone.

Everything fails closed: a missing coordinate counts as covered, and a document with a reason to refuse writes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import collapse, shortened
from .grid import meeting
from .scan import FORMS, scanned
from .text import holds

Rect = tuple[int, float, float, float, float]
#: Tolerance in points at a rectangle's edges.
SLACK = 0.5


def find_rects(lines: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """A rectangle over each line with the query: (doc_id, page, line_no, rx, ry, rw, rh)."""
    hit = lines.where(holds(F.col("text"), query, case_sensitive))
    return hit.select("doc_id", "page", "line_no", F.col("x").alias("rx"), F.round(F.col("y") - F.col("size") * 0.3, 6).alias("ry"), F.col("w").alias("rw"), F.round(F.col("size") * 1.2, 6).alias("rh"))


def _inside(r: Rect) -> tuple[Column, Column]:
    """(covers the line wholly, touches it): a line reaches from a quarter of its size below the baseline to 0.85 above."""
    page, x, y, w, h = r
    left, right = F.col("x"), F.col("x") + F.col("w")
    low, high = F.col("y") - F.col("size") * 0.25, F.col("y") + F.col("size") * 0.85
    here = F.col("page") == page
    touch = here & F.coalesce((left < x + w) & (right > x) & (low < y + h) & (high > y), F.lit(True))
    full = touch & F.coalesce((left >= x - SLACK) & (right <= x + w + SLACK) & (low >= y - SLACK) & (high <= y + h + SLACK), F.lit(True))
    return full, touch


def coverage(lines: DataFrame, rects: list[Rect]) -> DataFrame:
    """lines with the column coverage: full, partial or none. Rectangles are parameters of the query, so the range join
    is a few comparisons per line."""
    for r in rects:
        if r[3] <= 0 or r[4] <= 0 or r[0] < 1:
            raise ValueError(f"not a rectangle on a page: {r}")
    full, touch = F.lit(False), F.lit(False)
    for r in rects:
        f, t = _inside(r)
        full, touch = full | f, touch | t
    return lines.withColumn("coverage", F.when(full, "full").when(touch, "partial").otherwise("none"))


def coverage_by(lines: DataFrame, rects: DataFrame, own: list[str] | None = None) -> DataFrame:
    """The same against a table of rectangles (doc_id, page, rx, ry, rw, rh), compared within the cells of the page, then the
    strongest class of each line, which the columns `own` (line_no) tell from others of its page. What cannot be compared counts as covered."""
    own = own or ["line_no"]
    names = ["doc_id", "page", *own]
    left, right = F.col("x"), F.col("x") + F.col("w")
    low, high = F.col("y") - F.col("size") * 0.25, F.col("y") + F.col("size") * 0.85
    x0, y0, x1, y1 = F.col("rx"), F.col("ry"), F.col("rx") + F.col("rw"), F.col("ry") + F.col("rh")
    at = lines.select(*names, left.alias("_l"), right.alias("_r"), low.alias("_low"), high.alias("_high"))
    r = rects.select("doc_id", "page", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).distinct()
    pairs = meeting(at, r, ["doc_id", "page"], [(F.col("_l"), F.col("_r")), (F.col("_low"), F.col("_high"))], [(F.col("x0"), F.col("x1")), (F.col("y0"), F.col("y1"))], how="left")
    sure = lambda c: F.coalesce(c, F.lit(True))
    full = sure((F.col("a._l") >= F.col("b.x0") - SLACK) & (F.col("a._r") <= F.col("b.x1") + SLACK) & (F.col("a._low") >= F.col("b.y0") - SLACK) & (F.col("a._high") <= F.col("b.y1") + SLACK))
    seen = pairs.select(*(F.col(f"a.{c}").alias(c) for c in names), F.when(F.col("b").isNull(), 0).when(full, 2).otherwise(1).alias("s"))
    best = seen.groupBy(*names).agg(F.max("s").alias("s"))
    return best.select(*names, F.element_at(F.array(F.lit("none"), F.lit("partial"), F.lit("full")), F.col("s") + 1).alias("coverage"))


def covered_report(marked: DataFrame, on_partial: str = "refuse") -> DataFrame:
    """A row per document: covered and partial lines, pages touched, pass, exit_code and refusal.

    exit_code 0: redacted; 2: nothing to redact; 3: refused, nothing may be written. Partly covered lines refuse the
    document unless on_partial is 'leave'."""
    counts = marked.groupBy("doc_id").agg(
        F.count_if(F.col("coverage") == "full").alias("covered_lines"), F.count_if(F.col("coverage") == "partial").alias("partial_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("coverage") != "none", F.col("page")))), ",").alias("pages"),
    )
    refused = (F.col("partial_lines") > 0) & F.lit(on_partial == "refuse")
    return counts.select(
        "*", F.when(refused, 3).when(F.col("covered_lines") == 0, 2).otherwise(0).alias("exit_code"), (~refused & (F.col("covered_lines") > 0)).alias("pass"),
        F.when(refused, F.concat(F.col("partial_lines").cast("string"), F.lit(" line(s) only partly covered"))).alias("refusal"),
    )


def redacted_pages(marked: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, text) of what is left, a page without any line left being empty; with a report only of documents
    that passed or had nothing to redact."""
    left = marked
    if report is not None:
        left = left.join(report.where(F.col("exit_code").isin(0, 2)).select("doc_id"), "doc_id", "left_semi")
    lines = F.array_sort(F.collect_list(F.when(F.col("coverage") != "full", F.struct("line_no", "text"))))
    return left.groupBy("doc_id", "page").agg(F.array_join(F.transform(lines, lambda s: s["text"]), "\n").alias("text"))


def covered_strings(marked: DataFrame, partial_too: bool = False) -> DataFrame:
    """(doc_id, covered): distinct trimmed texts of covered lines, blank ones left out."""
    wanted = F.col("coverage").isin("full", "partial") if partial_too else F.col("coverage") == "full"
    return marked.where(wanted).select("doc_id", F.trim("text").alias("covered")).where(F.col("covered") != "").distinct()


def verify(output: DataFrame, covered: DataFrame, encodings: tuple[str, ...] = FORMS[:5]) -> DataFrame:
    """A row per covered string: in which byte forms it is still in the document's output, and in its extracted text.

    output: (doc_id, text), and content, if the file's bytes are not the text's. A document without output is looked through as an
    empty one; an unreadable one cannot be proved clean and counts as present."""
    rows = scanned(output, covered)
    has = lambda what: ~F.col("readable") | F.array_contains("found", what)
    any_bytes = F.lit(False)
    for k in encodings:
        any_bytes = any_bytes | has(k)
    return rows.select("doc_id", "covered", shortened(F.col("covered")).alias("shown"), *(has(k).alias(k.replace("-", "_")) for k in encodings), any_bytes.alias("present_in_bytes"), has("text").alias("present_in_extraction"))


def verification(checks: DataFrame) -> DataFrame:
    """A row per document: strings checked, byte_scan, extraction and pass."""
    out = checks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("strings"), F.bool_or("present_in_bytes").alias("b"), F.bool_or("present_in_extraction").alias("e"))
    word = lambda c: F.when(F.col(c), "fail").otherwise("pass")
    return out.select("doc_id", "strings", word("b").alias("byte_scan"), word("e").alias("extraction"), (~F.col("b") & ~F.col("e")).alias("pass"))


def gate(output: DataFrame, verdicts: DataFrame, report: DataFrame) -> DataFrame:
    """The one table that may be written: output of documents that the report lets pass (exit code 0) and whose
    verification passed, and of those with nothing to redact (2). A document without a report, or without the verdict
    that it needs, is not written."""
    proved = report.where(F.col("exit_code") == 0).select("doc_id").join(verdicts.where("pass").select("doc_id"), "doc_id", "left_semi")
    return output.join(proved.unionByName(report.where(F.col("exit_code") == 2).select("doc_id")), "doc_id", "left_semi")


def recoverable(output: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, covered, recoverable): is a covered string still to be found in a document's output (doc_id, text; content)?

    Strings are compared with white space collapsed. One of four characters or more counts wherever it stands: in the
    text, in it without blanks or collapsed, in any byte form, in a form's hexadecimal digits, or behind backslash escapes. A
    shorter one counts as a whole word or as a whole string of the file, '(...)' or '<...>'. A missing document
    is empty, an unreadable one is no proof."""
    strings = covered.select("doc_id", collapse(F.col("covered")).alias("covered")).where(F.col("covered") != "")
    return scanned(output, strings).select("doc_id", "covered", (~F.col("readable") | F.array_contains("found", "recoverable")).alias("recoverable"))


# Why a page is refused. Three of them name what was met.
REFUSALS = {
    "bad_fonts": "page uses Type0/Type3 font(s) ({}); text set in these fonts cannot be decoded, so complete removal cannot be verified",
    "inline_images": "page contains inline images (BI…EI operators); inline image pixels cannot be losslessly edited, so complete removal cannot be verified",
    "patterns": "page uses /Pattern resources; pattern content can carry text the engine does not parse, so complete removal cannot be verified",
    "unrecognized": "page contains text the engine cannot decode (missing font or undecodable bytes); complete removal cannot be verified",
    "nested_images": "image XObject nested inside a Form XObject; pixel redaction is implemented for page-level image XObjects only, so complete removal cannot be verified",
    "image_problem": "image XObject could not be pixel-redacted ({}); complete removal cannot be verified",
    "form_problem": "Form XObject text could not be recursively verified and redacted (possible causes: nesting deeper than 8 levels, a reference cycle, an image XObject inside the Form, or a non-invertible font inside the Form); complete removal cannot be verified",
}
NO_CONTENT, NO_COVERAGE = "no content streams on page", "no fully-covered invertible text lines (partially covered lines are left intact by design)"


def page_refusals(features: DataFrame, covered: DataFrame) -> DataFrame:
    """(doc_id, page, reason, unprovable): the first of the stages, in the order of REFUSALS, that a page does not pass; pages that
    pass have no row.

    features: a row per page with has_content and one column per stage, booleans or, for bad_fonts and image_problem, what was
    met (null or empty: nothing). A null boolean is unknown and refuses. covered: (doc_id, page, covered_lines). A page
    without content, or with nothing to delete, is skipped: not redacted, but nothing unprovable about it."""

    def stage(name: str, text: str) -> Column:
        c = F.col(name)
        if "{}" in text:
            before, after = text.split("{}")
            return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after)))
        return F.when(F.coalesce(c, F.lit(True)), F.lit(text))

    first = F.coalesce(*(stage(n, t) for n, t in REFUSALS.items()))
    rows = features.join(covered, ["doc_id", "page"], "left").withColumn("_refusal", F.when(F.coalesce("has_content", F.lit(True)), first))
    nothing = F.when(~F.coalesce("has_content", F.lit(True)), NO_CONTENT).when(F.coalesce("covered_lines", F.lit(0)) == 0, NO_COVERAGE)
    return rows.select("doc_id", "page", F.coalesce("_refusal", nothing).alias("reason"), F.col("_refusal").isNotNull().alias("unprovable")).where(F.col("reason").isNotNull())


def refused_report(report: DataFrame, refusals: DataFrame) -> DataFrame:
    """covered_report's rows, refused (exit code 3) where a page of the document is unprovable, for the first such
    page's reason."""
    bad = refusals.where("unprovable").groupBy("doc_id").agg(F.min_by("reason", "page").alias("_reason"))
    both, hit = report.join(bad, "doc_id", "left"), F.col("_reason").isNotNull()
    return both.withColumns({"exit_code": F.when(hit, 3).otherwise(F.col("exit_code")), "pass": F.col("pass") & ~hit, "refusal": F.coalesce("_reason", "refusal")}).drop("_reason")


def find_or_rects(lines: DataFrame, query: str, rects: list[Rect]) -> DataFrame:
    """Lines with the query and lines under the rectangles, in one pass."""
    found = F.coalesce(holds(F.col("text"), query), F.lit(False))
    return coverage(lines, rects).withColumn("coverage", F.when(found, "full").otherwise(F.col("coverage")))


SCRUBBED = ("Info", "Metadata", "EmbeddedFiles", "JavaScript", "OpenAction", "AA", "Thumb")


def scrub(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Documents without their metadata columns; scrubbed names what is gone."""
    gone = [c for c in docs.columns if c not in keep]
    return docs.select(*keep, F.array_join(F.array(*map(F.lit, sorted(gone))), ",").alias("scrubbed"))
