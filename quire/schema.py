"""Explicit schemas of the document tables. Coordinates are PDF points, y up, unless a column says otherwise."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """From 'name type, ...'; needs no session, so workers can import this module."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split(" ") for part in spec.split(", "))])


#: A positioned text line; page and line_no count from 1.
LINES = _struct("doc_id bigint, page bigint, line_no bigint, text string, x double, y double, w double, size double")
#: A run of glyphs as extracted; seq is the input order that greedy grouping depends on.
TEXT_ITEMS = _struct("doc_id bigint, page bigint, seq bigint, str string, x double, y double, w double, size double")
OCR_WORDS = _struct("doc_id bigint, page bigint, seq bigint, text string, x0 double, x1 double, y0 double, y1 double, confidence double")
CELLS = _struct("doc_id bigint, page bigint, row_seq bigint, cell_seq bigint, text string, x double, y double, w double, h double, size double, cell boolean, gap_before double")
OCR_LINES = _struct("doc_id bigint, page bigint, line_no bigint, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
GROUPED_LINES = _struct("doc_id bigint, page bigint, line_no bigint, text string, x double, y double")
#: Pixels of a page, four bytes each (red, green, blue, alpha), row by row from the top.
RASTERS = _struct("doc_id bigint, page bigint, width int, height int, data binary")
BOXES = _struct("doc_id bigint, page bigint, box int, x int, y int, w int, h int, solidity double")
#: A text run in device space: baseline origin, advance vector, glyph height.
RUNS = _struct("doc_id bigint, page bigint, seq bigint, text string, x double, y double, dx double, dy double, height double")
CANVASES = _struct("doc_id bigint, page bigint, blank boolean, r double, g double, b double")
LEAKS = _struct("doc_id bigint, page bigint, seq bigint, box int, text string, frac double, luma double")
DIFF_ROWS = _struct("left_doc bigint, right_doc bigint, seq bigint, op string, left_line bigint, right_line bigint, text string")
#: One step of a document's edit log; the payload's fields are used as the type needs them.
ACTIONS = _struct("doc_id bigint, seq bigint, type string, target string, other string, amount int, ids array<string>, payload string")
MODEL_PAGES = _struct("doc_id bigint, pos bigint, page_id string, rot int, flip int, blank boolean, w double, h double")
MODEL_ANNOTATIONS = _struct("doc_id bigint, z bigint, ann_id string, page_id string, x double, y double, w double, h double, text string")
