"""Find and replace on text documents, line by line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import literal_pattern
from ..sources.text_documents import PAGE_LINES
from .text import holds


def replacements(docs: DataFrame, find: str, replace: str, every: bool = False, case_sensitive: bool = False, pages: list[int] | None = None) -> DataFrame:
    """(doc_id, text, replaced, skipped): the edited texts of documents with the search text on the wanted pages (all),
    how many lines changed, and how many such lines on those pages were left as they are.

    Without `every` the first matching line of the document changes, else every one; within a line all
    occurrences do. It is one pass: a replacement that holds the search text is not edited again. An empty
    replacement deletes the matched text and keeps what stands around it. Works in the document's row, on its lines."""
    if not find:
        raise ValueError("edit: search text must not be empty")
    if "\n" in find:
        raise ValueError("edit: search text must be within a line")
    pattern = ("" if case_sensitive else "(?iu)") + literal_pattern(find)
    new = replace.replace("\\", "\\\\").replace("$", "\\$")
    if pages is not None and not pages:
        raise ValueError("edit: no pages selected")
    here = lambda k: F.lit(True) if pages is None else (F.floor(k / PAGE_LINES) + 1).isin(sorted(set(pages)))
    hit = lambda t, k: t.rlike(pattern) & here(k)
    change = lambda t: F.regexp_replace(t, pattern, new)
    cut = F.split("text", "\n")
    matching = F.size(F.filter(F.transform(cut, hit), lambda h: h))
    first = F.array_position(F.transform(cut, hit), F.lit(True)) - 1
    edited = F.transform(cut, lambda t, k: F.when(hit(t, k), change(t)).otherwise(t)) if every else F.transform(cut, lambda t, k: F.when(k == first, change(t)).otherwise(t))
    count = matching if every else F.least(matching, F.lit(1))
    found = docs.where(holds(F.col("text"), find, case_sensitive))
    out = found.select("doc_id", F.array_join(edited, "\n").alias("text"), count.cast("bigint").alias("replaced"), (matching - count).cast("bigint").alias("skipped"))
    return out if pages is None else out.where("replaced > 0")


def apply(docs: DataFrame, find: str, replace: str, every: bool = False, case_sensitive: bool = False) -> DataFrame:
    """All documents, edited where the search text was found."""
    done = replacements(docs, find, replace, every, case_sensitive).select("doc_id", F.col("text").alias("_new"))
    return docs.join(done, "doc_id", "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def splice(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
    """Spans [start, end) replaced from left to right, and how many; a span that overlaps one before it is skipped, as is one beyond
    the text's ends or that ends before it starts."""
    out, at, done = [], 0, 0
    for start, end, new in edits:
        if at <= start <= end <= len(text):
            out += [text[at:start], new]
            at, done = end, done + 1
    return "".join([*out, text[at:]]), done


def splices(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, applied, skipped) of the documents that have edits (doc_id, start, end, new), in characters from 0. Edits are taken
    by start, end and new text; a null one is skipped."""
    at = F.when(F.col("start").isNull() | F.col("end").isNull() | F.col("new").isNull(), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("new")))
    each = F.coalesce(at, F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("new").alias("new")))
    held = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("edits"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(held, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                edits = [tuple(e.values()) for e in batch.column(2)[k].as_py()]
                text, done = splice(batch.column(1)[k].as_py(), edits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([text]), pa.array([done], pa.int64()), pa.array([len(edits) - done], pa.int64())], names=["doc_id", "text", "applied", "skipped"])

    return rows.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string, applied bigint, skipped bigint")
