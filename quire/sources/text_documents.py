"""Text documents as positioned pages: 25 lines a page, 20 points apart, 7 points a character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_LINES = 25
LEFT, TOP, LEADING, SIZE, ADVANCE = 50.0, 750.0, 20.0, 14.0, 7.0
PAGE_W, PAGE_H = 600.0, 800.0


def _geometry(pos: Column, text: Column) -> list[Column]:
    at = (pos % PAGE_LINES).cast("double")
    return [F.lit(LEFT).alias("x"), (F.lit(TOP) - F.lit(LEADING) * at).alias("y"), (F.length(text) * F.lit(ADVANCE)).alias("w"), F.lit(SIZE).alias("size")]


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line of each document; null texts have none."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "text"))
    page = F.floor(F.col("pos") / PAGE_LINES).cast("bigint") + 1
    return cut.select("doc_id", page.alias("page"), (F.col("pos") % PAGE_LINES + 1).cast("bigint").alias("line_no"), "text", *_geometry(F.col("pos"), F.col("text")))


def page_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, text): a row per page, cut within its document's row, without a shuffle."""
    cut = F.split(F.col(text), "\n")
    count = F.ceil(F.size(cut) / PAGE_LINES)
    pages = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda k: F.array_join(F.slice(cut, k * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n"))
    return docs.where(F.col(text).isNotNull()).select("doc_id", F.posexplode(pages).alias("pos", "text")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("page"), "text")


def _word_pages(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(doc_id, page, items) of (doc_id, text), by array operations over all texts of a batch."""
    at = lambda lists: np.asarray(lists.offsets).astype(np.int64)
    lines = pc.split_pattern(batch.column(1), "\n")
    words = pc.split_pattern(lines.flatten(), " ")
    ends = at(lines)
    doc = np.repeat(np.arange(len(lines)), np.diff(ends))
    pos = np.arange(len(doc)) - ends[doc]
    first = at(words)
    line = np.repeat(np.arange(len(words)), np.diff(first))
    flat = words.flatten()
    size = pc.utf8_length(flat).to_numpy().astype(np.int64)
    before = np.cumsum(size + 1) - (size + 1)  # characters of all words further left, with a blank behind each
    place, k = before - before[np.minimum(first[line], max(0, len(before) - 1))], np.arange(len(line)) - first[line]
    used = np.flatnonzero(size > 0)
    line, place, k, size = line[used], place[used], k[used], size[used]
    page_no = pos // PAGE_LINES
    opens = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (page_no[1:] != page_no[:-1])]) if len(doc) else np.empty(0, np.int64)
    offsets = np.searchsorted(line, np.r_[opens, len(doc)]).astype(np.int32)
    row = pos % PAGE_LINES
    columns = [
        pa.array((row[line] + 1) * WORDS_A_LINE + k), flat.take(pa.array(used)), pa.array(LEFT + ADVANCE * place), pa.array(TOP - LEADING * row[line]), pa.array(ADVANCE * size), pa.array(np.full(len(line), SIZE)),
    ]
    items = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=["seq", "str", "x", "y", "w", "size"]))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[opens])), pa.array(page_no[opens] + 1), items], names=["doc_id", "page", "items"])


#: seq counts the words of a page's lines from this many times the line's number on.
WORDS_A_LINE = 1 << 32
#: Characters of text that are turned into arrays at once; a longer text by itself.
SLICE = 2_000_000


def page_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, page, items): the text items of each page, one per word of each line, placed by its character offset. A
    document's pages come out of its own row: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)) // SLICE
            cuts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]) if len(sizes) else []
            for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
                yield _word_pages(batch.slice(a, b - a))

    rows = docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, page bigint, items array<struct<seq:bigint,str:string,x:double,y:double,w:double,size:double>>")


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """The items of page_words as rows."""
    return page_words(docs, text).select("doc_id", "page", F.inline("items"))
