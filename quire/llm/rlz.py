"""Substring deduplication by relative Lempel-Ziv parsing, exact for windows of `width` words.

The reference is the corpus itself, in blocks found by content: every window of `width` words names an anchor, the smallest hash
among its `gram`-word grams (the rightmost, if there are several). Consecutive windows with one anchor are a segment, of up
to 2 * width - gram words; a block is all segments of one anchor, in order of document and place. Equal windows name equal
anchors, so a window's copies are in its own block, and there at the same distance from the anchor.

Documents are parsed against the blocks that they name. A factor is the longest copy, from a given word on, of words that stand
in an earlier segment of the block, laid anchor over anchor. A segment is parsed from left to right: where the longest factor has
`width` words or more it is a duplicate span, and the parse goes on with the first window that reaches over the factor's end
(the check at factor boundaries: that window may have another copy); where it is shorter, with the next word. So every
window with an earlier copy lies in a factor, and the union of the factors is exact.

From coarse to fine, each over fewer rows:

1. Anchors (about 1 per 8 words) are counted; a block of one segment holds no copies.
2. Equal segments are one factor each, but for the first of them.
3. Blocks of up to BLOCK different segments are parsed, the segments' words side by side.
4. In larger blocks a parse would compare all segments with all; their windows are looked up one by one instead, each
   in what is then a block of its own: runs of windows with earlier copies are the factors.

Looked-up keys are aggregated before they are joined, as many rows to one, which adaptive execution splits; no task
holds all occurrences of a passage.

Defined results: null and empty texts have no words; texts of fewer than `width` words keep all of them; rows with one
doc_id are ordered by a digest of their text, and equal rows are copies of each other, so all but one lose their windows; a null
doc_id comes first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpoint_dir, grams, many_to_one, mix, numbered, signed, slices, word_hashes

WIDTH, GRAM = 20, 6
#: Different segments of a block that are compared with each other.
BLOCK = 64
#: Bits for the windows that follow a segment's first one.
FOLLOW = 16
#: Bytes of deflated text that a worker turns into arrays at once.
PACKED_BYTES = 400_000
_PLACE = (1 << 30) - 1  # a text holds fewer words


def hashes(words: list[list[bytes]]) -> np.ndarray:
    return np.fromiter(map(word_hashes().__getitem__, chain.from_iterable(words)), U64, sum(map(len, words)))


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (sizes of each), one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(sizes.sum()))


def segments(words: list[list[bytes]], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """The segments of many texts: number of the text, first window, windows that follow, anchor hash, segment hash."""
    sizes = np.array([len(w) for w in words], np.int64)
    h = hashes(words)
    windows = np.maximum(sizes - width + 1, 0)
    if not windows.sum():
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, U64, U64))
    begin = np.cumsum(sizes) - sizes
    g = grams(h, gram)
    # The rightmost smallest gram of each window: hash and, for ties, distance from the end; minima by doubling.
    low, have, span = (g & U64(~_PLACE & 0xFFFFFFFFFFFFFFFF)) | (_PLACE - np.arange(len(g))).astype(U64), 1, width - gram + 1
    while have < span:
        step = min(have, span - have)
        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
    at = ranges(begin, windows)
    text = np.repeat(np.arange(len(words)), windows)
    anchor = _PLACE - (low[at] & U64(_PLACE)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = at[new]
    last = np.r_[at[new[1:] - 1], at[-1]]
    # A segment's hash: prefix sums of word hashes times powers, made independent of the place by the inverse power.
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(h * _powers(len(h))[: len(h)], dtype=np.uint64)])
    body = (prefix[last + width] - prefix[first]) * _inverse(len(h))[first] + (last - first).astype(U64)
    return text[new], first - begin[text[new]], last - first, g[anchor[new]], mix(body)


_P = 0xD1342543DE82EF95
_P_INV = pow(_P, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    got = _TABLES.get(base)
    if got is None or len(got) < n:
        size = 1 << max(12, (n - 1).bit_length())
        got = np.full(size, base, U64)
        got[0] = 1
        got = _TABLES[base] = np.multiply.accumulate(got)
    return got


def _powers(n: int) -> np.ndarray:
    return _table(_P, n)


def _inverse(n: int) -> np.ndarray:
    return _table(_P_INV, n)


def _scan(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(row, anchor, body, at): a row per segment; at packs its first window start and how many windows follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            text, first, follow, anchor, body = segments(words, width, gram)
            if len(text):
                ids = batch.column(0).to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(signed(anchor)), pa.array(signed(body)), pa.array(first << FOLLOW | follow)], names=["row", "anchor", "body", "at"])

    return rows.select("row", "text").mapInArrow(run, "row long, anchor long, body long, at long")


def _words(z: bytes) -> np.ndarray:
    return hashes([zlib.decompress(z).split()])


def _segment_rows(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(anchor, row, at, left, words): the segments (anchor, at) of (row, z, wanted) with the hashes of their words; left: how many
    of these stand before the anchor."""
    for batch in slices(batches, "z", PACKED_BYTES):
        out: list[tuple] = []
        for i, z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            h = _words(z)
            g = signed(grams(h, gram))
            for x in wanted:
                first, n = x["at"] >> FOLLOW, (x["at"] & ((1 << FOLLOW) - 1)) + width
                # The anchor is in all the windows, so in the last one; of equal grams the rightmost counts.
                inside = np.flatnonzero(g[first + n - width : first + n - gram + 1] == x["anchor"])
                out.append((x["anchor"], i, x["at"], int(inside[-1]) + n - width, h[first : first + n].tobytes()))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "row", "at", "left", "words"])


def parse(block: np.ndarray, words: np.ndarray, windows: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first slot, end) of the factors of segments, in the order of their blocks.

    block: each segment's block, equal ones next to each other, earlier segments first; words: a row of slots for each segment,
    anchors in the same slots, 0 where a segment has no word; windows: first and last slot where a window starts."""
    before = width - gram  # slots before the anchor
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    place = np.arange(len(block)) - np.repeat(starts, np.diff(np.r_[starts, len(block)]))  # earlier segments of the block
    # reach[s, l]: how many words past the anchor agree with s in the earlier segment that agrees furthest, of those
    # that agree in l words before it (-1: none).
    reach = np.full((len(block), before + 1), -1, np.int64)
    lo = 0
    upto = np.cumsum(place)
    while lo < len(block):  # a bounded number of pairs at a time
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 25_000, "right")))
        s = np.repeat(np.arange(lo, hi), place[lo:hi])
        t = ranges(np.arange(lo, hi) - place[lo:hi], place[lo:hi])
        a = words[s]
        same = (a == words[t]) & (a != 0)
        left = np.logical_and.accumulate(same[:, :before][:, ::-1], axis=1).sum(1)
        right = np.logical_and.accumulate(same[:, before + gram :], axis=1).sum(1)
        np.maximum.at(reach, (s, left), right)
        lo = hi
    reach = np.maximum.accumulate(reach[:, ::-1], axis=1)[:, ::-1]
    who, at = np.arange(len(block)), windows[:, 0].copy()
    found = []
    while len(who):
        end = before + gram + reach[who, before - at]
        long = (end - at >= width) & (reach[who, before - at] >= 0)
        found.append((who[long], at[long], end[long]))
        at = np.where(long, end - width, at) + 1  # past the factor: the first window over its end
        going = at <= windows[who, 1]
        who, at = who[going], at[going]
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(3))


def _parsed(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(row, first, last): factors of segment rows that come sorted by anchor, row and at, as runs of window starts."""

    def factored(table: pa.Table) -> pa.RecordBatch:
        anchor, row, at, left = (table[k].to_numpy() for k in ("anchor", "row", "at", "left"))
        flat = table["words"].combine_chunks()
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
        sizes = np.diff(ends) // 8
        h = np.frombuffer(flat.buffers()[2], U64, int(sizes.sum()), int(ends[0]))
        slot = (width - gram) - left
        words = np.zeros((len(anchor), 2 * width - gram), U64)
        words[np.repeat(np.arange(len(anchor)), sizes), ranges(slot, sizes)] = h
        who, begin, end = parse(anchor, words, np.stack([slot, slot + (at & ((1 << FOLLOW) - 1))], 1), gram, width)
        shift = (at >> FOLLOW)[who] - slot[who]
        return pa.RecordBatch.from_arrays([pa.array(row[who]), pa.array(begin + shift), pa.array(end - width + shift)], names=["row", "first", "last"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        anchor = table["anchor"].to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last block may go on
        if cut:
            yield factored(table.slice(0, cut).combine_chunks())
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield factored(held.combine_chunks())


def _window_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(key, key2, row, start): the windows of the segments (anchor, at) of (row, z, wanted), hashed twice from the texts."""
    for batch in slices(batches, "z", PACKED_BYTES):
        keys, keys2, ids, starts = [], [], [], []
        for i, z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            h = _words(z)
            at = np.array([x["at"] for x in wanted], np.int64)
            start = np.sort(ranges(at >> FOLLOW, (at & ((1 << FOLLOW) - 1)) + 1))
            keys.append(grams(h, width)[start])
            keys2.append(grams(h ^ U64(0x5851F42D4C957F2D), width, 0xDA942042E4DD58B5)[start])
            starts.append(start)
            ids.append(np.full(len(start), i))
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys))), pa.array(signed(np.concatenate(keys2))), pa.array(np.concatenate(ids).astype(np.int64)), pa.array(np.concatenate(starts).astype(np.int64))],
                names=["key", "key2", "row", "start"],
            )


def packed(rows: DataFrame) -> DataFrame:
    """(row, z): texts deflated before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column(1).to_pylist()], pa.binary())], names=["row", "z"])

    return rows.select("row", "text").mapInArrow(run, "row long, z binary")


def factors(rows: DataFrame, texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(row, first, last): factors of at least `width` words, as runs of the window starts within them.

    rows: (row, text), row unique; texts: packed(rows). 1 <= gram <= width <= gram + 65535."""
    if not 1 <= gram <= width < gram + (1 << FOLLOW):
        raise ValueError(f"width {width} and gram {gram}: the window must hold the gram, with fewer than {1 << FOLLOW} words besides")
    checkpoint_dir(rows.sparkSession)
    found = _scan(rows, width, gram)
    repeated = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = many_to_one(found, repeated, ["anchor"]).checkpoint()  # the segments with company, a small part; read more than once
    kinds = held.groupBy("anchor", "body").agg(F.min(F.struct("row", "at")).alias("head"))
    start, last = F.shiftright("at", FOLLOW), F.shiftright("at", FOLLOW) + F.col("at").bitwiseAND((1 << FOLLOW) - 1)
    equal = many_to_one(held, kinds, ["anchor", "body"]).where(F.struct("row", "at") != F.col("head")).select("row", start.alias("first"), last.alias("last"))
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    apart = many_to_one(kinds.select("anchor", "head.row", "head.at"), mixed, ["anchor"])
    wanted = lambda which: texts.join(apart.where(which).groupBy("row").agg(F.collect_list(F.struct("anchor", "at")).alias("wanted")), "row").select("row", "z", "wanted")  # noqa: E731  a list within one document
    narrow = wanted(F.col("m") <= BLOCK).mapInArrow(lambda b: _segment_rows(b, width, gram), "anchor long, row long, at long, left int, words binary")
    blocks = narrow.repartition("anchor").sortWithinPartitions("anchor", "row", "at")
    parsed = blocks.mapInArrow(lambda b: _parsed(b, width, gram), "row long, first long, last long")
    windows = wanted(F.col("m") > BLOCK).mapInArrow(lambda b: _window_rows(b, width), "key long, key2 long, row long, start long")
    earliest = windows.groupBy("key", "key2").agg(F.min(F.struct("row", "start")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = many_to_one(windows, earliest, ["key", "key2"]).where(F.struct("row", "start") != F.col("head")).select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    return equal.unionByName(parsed).unionByName(later)


def merged(runs: list[int], width: int) -> list[tuple[int, int]]:
    """Runs of window starts (first << 32 | windows that follow) as disjoint spans of words, in order."""
    out: list[tuple[int, int]] = []
    for r in sorted(runs):
        a, b = r >> 32, (r >> 32) + (r & 0xFFFFFFFF) + width
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keep(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:]


def _cut(rows: DataFrame, unique: bool, width: int, gram: int, kinds: pa.Schema, schema: str, make: Callable) -> DataFrame:
    """(row, *schema): make(text bytes or None, spans) of each row."""
    rows = rows.select("row", "text")
    rows = rows if unique else rows.dropDuplicates(["row"])
    texts = packed(rows)
    runs = factors(rows, texts, width, gram).select("row", (F.shiftleft("first", 32) + F.col("last") - F.col("first")).alias("r"))
    listed = runs.groupBy("row").agg(F.collect_list("r").alias("runs"))  # within one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "z", PACKED_BYTES):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_pylist([{"row": i} | make(None if z is None else zlib.decompress(z), merged(r or [], width)) for i, z, r in rows], schema=kinds)

    return texts.join(listed, "row", "left").select("row", "z", "runs").mapInArrow(run, f"row long, {schema}")


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, of the kept words joined by one space."""
    kinds = pa.schema([("row", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def make(text: bytes | None, spans: list[tuple[int, int]]) -> dict:
        words = (text or b"").split()
        kept = keep(words, spans)
        return {"n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    rows, unique = numbered(docs.select("doc_id", "text"))
    cut = _cut(rows, unique, width, gram, kinds, "n_words long, n_removed long, kept_sha256 string", make)
    return cut.withColumnRenamed("row", "doc_id") if unique else rows.select("row", "doc_id").join(cut, "row").drop("row")


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """docs with duplicate spans cut out of the texts, and the column `removed`: the spans [start, end) in words.

    A text that loses words becomes its kept words joined by one space; any other stays as it is, null too."""
    kinds = pa.schema([("row", pa.int64()), ("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def make(text: bytes | None, spans: list[tuple[int, int]]) -> dict:
        left = b" ".join(keep(text.split(), spans)) if spans else text
        return {"text": None if left is None else left.decode("utf-8", "surrogatepass"), "removed": [{"start": a, "end": b} for a, b in spans]}

    names = [c for c in docs.columns if c != "removed"]
    clash = "row" in names
    rows, unique = numbered(docs.select(*(F.col(f"`{c}`").alias("_row" if c == "row" else c) for c in names)))
    cut = _cut(rows, unique, width, gram, kinds, "text string, removed array<struct<start:bigint,end:bigint>>", make)
    out = rows.drop("text").join(cut, "row")
    return out.select(*(F.col("_row").alias("row") if clash and c == "row" else F.col(f"`{c}`") for c in names), "removed")
