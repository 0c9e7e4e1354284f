"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the ids that end together.

The B tokens of a slice of texts are a static interval index: sorted byte ranges. Each A token stabs it by bisection for the
list of B tokens that it overlaps, one search over all tokens of the slice; a list of k tokens spans the k - 1 gaps between
them. Gaps never spanned become group boundaries: there an A and a B token end together, which is a link of their ids.

Encoding: texts are cut where neither tokenizer has a token across (before white space that follows something else; not before the
few white-space characters that pieces hold); a worker remembers the ids of such units up to a bound and asks the
libraries for new ones only, in batches. That no piece of B holds a blank or a line end after another character is
checked when a worker loads it; where it does not hold, a unit is a whole text.

Counting: a slice sums the links of each id pair before anything is shuffled, and is written to the shared folder as one row of
numbers (its documents, and for each the pairs that it links, by number). Totals go back to a slice's pairs, not to
documents, in a join of many to one, and meet the slice's row there: no table of all pairs is broadcast, no text encoded twice.

Defined results: null and empty texts, and texts whose tokens do not spell out a blank and the text (those with U+2581, say), have
no tokens: zeros and '' for the digest. Rows repeated count each time; ids may be null or shared; other columns are left out,
whatever they are called; an empty table gives no rows. A text longer than a slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WHITE_SPACE
from .common import checkpoint_dir, many_to_one, slices

#: A worker forgets its units beyond so many, or so many characters of them.
UNITS, UNIT_CHARS = 400_000, 8_000_000
_ALL = "".join(map(chr, WHITE_SPACE))
_REST = _ALL.replace(" ", "").replace("\n", "")
#: White space and what follows it up to a blank or line end after something else; the rest of white space does not cut.
UNIT = re.compile(f"[{_ALL}]*+[^{_ALL}]++(?:[{_REST}][{_ALL}]*+[^{_ALL}]*+)*+|[{_ALL}]++")


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The rows `pick` of a ragged array, one after the other."""
    n = counts[pick]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[pick] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Units:
    """Units of text by number, with both tokenizers' ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_level()
        spelt = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        a_bytes = [bytes(byte[c] for c in t) if t and all(c in byte for c in t) else (t or "").encode() for t in spelt]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(x) for x in y], np.int64) for y in (a_bytes, b_bytes)]
        self.cuts = not any(re.search("[^▁]▁|\n", p) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        none = np.empty(0, np.int64)
        self.tables = [(none.astype(np.int32), none, none)] * 2  # ids of all units, where a unit's begin, how many it has
        self.good = np.empty(0, bool)

    def _spelt(self, raw: list[bytes], side: int, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each unit whether its tokens spell it out; compared in one piece where all do."""
        spelt, size = self.bytes[side], self.sizes[side]
        ends = np.cumsum(np.r_[0, size[flat]])[np.r_[0, np.cumsum(counts)]]
        want = np.fromiter(map(len, raw), np.int64, len(raw))
        col = spelt.take(pa.array(flat)) if len(flat) else pa.array([], pa.large_binary())
        data = bytes(memoryview(col.buffers()[2] or b"")[: int(size[flat].sum())])
        if (np.diff(ends) == want).all() and data == b"".join(raw):
            return np.ones(len(raw), bool)
        return np.array([data[x:y] == r for x, y, r in zip(ends[:-1].tolist(), ends[1:].tolist(), raw, strict=True)], bool)

    def _learn(self, new: list[str]) -> None:
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        raw, good = [u.encode() for u in new], np.ones(len(new), bool)
        for side, rows in enumerate(([e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], self._b_ids(new))):
            n = np.fromiter(map(len, rows), np.int64, len(rows))
            ids = np.fromiter(chain.from_iterable(rows), np.int32, int(n.sum()))
            good &= self._spelt(raw, side, ids, n)
            flat, starts, counts = self.tables[side]
            self.tables[side] = (np.concatenate([flat, ids]), np.concatenate([starts, len(flat) + np.cumsum(n) - n]), np.concatenate([counts, n]))
        self.good = np.concatenate([self.good, good])

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        """A line end behind keeps a blank at the end, and is a token of its own. The library puts a blank in front: of a
        unit's own blank nothing is left to it then; before a line end it is a token of its own."""
        got = self.b.encode([(u[1:] if u[0] == " " else u) + "\n" for u in units], num_threads=1)
        return [x[(0 if u[0] == " " else 1) : -1] for u, x in zip(units, got, strict=True)]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(units of all texts, how many of each); texts begin with a blank and hold something more."""
        words = [UNIT.findall(t) if self.cuts else [t] for t in texts]
        flat = [u for w in words for u in w]
        new = list(set(flat).difference(self.number))
        if len(self.number) + len(new) > UNITS or self.chars > UNIT_CHARS:
            self.forget()
            new = list(set(flat))
        if new:
            self._learn(new)
        return np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, words), np.int64, len(words))


@lru_cache(1)
def _units(a_path: str, b_path: str) -> Units:
    return Units(a_path, b_path)


def unspanned(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For each B token whether no A token's list of overlapped B tokens goes on behind it. Ends of tokens that tile the same bytes."""
    if not len(a_ends):
        return np.zeros(len(b_ends), bool)
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    first = np.searchsorted(b_ends, a_starts, "right")  # the B token that holds the A token's first byte
    last = np.searchsorted(b_starts, a_ends, "left") - 1  # and its last
    wide = last > first
    over = np.bincount(first[wide], minlength=len(b_ends) + 1) - np.bincount(last[wide], minlength=len(b_ends) + 1)
    return np.cumsum(over)[: len(b_ends)] == 0


class Slice:
    """The alignment of a slice of texts: flat ids and ends of both sides, tokens per text, and the groups' last tokens."""

    def __init__(self, units: Units, texts: list[str | None]):
        rows = [i for i, t in enumerate(texts) if t and "▁" not in t]
        of, n = units.numbers([f" {texts[i]}" for i in rows])
        text = np.repeat(np.array(rows, np.int64), n)
        bad = np.unique(text[~units.good[of]])
        if len(bad):
            stays = ~np.isin(text, bad)
            of, text = of[stays], text[stays]
        self.sides = []
        for (flat, starts, counts), size in zip(units.tables, units.sizes, strict=True):
            ids = _ragged(flat, starts, counts, of)
            self.sides.append((ids, np.cumsum(size[ids]), np.bincount(text, counts[of], len(texts)).astype(np.int64)))
        (self.a, a_ends, self.n_a), (self.b, b_ends, self.n_b) = self.sides
        # Texts stand one behind the other; each ends in a gap that nothing spans.
        self.b_last = np.flatnonzero(unspanned(a_ends, b_ends))
        self.a_last = np.searchsorted(a_ends, b_ends[self.b_last])
        self.ends = b_ends[self.b_last]
        self.text = np.repeat(np.arange(len(texts)), self.n_b)[self.b_last]
        self.n_groups = np.bincount(self.text, minlength=len(texts))

    def pairs(self, width: int) -> np.ndarray:
        """Each link's ids as one number."""
        return self.a[self.a_last].astype(np.int64) * width + self.b[self.b_last]

    def spelt(self) -> list[bytes]:
        """a1,a2|b1;a3|b2,b3 for each text, from the data of one Arrow column that takes every id with the sign behind it."""
        n = len(self.a) + len(self.b)
        per_a, per_b = np.diff(self.a_last, prepend=-1), np.diff(self.b_last, prepend=-1)
        before = np.cumsum(per_a + per_b) - (per_a + per_b)
        at_a = np.arange(len(self.a)) + np.repeat(before - (np.cumsum(per_a) - per_a), per_a)
        at_b = np.arange(len(self.b)) + np.repeat(before + per_a - (np.cumsum(per_b) - per_b), per_b)
        ids, sign = np.zeros(n, np.int64), np.zeros(n, np.int64)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[self.a_last]] = 1
        sign[at_b[self.b_last]] = 2
        most = int(ids.max(initial=0)) + 1
        col = _signed_ids(1 << (most - 1).bit_length()).take(pa.array(ids * 3 + sign))
        data, offsets = memoryview(col.buffers()[2] or b""), np.frombuffer(col.buffers()[1] or b"\0" * 8, np.int64)[col.offset :][: n + 1]
        ends = np.cumsum(self.n_a + self.n_b)
        # The last sign of a text is a separator that nothing follows.
        return [bytes(data[offsets[e - k] : offsets[e] - 1]) if k else b"" for e, k in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]


@lru_cache(2)
def _signed_ids(n: int) -> pa.Array:
    return pa.array([f"{i}{s}" for i in range(n) for s in ",|;"], pa.large_string())


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs with the column groups: the alignment as a list of (a_ids, b_ids, end), end being the byte behind the group in a blank
    and the text; empty where there are no tokens."""
    kind = T.ArrayType(T.StructType([T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType())), T.StructField("end", T.LongType())]))
    keep = [f for f in docs.schema.fields if f.name != "groups"]
    schema = T.StructType([*keep, T.StructField("groups", kind)])

    def lists(flat: np.ndarray, last: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, last + 1].astype(np.int32)), pa.array(flat.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(a_path, b_path)
        for batch in slices(batches, text):
            s = Slice(units, batch.column(batch.schema.get_field_index(text)).to_pylist())
            ends = np.cumsum(s.n_groups)
            begin = np.r_[0, s.ends][ends - s.n_groups]
            each = pa.StructArray.from_arrays([lists(s.a, s.a_last), lists(s.b, s.b_last), pa.array(s.ends - begin[s.text])], ["a_ids", "b_ids", "end"])
            col = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), col], names=schema.fieldNames())

    return docs.select(*(F.col(f"`{f.name}`") for f in keep)).mapInArrow(run, schema)


def _row(a: np.ndarray, kind: type) -> pa.Array:
    """An array as one row's list."""
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a.astype(kind)))


def _blocks(docs: DataFrame, a_path: str, b_path: str, width: int) -> DataFrame:
    """A row for each slice of documents (id, text): block, docs (their digests and counts), starts, links and times (for each
    document the numbers of its pairs, and how often), pairs and totals."""
    doc = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")), T.StructField("sha", T.StringType())])
    many = lambda kind: T.ArrayType(kind)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("docs", many(doc)), T.StructField("starts", many(T.IntegerType())), T.StructField("links", many(T.IntegerType())),
        T.StructField("times", many(T.IntegerType())), T.StructField("pairs", many(T.LongType())), T.StructField("totals", many(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, block = _units(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            s = Slice(units, batch.column(1).to_pylist())
            sha = [hashlib.sha256(x).hexdigest() if n else "" for x, n in zip(s.spelt(), s.n_groups.tolist(), strict=True)]
            pairs, no = np.unique(s.pairs(width), return_inverse=True)
            each, times = np.unique(s.text * max(1, len(pairs)) + no, return_counts=True)
            of = each // max(1, len(pairs))
            rows = pa.StructArray.from_arrays([batch.column(0), pa.array(s.n_a), pa.array(s.n_b), pa.array(s.n_groups), pa.array(sha, pa.string())], [f.name for f in doc.fields])
            docs_col = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            starts = np.searchsorted(of, np.arange(len(sha) + 1))
            cols = [pa.array([block]), docs_col, _row(starts, np.int32), _row(each % max(1, len(pairs)), np.int32), _row(times, np.int32), _row(pairs, np.int64), _row(np.bincount(no, minlength=len(pairs)), np.int64)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())
            block += 1

    return docs.mapInArrow(run, schema)


def _report(names: list[str]):
    """A block's documents, with the totals (pair, total, best) of its pairs summed over their links."""

    def run(key, blocks: pa.Table, totals: pa.Table) -> pa.Table:
        out = []
        totals = totals.sort_by("pair")
        count, best = (totals[c].to_numpy() for c in ("total", "best"))
        for i in range(blocks.num_rows):
            flat = lambda c: blocks[c].combine_chunks()[i].values  # noqa: B023, E731
            starts, links, times = (flat(c).to_numpy() for c in ("starts", "links", "times"))
            sums = [np.r_[0, np.cumsum(times * x[links])] for x in (best.astype(np.int64), count)]
            n_best, count_sum = (x[starts[1:]] - x[starts[:-1]] for x in sums)
            ids, n_a, n_b, n_groups, sha = flat("docs").flatten()
            out.append(pa.Table.from_arrays([ids, n_a, n_b, n_groups, n_groups, pa.array(n_best), pa.array(count_sum), sha], names=names))
        return pa.concat_tables(out)

    return run


def digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most linked of its B id), count_sum
    (of its links' corpus-wide counts) and groups_sha256."""
    import sentencepiece

    spark = docs.sparkSession
    checkpoint_dir(spark)
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/alignment-{uuid.uuid4().hex}"
    _blocks(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), a_path, b_path, width).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    pairs = blocks.select("block", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("totals").alias("n"))))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    most = totals.groupBy(F.pmod("pair", F.lit(width)).alias("b")).agg(F.max("total").alias("most"))
    ranked = many_to_one(totals.withColumn("b", F.pmod("pair", F.lit(width))), most, ["b"]).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    found = many_to_one(pairs.select(F.col("block").alias("of"), "pair"), ranked, ["pair"])
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in names[1:-1]), T.StructField(names[-1], T.StringType())])
    held = blocks.select("block", "docs", "starts", "links", "times")
    return held.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_report(names), schema)
