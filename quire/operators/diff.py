"""Line diff of document versions by longest common subsequence.

A pair of versions is compared within a task. Lines that only one side has are set aside first; the rest is aligned by the
furthest points that so many edits reach, so time grows with the square of the number of edits rather than with the
product of the lengths. Texts so unlike that this costs more are aligned by the table of common lines, a band of its
rows at a time. Both give the same rows. Pairs are not cut at lines that both sides have once: such a cut can miss longer
alignments."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DIFF_ROWS
from .joins import many_to_one

U64 = np.uint64
#: Versions that are compared with one copy of their first document's text.
BLOCK = 64
#: Of so many rows of furthest points one is kept; the others are worked out again.
BAND = 128


class Edits:
    """How many insertions and deletions lie between the tails x[i:] and y[j:], for pairs (i, j) on the way to the end."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most: int):
        """distance: the number for all of x and y; None if it is over `most`."""
        self.x, self.y, self.n, self.m = x[::-1], y[::-1], len(x), len(y)
        self.powers = np.cumprod(np.r_[U64(1), np.full(self.n + self.m + 1, 0xBF58476D1CE4E5B9, U64)], dtype=U64)
        self.px, self.py = self._prefixes(self.x), self._prefixes(self.y)
        row, d = self._on(np.zeros(1, np.int64), 0), 0
        self.kept, self.rows = {0: row}, {}
        while not self._reaches(row, d, self.n, self.n - self.m) and d <= most:
            row, d = self._next(row, d), d + 1
            if d % BAND == 0:
                self.kept[d] = row
        self.distance = d if d <= most else None

    def _prefixes(self, x: np.ndarray) -> np.ndarray:
        """Sums of the elements' hashes times powers of a base (mod 2**64), so that windows are compared by their differences."""
        z = x.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0xD6E8FEB86659FD93)
        z = (z ^ (z >> U64(32))) * U64(0xD6E8FEB86659FD93)
        return np.r_[U64(0), np.cumsum(z * self.powers[: len(z)], dtype=U64)]

    def _next(self, row: np.ndarray, d: int) -> np.ndarray:
        """The furthest place in x on each of the diagonals -d-1, -d+1 ... d+1, from those of d edits. One edit more changes a
        distance by one at most, so a diagonal's end counts as reached where a step would leave the table."""
        none = np.full(1, -1, np.int64)
        u = np.maximum(np.r_[none, row + 1], np.r_[row, none])
        return self._on(np.minimum(u, np.minimum(self.n, self.m + np.arange(-d - 1, d + 2, 2))), d + 1)

    def _on(self, u: np.ndarray, d: int) -> np.ndarray:
        """u moved on along equal elements."""
        v = u - np.arange(-d, d + 1, 2)
        left = np.minimum(self.n - u, self.m - v)
        on = np.flatnonzero((left > 0) & (u >= 0) & (v >= 0))
        on = on[self.x[u[on]] == self.y[v[on]]]
        if not len(on):
            return u
        a, b, low, high = u[on], v[on], np.ones(len(on), np.int64), left[on]
        p, q = self.powers[np.maximum(b - a, 0)], self.powers[np.maximum(a - b, 0)]
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.px[a + mid] - self.px[a]) * p == (self.py[b + mid] - self.py[b]) * q
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        u = u.copy()
        u[on] += low
        return u

    @staticmethod
    def _reaches(row: np.ndarray, d: int, u: int, k: int) -> bool:
        return abs(k) <= d and bool(row[(k + d) // 2] >= u)

    def within(self, i: int, j: int, d: int) -> bool:
        """Are x[i:] and y[j:] d edits apart or fewer? d has the parity of the difference of their lengths."""
        if d < 0:
            return False
        if d not in self.rows:
            at = d - d % BAND
            self.rows = {at: self.kept[at]}
            while at < d:
                self.rows[at + 1] = self._next(self.rows[at], at)
                at += 1
        return self._reaches(self.rows[d], d, self.n - i, (self.n - i) - (self.m - j))


class Table:
    """The table of numbers of common elements of x[i:] and y[j:]; every band-th row is kept, a band's rows are worked out again."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.band = x, y, max(1, math.isqrt(len(x)))
        row = np.zeros(len(y) + 1, np.int32)
        self.kept, self.rows = {len(x): row}, {}
        for i in range(len(x) - 1, -1, -1):
            row = self._above(i, row)
            if i % self.band == 0:
                self.kept[i] = row

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1: the running maximum, from the right, of the row below and of one more than the entry diagonally below
        it where the elements are equal."""
        m = len(self.y)
        row = np.zeros(m + 1, np.int32)
        row[:m] = np.maximum.accumulate(np.maximum(below[:m], np.where(self.y == self.x[i], below[1:] + 1, 0))[::-1])[::-1]
        return row

    def spare(self, i: int, j: int) -> bool:
        """Can x[i] go without loss?"""
        if i not in self.rows or i + 1 not in self.rows:
            top = i - i % self.band
            end = min(len(self.x), top + self.band)
            self.rows = {end: self.kept[end]}
            for k in range(end - 1, top - 1, -1):
                self.rows[k] = self._above(k, self.rows[k + 1])
        return bool(self.rows[i + 1][j] == self.rows[i][j])


def align(a: list[str], b: list[str], most: int | None = None) -> list[tuple[str, int | None, int | None]]:
    """(op, left, right) rows with 0-based line numbers. Where a deletion and an addition do equally well, the deletion
    comes first, which fixes the order of rows. most: edits beyond which the table is used."""
    ids = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    one, two = np.array([ids[t] for t in a], np.int64), np.array([ids[t] for t in b], np.int64)
    shared_a, shared_b = np.isin(one, two), np.isin(two, one)
    x, y = one[shared_a], two[shared_b]
    # A row of furthest points costs a few times as much as one of the table, and there are as many as edits.
    edits = Edits(x, y, max(64, math.isqrt(len(x) * len(y)) // 2) if most is None else most)
    left = edits.distance
    spare: Callable[[int, int], bool] = (lambda i, j: edits.within(i + 1, j, left - 1)) if left is not None else Table(x, y).spare
    out: list[tuple[str, int | None, int | None]] = []
    n, m, p, q, i, j = len(a), len(b), 0, 0, 0, 0  # p and q count lines, i and j shared ones
    use_a, use_b = shared_a.tolist(), shared_b.tolist()
    while p < n or q < m:
        if p < n and not use_a[p]:
            out.append(("del", p, None))
            p += 1
            continue
        own = q < m and not use_b[q]  # a line of b only; lines of a that can go without loss come before it
        if p < n and q < m and not own and one[p] == two[q]:
            out.append(("same", p, q))
            p, q, i, j = p + 1, q + 1, i + 1, j + 1
        elif p < n and (q == m or spare(i, j)):
            out.append(("del", p, None))
            p, i = p + 1, i + 1
            left = left and left - 1
        else:
            out.append(("add", None, q))
            q += 1
            if not own:
                j += 1
                left = left and left - 1
    return out


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _rows(left: int, right: int, a: str | None, b: str | None, only_changes: bool) -> pa.RecordBatch | None:
    """The rows of a pair's alignment, in order; line numbers count from 1."""
    x, y = (a or "").split("\n"), (b or "").split("\n")
    rows = [(left, right, k, op, None if i is None else i + 1, None if j is None else j + 1, y[j] if i is None else x[i]) for k, (op, i, j) in enumerate(align(x, y), 1) if not only_changes or op != "same"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=DIFF_ROWS.fieldNames()) if rows else None


def diff(pairs: DataFrame, only_changes: bool = False) -> DataFrame:
    """The rows of each pair (left_doc, right_doc, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a pair at a time
                rows = _rows(*(c[k].as_py() for c in batch.columns), only_changes)
                if rows is not None:
                    yield rows

    return pairs.select("left_doc", "right_doc", "a", "b").mapInArrow(run, DIFF_ROWS)


def versions(docs: DataFrame) -> DataFrame:
    """(left_doc, right_doc, of): each document with the first document that has the same first line, and how many such it has.

    Lines are compared by digests of theirs, aggregated first and joined many to one, so that a line which a third of all
    documents start with is dealt out over many tasks."""
    head = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("right_doc"), F.sha2(F.substring_index("text", "\n", 1), 256).alias("head"))
    first = head.groupBy("head").agg(F.min("right_doc").alias("left_doc"), F.count(F.lit(1)).alias("of"))
    return many_to_one(head, first.where("of > 1"), ["head"]).where("right_doc <> left_doc").select("left_doc", "right_doc", "of")


def compare(docs: DataFrame, only_changes: bool = False) -> DataFrame:
    """The rows of each document against the first one that has the same first line. A first document's text meets its versions in
    blocks: there is one copy of it for BLOCK of them, not for each."""
    pairs, texts = versions(docs), docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    blocks = F.ceil(F.col("of") / BLOCK).cast("int")
    right = pairs.withColumn("block", F.pmod(F.xxhash64("right_doc"), blocks).cast("int")).join(texts.withColumnRenamed("doc_id", "right_doc"), "right_doc").select("left_doc", "block", "right_doc", "text")
    firsts = pairs.groupBy("left_doc").agg(F.max("of").alias("of")).select("left_doc", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    left = many_to_one(firsts, texts.select(F.col("doc_id").alias("left_doc"), "text"), ["left_doc"]).select(F.col("left_doc").alias("first"), F.col("block").alias("part"), "text")

    def run(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], t) for t in _KINDS], names=DIFF_ROWS.fieldNames())
        if not lefts.num_rows or not rights.num_rows:
            return empty
        first, a = lefts["first"][0].as_py(), lefts["text"][0].as_py()
        found = (_rows(first, r.as_py(), a, t.as_py(), only_changes) for r, t in zip(rights["right_doc"], rights["text"], strict=True))
        return pa.Table.from_batches([x for x in found if x is not None], empty.schema)

    return left.groupBy("first", "part").cogroup(right.groupBy("left_doc", "block")).applyInArrow(run, DIFF_ROWS)


def summary(rows: DataFrame) -> DataFrame:
    count = lambda op: F.count_if(F.col("op") == op)
    return rows.groupBy("left_doc", "right_doc").agg(count("add").alias("added"), count("del").alias("removed"), count("same").alias("same"))


def checked(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_doc, right_doc, same, valid) of alignments with all their rows: valid if they lead through all lines of both texts of
    pairs (left_doc, right_doc, a, b), in order, and say what stands there."""
    both = F.array_sort(F.collect_list(F.struct("seq", "op", "left_line", "right_line", "text")))
    got = rows.groupBy("left_doc", "right_doc").agg(both.alias("r"))
    of = lambda r, but, f: F.transform(F.filter(r, lambda s: s["op"] != but), lambda s: s[f])
    numbered = lambda lines: F.sequence(F.lit(1).cast("bigint"), F.size(lines).cast("bigint"))
    a, b, r = F.split("a", "\n", -1), F.split("b", "\n", -1), F.col("r")
    valid = (of(r, "add", "text") == a) & (of(r, "del", "text") == b) & (of(r, "add", "left_line") == numbered(a)) & (of(r, "del", "right_line") == numbered(b))
    return got.join(pairs, ["left_doc", "right_doc"]).select("left_doc", "right_doc", F.size(F.filter(r, lambda s: s["op"] == "same")).cast("bigint").alias("same"), valid.alias("valid"))
