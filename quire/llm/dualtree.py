"""Hard negatives by dual-tree search over anchors and candidates, exact, in a grid of anchor blocks and candidate blocks.

A cell holds a bounded block of anchors and one of candidates and builds a tree over each: a node is a ball (centre, radius), its
children the halves of the line between two of its outermost points (a tenth of its rows at least). The inner products of two balls' points lie within
    c1 . c2 -+ (|c1| r2 + |c2| r1 + r1 r2),
an interval for a whole group of anchors with a whole group of candidates. Each anchor leaf first scores its most
promising candidate leaf, which gives every group of anchors a score that a candidate must reach; then pairs of nodes are
descended from the roots, a level of pairs at a time, and those whose interval cannot reach it, lies above all of
the group's windows, or holds only rows of the anchors' own label, go with all that is below them. Leaf pairs left are scored exactly, the
most promising first, until the rest cannot reach what the leaf's anchors have by then.

Two searches follow each other. Positives stay within a label: cells are dealt by label and block, labels having as
many blocks as their rows need. Their scores set each anchor's windows, in which the second search, over all labels' rows, finds
negatives. Each cell returns at most k rows for an anchor's window, ranked over the cells afterwards.

Defined results: rows with a null label or vector, or a null or non-finite component take no part; shorter vectors count as if
zeros followed; anchors repeated with the same label and vector count once, other repeated rows each; a row with the anchor's
vec_id is its own and no positive; a null vec_id is a candidate, last among ties, never an anchor, its label stays; positives with a
negative score have no negatives; ties go to the smaller vec_id; further columns are left out; an empty table gives no rows.
Components beyond what doubles hold exactly are compared as Python's integers, without pruning. Labels are integers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import many_to_one
from .threshold import _matrix, _widen

ANCHOR_BLOCK, CANDIDATE_BLOCK = 2048, 8192
ANCHOR_LEAF, CANDIDATE_LEAF = 32, 64
NONE = -np.inf


class Tree:
    """Nodes in order of levels: rows order[start:stop], centre, length of it, radius, first child (the second follows it; -1: a leaf)."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        start, stop, child = [0], [len(x)], []
        k = 0
        while k < len(start):
            a, b = start[k], stop[k]
            child.append(-1)
            if b - a > leaf:
                rows = x[self.order[a:b]]
                far = rows[np.argmax(((rows - rows.mean(0)) ** 2).sum(1))]
                along = rows @ (rows[np.argmax(((rows - far) ** 2).sum(1))] - far)
                least = max(1, (b - a) // 10)
                mid = a + int(np.clip(np.count_nonzero(along < (along.min() + along.max()) / 2), least, b - a - least))
                self.order[a:b] = self.order[a:b][np.argpartition(along, mid - a)]
                child[k] = len(start)
                start += [a, mid]
                stop += [mid, b]
            k += 1
        self.start, self.stop, self.child = (np.array(v, np.int64) for v in (start, stop, child))
        self.centre = np.stack([x[self.order[a:b]].mean(0) for a, b in zip(start, stop, strict=True)])
        self.radius = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(1).max()) for a, b, c in zip(start, stop, self.centre, strict=True)])
        self.length = np.sqrt((self.centre**2).sum(1))
        self.leaves = np.flatnonzero(self.child < 0)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.stop[node]]

    def up(self, at_leaf: dict[int, float], pick: Callable) -> np.ndarray:
        """A value for every node: a leaf's own, else pick() of its children's."""
        out = np.zeros(len(self.child))
        for k in range(len(self.child) - 1, -1, -1):
            c = self.child[k]
            out[k] = at_leaf[k] if c < 0 else pick(out[c], out[c + 1])
        return out

    def label(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label of each node."""
        rows = [labels[self.order[a:b]] for a, b in zip(self.start, self.stop, strict=True)]
        return np.array([r.min() for r in rows]), np.array([r.max() for r in rows])


def interval(p: Tree, i: np.ndarray, q: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of the nodes' points, a little wider than rounding can make them wrong."""
    mid = np.einsum("ij,ij->i", p.centre[i], q.centre[j])
    wide = p.length[i] * q.radius[j] + q.length[j] * p.radius[i] + p.radius[i] * q.radius[j]
    wide = wide + 0.5 + 1e-9 * (p.length[i] + p.radius[i]) * (q.length[j] + q.radius[j])
    return mid - wide, mid + wide


class Search:
    """The k best candidates in each window of each anchor. Candidates come in order of preference among ties; allowed(anchors,
    candidates) says which pairs count. `scored` is how many pairs were scored."""

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, c: np.ndarray, k: int, allowed: Callable, labels: tuple[np.ndarray, np.ndarray] | None = None):
        self.n, self.k, self.allowed, self.scored = len(c), k, allowed, 0
        bound = float(np.abs(x).max(initial=0)) * float(np.abs(c).max(initial=0)) * c.shape[1]
        self.exact = bound * (self.n + 1) < 2**50
        kind = np.float64 if self.exact else object
        self.none = NONE if self.exact else -(10**60)
        self.x, self.c, self.low, self.high = x.astype(kind), c.astype(kind), low.astype(kind), high.astype(kind)
        self.best = np.full((*low.shape, k), self.none, kind)  # score * n + preference
        if self.exact:
            self._descend(labels)
        else:
            for a in range(0, len(x), ANCHOR_LEAF):
                for b in range(0, self.n, CANDIDATE_LEAF):
                    self._score(np.arange(a, min(len(x), a + ANCHOR_LEAF)), np.arange(b, min(self.n, b + CANDIDATE_LEAF)))

    def _score(self, who: np.ndarray, which: np.ndarray) -> None:
        s = self.x[who] @ self.c[which].T
        self.scored += s.size
        key = s * self.n + (self.n - 1 - which)[None, :]
        ok = self.allowed(who, which)
        for w in range(self.low.shape[1]):
            inside = ok & (s >= self.low[who, w, None]) & (s <= self.high[who, w, None])
            if inside.any():
                both = np.concatenate([self.best[who, w], np.where(inside, key, self.none)], 1)
                self.best[who, w] = np.sort(both, 1)[:, -self.k :] if not self.exact else np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]

    def _need(self, who: np.ndarray) -> float:
        """What a candidate's score must reach to change anything for one of the anchors."""
        worst = self.best[who].min(2)
        held = np.where(np.isinf(worst), NONE, np.floor(worst / self.n))
        return float(np.maximum(held, self.low[who]).min(initial=np.inf, where=self.low[who] <= self.high[who]))

    def _descend(self, labels: tuple[np.ndarray, np.ndarray] | None) -> None:
        p, q = Tree(self.x, ANCHOR_LEAF), Tree(self.c, CANDIDATE_LEAF)
        mid = p.centre[p.leaves] @ q.centre[q.leaves].T
        first = dict(zip(p.leaves.tolist(), q.leaves[np.argmax(mid + p.length[p.leaves, None] * q.radius[q.leaves], 1)].tolist(), strict=True))
        for a, b in first.items():
            self._score(p.rows(a), q.rows(b))
        need = p.up({a: self._need(p.rows(a)) for a in first}, min)
        cap = p.up({a: float(self.high[p.rows(a)].max(initial=NONE)) for a in first}, max)
        own = None if labels is None else (p.label(labels[0]), q.label(labels[1]))
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(i):
            low, high = interval(p, i, q, j)
            keep = (high >= need[i]) & (low <= cap[i])
            if own:
                (a0, a1), (b0, b1) = own
                keep &= ~((a0[i] == a1[i]) & (b0[j] == b1[j]) & (a0[i] == b0[j]))
            i, j, high = i[keep], j[keep], high[keep]
            ends = (p.child[i] < 0) & (q.child[j] < 0)
            left.append((i[ends], j[ends], high[ends]))
            i, j = i[~ends], j[~ends]
            # The wider ball is opened, or the one that has children.
            open_p = (q.child[j] < 0) | (p.child[i] >= 0) & (p.radius[i] * q.length[j] >= q.radius[j] * p.length[i])
            a, b = np.where(open_p, p.child[i], i), np.where(open_p, j, q.child[j])
            i, j = np.concatenate([a, np.where(open_p, a + 1, a)]), np.concatenate([b, np.where(open_p, b, b + 1)])
        i, j, high = (np.concatenate(x) for x in zip(*left, strict=True))
        by = np.lexsort((-high, i))
        i, j, high = i[by], j[by], high[by]
        for a in np.unique(i).tolist():
            lo, hi = np.searchsorted(i, a), np.searchsorted(i, a, "right")
            lo, step = int(lo), 1
            while lo < hi and high[lo] >= self._need(p.rows(a)):
                some = [b for b in j[lo : min(hi, lo + step)].tolist() if b != first[a]]
                if some:
                    self._score(p.rows(a), np.concatenate([q.rows(b) for b in some]))
                lo, step = lo + step, step * 2

    def found(self) -> tuple[np.ndarray, ...]:
        """(anchor, window, candidate, score) of all that was found."""
        at = np.nonzero(self.best > self.none) if self.exact else np.nonzero((self.best > self.none).astype(bool))
        keys = self.best[at]
        score = np.floor(keys / self.n) if self.exact else keys // self.n
        which = (self.n - 1 - (keys - score * self.n)).astype(np.int64)
        clip = lambda s: s.astype(np.int64) if self.exact else np.clip(s, -(2**63), 2**63 - 1).astype(np.int64)
        return at[0], at[1], which, clip(score)


_FOUND = pa.schema([("anchor_id", pa.int64()), ("anchor_no", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _cell(k: int, windows: bool):
    """A cell's search: in the anchors' windows among rows of other labels, or for the best others among rows of one label."""

    def run(key, anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        if not anchors.num_rows or not candidates.num_rows:
            return _FOUND.empty_table()
        candidates = candidates.sort_by([("vec_id", "ascending")])  # nulls last
        ids = candidates["vec_id"].combine_chunks()
        x, c = _matrix(anchors["v"]), _matrix(candidates["v"])
        d = max(x.shape[1], c.shape[1])
        if windows:
            low, high = (_matrix(anchors[w]) for w in ("low", "high"))
            width = np.diff(anchors["low"].combine_chunks().offsets.to_numpy())
            low = np.where(np.arange(low.shape[1]) < width[:, None], low, 1)
            high = np.where(np.arange(high.shape[1]) < width[:, None], high, 0)  # no score is both
            mine, theirs = anchors["label"].to_numpy(), candidates["label"].to_numpy()
            allowed, labels = (lambda a, b: mine[a, None] != theirs[None, b]), (mine, theirs)
        else:
            low, high = np.full((len(x), 1), -np.inf), np.full((len(x), 1), np.inf)
            own, other = anchors["anchor_id"].to_numpy(), np.array([-np.inf if i is None else i for i in ids.to_pylist()], object if ids.null_count else np.int64)
            allowed, labels = (lambda a, b: (own[a, None] != other[None, b]).astype(bool)), None
        a, w, b, s = Search(_widen(x, d), low, high, _widen(c, d), k, allowed, labels).found()
        a = pa.array(a)
        return pa.table([anchors["anchor_id"].take(a), anchors["anchor_no"].take(a), pa.array(w.astype(np.int32)), ids.take(pa.array(b)), pa.array(s)], schema=_FOUND)

    return run


def _grid(anchors: DataFrame, candidates: DataFrame, keys: list[str], k: int, windows: bool) -> DataFrame:
    """The cells' results. Both sides have na and nc, the rows that their key has on each side, and deal themselves to blocks."""
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    a_blocks, c_blocks = blocks("na", ANCHOR_BLOCK), blocks("nc", CANDIDATE_BLOCK)
    block = lambda n, *of: F.pmod(F.xxhash64(*of), n).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = anchors.withColumns({"ab": block(a_blocks, "anchor_id", "anchor_no"), "cb": across(c_blocks)}).drop("na", "nc")
    c = candidates.withColumns({"cb": block(c_blocks, "vec_id", "v"), "ab": across(a_blocks)}).drop("na", "nc")
    a = a.toDF(*a.columns)  # columns of its own beside the candidates'
    at = [*keys, "ab", "cb"]
    return a.groupBy(*at).cogroup(c.groupBy(*at)).applyInArrow(_cell(k, windows), "anchor_id long, anchor_no long, window int, vec_id long, score long")


def _ranked(found: DataFrame, k: int, name: str) -> DataFrame:
    order = Window.partitionBy("anchor_id", "anchor_no", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def prepared(vectors: DataFrame, scale: int = 256, relabel: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, v) of the rows that take part: floor(scale * x) of each component, and the next label where vec_id is divisible
    by `relabel`."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % relabel == 0, (label + 1) % labels).otherwise(label)
    return vectors.where(x.isNotNull() & finite & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, v)."""
    rows = rows.select("vec_id", "label", "v")
    anchor = F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()
    anchors = rows.where(anchor).dropDuplicates(["vec_id", "label", "v"]).select(F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "v").alias("anchor_no"), "label", "v")
    sizes = rows.groupBy("label").agg(F.count_if(anchor).alias("na"), F.count(F.lit(1)).alias("nc")).where("na > 0")
    found = _grid(many_to_one(anchors, sizes, ["label"]), many_to_one(rows, sizes, ["label"]), ["label"], positives, False)
    best = _ranked(found, positives, "rank").where("score >= 0")
    # 50 p <= 100 n <= 95 p in whole numbers.
    half = F.expr("transform(best, p -> p.score div 2 + p.score % 2)")
    most = F.expr("transform(best, p -> p.score - p.score div 20 - if(p.score % 20 > 0, 1, 0))")
    held = best.groupBy("anchor_id", "anchor_no").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("positive_id"), "score"))).alias("best"))
    held = held.withColumns({"low": half, "high": most})
    n = rows.agg(F.count(F.lit(1)).alias("nc"), F.count_if(anchor).alias("na")).first()
    sized = lambda df: df.withColumns({"na": F.lit(n["na"]), "nc": F.lit(n["nc"])})
    windowed = anchors.join(held.select("anchor_id", "anchor_no", "low", "high"), ["anchor_id", "anchor_no"])
    near = _ranked(_grid(sized(windowed), sized(rows), [], negatives, True), negatives, "rank")
    both = near.join(held.select("anchor_id", "anchor_no", "best"), ["anchor_id", "anchor_no"]).withColumn("p", F.col("best")[F.col("window")])
    return both.select("anchor_id", F.col("p.positive_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def hard_negatives(vectors: DataFrame, every: int = 50) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by `every`, against all rows."""
    return mine(prepared(vectors), F.col("vec_id") % every == 0)
