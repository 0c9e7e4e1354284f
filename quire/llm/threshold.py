"""Exact top-k inner products by Fagin's threshold algorithm, in a grid of query blocks and candidate blocks.

A cell holds a bounded block of candidates and a bounded block of queries. It sorts the candidates along every
dimension and reads all these lists from both ends at once, depth by depth: the end that a query wants is the top where
its component is positive, the bottom where it is negative. Every candidate met gets its whole score by random access.
A candidate not met down to depth t has in each dimension a value between the t-th from below and the t-th from above,
so its score is at most the sum of the better of these two products. A query stops once its k-th score beats that
bound (not merely equals it: an unseen tie could have the smaller id). Depths double from step to step, and queries
that share a cell are scored together by one matrix product per step.

Each cell returns at most k rows per query; a ranking window over those gives the result.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as if
zeros followed; a candidate with the query's vec_id is its own row; queries repeated with the same vector count once;
a null vec_id is a candidate, last among ties, never a query; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
#: Queries scored by one matrix product.
STEP = 256
FIRST_DEPTH = 8


def quantised(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and floor(64 * x) of each component, for the vectors that take part."""
    x = F.col(vec)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vectors.where(x.isNotNull() & finite).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * 64)).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.diff(arr.offsets.to_numpy())
    out = np.zeros((len(lens), max(1, int(lens.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _widen(a: np.ndarray, d: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, d - a.shape[1])))


def top_in_cell(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best candidates. Candidates are in order of preference among
    ties; ids that are negative infinity never match."""
    n, m = len(c), len(q)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * c.shape[1]
    exact = bound * (n + 1) < 2**53
    kind = np.float64 if exact else object  # Python's integers where doubles could round
    q, c = q.astype(kind), c.astype(kind)
    ordered = np.sort(c, axis=0)
    rank = np.empty(c.shape, np.int64)
    np.put_along_axis(rank, np.argsort(c, axis=0, kind="stable"), np.arange(n)[:, None], 0)
    seen_at = np.minimum(rank, n - 1 - rank).min(axis=1)  # the depth at which some list shows the candidate
    by_depth = np.argsort(seen_at, kind="stable")
    depths = seen_at[by_depth]
    rows, cols, scores = [], [], []
    for lo in range(0, m, STEP):
        live = np.arange(lo, min(lo + STEP, m))
        best = np.full((len(live), 0), -np.inf if exact else None, kind)  # score * n + preference, k at most
        done, depth = 0, FIRST_DEPTH
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            upto = int(np.searchsorted(depths, depth))
            new = by_depth[done:upto]
            if len(new):
                s = q[live] @ c[new].T
                key = s * n + (n - 1 - new)[None, :]
                key[q_ids[live, None] == c_ids[None, new]] = -np.inf if exact else -(10**40)
                both = np.concatenate([best, key], 1)
                best = np.sort(both, 1)[:, -k:] if not exact else (np.partition(both, both.shape[1] - k, 1)[:, -k:] if both.shape[1] > k else both)
            done = upto
            if done == n:
                kept.append((live, best))
                break
            unseen = np.maximum(q[live] * ordered[depth], q[live] * ordered[n - 1 - depth]).sum(1)
            full = best.shape[1] == k
            over = (np.floor_divide(best.min(1), n) > unseen) if full else np.zeros(len(live), bool)
            if over.any():
                kept.append((live[over], best[over]))
                live, best = live[~over], best[~over]
            depth *= 2
        for who, keys in kept:
            r = np.repeat(who, keys.shape[1])
            flat = keys.reshape(-1)
            ok = flat > (-np.inf if exact else -(10**39))
            r, flat = r[ok], flat[ok]
            s = np.floor_divide(flat, n)
            rows.append(r)
            cols.append((n - 1 - (flat - s * n)).astype(np.int64))
            scores.append(np.clip(s, -(2**63), 2**63 - 1).astype(np.int64) if not exact else s.astype(np.int64))
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (rows, cols, scores))


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_no", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        candidates = candidates.sort_by([("vec_id", "ascending")])  # nulls last
        q, c = _matrix(queries["v"]), _matrix(candidates["v"])
        d = max(q.shape[1], c.shape[1])
        ids = candidates["vec_id"].combine_chunks()
        none = -np.inf  # no query has it
        c_ids = np.array([none if x is None else x for x in ids.to_pylist()], object if ids.null_count else np.int64)
        q_ids = queries["query_id"].to_numpy().astype(c_ids.dtype)
        r, at, s = top_in_cell(_widen(q, d), q_ids, _widen(c, d), c_ids, k)
        return pa.table([queries["query_id"].take(pa.array(r)), queries["query_no"].take(pa.array(r)), ids.take(pa.array(at)), pa.array(s)], schema=schema)

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates. Both frames have vec_id and integers v.

    sizes: how many rows the frames have, counted here if not given; they set the number of blocks."""
    nq, nc = sizes or (queries.count(), candidates.count())
    q_blocks, c_blocks = -(-max(nq, 1) // QUERY_BLOCK), -(-max(nc, 1) // CANDIDATE_BLOCK)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_no"), "v", block(q_blocks).alias("qb")).withColumn("cb", across(c_blocks))
    c = candidates.select("vec_id", "v", block(c_blocks).alias("cb")).withColumn("qb", across(q_blocks))
    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(_cell(k), "query_id long, query_no long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The rows whose vec_id is divisible by `every`, against all rows."""
    rows = quantised(vectors)
    queries = rows.where(F.col("vec_id") % every == 0)
    n = rows.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    return search(queries, rows, k, (n["q"], n["c"]))
