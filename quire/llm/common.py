"""Shared helpers of the corpus operators: batches, word arrays, hashes, checkpoint folder."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder that the cluster names; a folder of this machine only where there is no other (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            import tempfile

            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(folder)


_LIBC = ctypes.CDLL(None)


def release() -> None:
    """Gives what is free within this process back to the system: a worker outlives its tasks, and would else stay as large as
    the largest of them made it while other stages run beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):  # glibc has it
        trim(0)


#: What a worker process keeps from task to task, by the use it is for.
_KEPT: dict[str, Any] = {}


def kept(use: str, make: Callable[[], Any] = dict) -> Any:
    """What this process keeps for a use; what it kept for another one goes, so that the stages of a pipeline do not add up."""
    got = _KEPT.get(use)
    if got is None:
        _KEPT.clear()
        release()
        got = _KEPT[use] = make()
    return got


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `limit` bytes of the column (at least one row). At both ends free memory is
    released."""
    release()
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        n = len(col)
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            yield batch.slice(a, b - a)
    release()


class HashCache(dict):
    """bytes -> 64-bit xxhash, remembered up to a bound."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes() -> HashCache:
    """The process's cache, one for all operators that hash words."""
    return kept("hashes", HashCache)


def mix(z: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on a uint64 array."""
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def grams(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Mixed polynomial hashes (mod 2**64) of all k consecutive values of h, by doubling."""
    if len(h) < k:
        return np.empty(0, U64)
    powers = [pow(base, 1 << i, 1 << 64) for i in range(k.bit_length())]
    out, done, step = None, 0, h.astype(U64)
    for i in range(k.bit_length()):
        size = 1 << i
        if k & size:
            if out is None:
                out = step
            else:  # the piece of `size` values that follows the `done` values so far
                tail = step[done:]
                out = out[: len(tail)] * U64(pow(base, size, 1 << 64)) + tail[: len(out)]
            done += size
        if done < k:
            step = step[: len(step) - size] * U64(powers[i]) + step[size:]
    return mix(out[: len(h) - k + 1])


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(U64).view(np.int64)


def many_to_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many with the columns of one, an aggregate with a row for each value of the keys (longs).

    The complements of the keys stand for them: what one is partitioned by is no use to the join then, so it is dealt out
    again like many, and adaptive execution can split the rows of a hot key."""
    other = one.select(*(F.bitwise_not(k).alias(f"_{k}") for k in keys), *(c for c in one.columns if c not in keys))
    return many.join(other, [F.bitwise_not(many[k]) == other[f"_{k}"] for k in keys], how).drop(*(f"_{k}" for k in keys))


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with the column row, in order of doc_id (nulls first), and whether it is unique. Where doc_ids are unique it is
    the doc_id; else rows are numbered by doc_id and a digest of the text, equal ones alike: their distinct keys are
    dealt out by ranges and numbered within, so no task sees all of them."""
    seen = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.bool_or(F.col("doc_id").isNull()).alias("null")).first()
    if (seen["n"] or 1) == 1 and not seen["null"]:
        return docs.withColumn("row", F.col("doc_id")), True
    checkpoint_dir(docs.sparkSession)
    held = docs.withColumn("_digest", F.coalesce(F.md5("text"), F.lit("")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_digest")]
    keys = held.select("doc_id", "_digest").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of the range, then the place within it; written, since another run could draw other ranges.
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_of"), F.monotonically_increasing_id().alias("row")).checkpoint()
    return held.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of"))).drop("_digest", "_id", "_of"), False
