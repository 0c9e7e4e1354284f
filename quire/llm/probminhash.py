"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Similarity: Jaccard of the sets of five-word shingles (lower-cased words between ASCII white space; a shorter text is one
shingle), at least THRESHOLD. A class is a connected component of these links together with exact copies.

Sketch: every shingle is a Poisson process whose rate is its weight. Its arrivals hit registers at random, each register
keeps the shingle that arrives first, and a shingle stops once its next arrival is later than the latest register. Two
documents agree in a register with their probability Jaccard similarity, which for even weights is the plain one. The
arrivals of all documents of a slice advance together in numpy.
Each document has a sketch with even weights, whose agreement is the similarity of the links, and one weighted by
1 + log of the shingle's count. They are the same unless some shingles repeat more often than others.

From sketches to classes, never over all pairs:
1. Exact copies: texts are counted by a 128-bit hash; only the first document of a text goes on.
2. Bands of ROWS registers of either sketch name buckets. Each member of a bucket is linked to the bucket's first member if
   their even or their weighted sketches agree in RELATED of the registers or more: families are the components of these links.
3. A family is dealt into blocks of bounded size, in documents and in shingles, each with the family's first LEADERS documents. A
   block's shingle sets are compared exactly, as a product of incidence matrices; it returns the links that hold it together.
4. In families of several blocks, whatever is not yet in the family's largest class is compared with all other blocks,
   block by block, so that no link between different classes stays unseen.

A text, bucket or family with a third of all documents is joined as many rows to one: the one is aggregated first and joined by
the complement of its key, so that both sides are dealt out anew and adaptive execution can split the many.

Defined results: null texts are empty, empty texts are copies of each other; rows with one doc_id and text are one
document, rows with one doc_id and different texts are different ones; null doc_ids sort first; extra columns are not
read by classes() and kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import U64, checkpoint_dir, grams, many_to_one, mix, numbered, signed, slices, word_hashes
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of ROWS registers each: a pair at the threshold shares no band of the even sketches with probability
#: (1 - 0.8**5)**25, 5 in 100,000, however often shingles repeat.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
RELATED = 0.4
#: Documents and shingles of a block, about.
BLOCK, BLOCK_SHINGLES, LEADERS = 2048, 2_000_000, 4


def shingles(text: str | None) -> np.ndarray:
    """Hashes of all shingles of a text, repeats included."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    h = np.fromiter(map(word_hashes().__getitem__, words), U64, len(words))
    return grams(h, min(SHINGLE, len(h))) if len(h) else h


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of weighted sets (hashes, weights): for each set the hash that each register keeps (0: empty set)."""
    n = len(sets)
    sizes = np.array([len(h) for h, _ in sets])
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, U64)
    if not sizes.sum():
        return kept.reshape(n, registers)
    doc = np.repeat(np.arange(n), sizes)
    h, w = np.concatenate([x for x, _ in sets]), np.concatenate([x for _, x in sets])
    time = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        bits = mix(h + U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time += -np.log1p(-((bits >> U64(11)).astype(np.float64) * 2.0**-53)) / w
        at = doc * registers + (mix(bits) % U64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = h[won]
        latest = first.reshape(n, registers).max(1)
        live = time < latest[doc]
        doc, h, w, time = doc[live], h[live], w[live], time[live]
    return kept.reshape(n, registers)


def _scan(rows: DataFrame) -> DataFrame:
    """(row, n, ta, tb, bands, sketch): number of distinct shingles, hash of the text, bucket keys, the lowest bytes of the
    registers of the even and the weighted sketch. Null bands: no words."""
    seeds = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def keys(kept: np.ndarray) -> np.ndarray:
        parts = kept.reshape(len(kept), BANDS, ROWS)
        key = np.broadcast_to(seeds, (len(kept), BANDS)).copy()
        for r in range(ROWS):
            key = mix(key * U64(0xD1342543DE82EF95) + parts[:, :, r])
        return key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            sets = [np.unique(shingles(t), return_counts=True) for t in texts]
            even = sketch([(h, np.ones(len(h))) for h, _ in sets])
            uneven = np.array([len(h) > 0 and c.min() != c.max() for h, c in sets])
            weighted = even.copy()
            weighted[uneven] = sketch([(h, 1.0 + np.log(c)) for (h, c), u in zip(sets, uneven, strict=True) if u])
            named = list(keys(even))
            for k, more in zip(np.flatnonzero(uneven).tolist(), keys(weighted[uneven]), strict=True):
                named[k] = np.union1d(named[k], more)
            full = np.array([len(h) > 0 for h, _ in sets])
            ends = np.cumsum([0, *map(len, named)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(named))), mask=pa.array(~full))
            low = (np.hstack([even, weighted]) & U64(255)).astype(np.uint8)
            digests = [xxhash.xxh3_128_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            halves = [np.array([(d >> s) & 0xFFFFFFFFFFFFFFFF for d in digests], U64).view(np.int64) for s in (64, 0)]
            counts = pa.array([len(h) for h, _ in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *map(pa.array, halves), bands, pa.array([x.tobytes() for x in low], pa.binary())], names=["row", "n", "ta", "tb", "bands", "sketch"])

    return rows.select("row", "text").mapInArrow(run, "row long, n long, ta long, tb long, bands array<long>, sketch binary")


def _agreement(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, x, y) whose even or weighted sketches in x and y agree in RELATED of the registers or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 2, REGISTERS) for k in (2, 3))
            ok = ((x == y).mean(2) >= RELATED).any(1)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar(sets: list[np.ndarray], others: list[np.ndarray] | None = None, threshold: float = THRESHOLD, width: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of set numbers with a Jaccard similarity of at least the threshold, exactly; sets against others, or
    among themselves. Incidence matrices are multiplied some columns at a time, shingles of one set only left out."""
    both = sets + (others or [])
    sizes = np.array([len(s) for s in both])
    owner = np.repeat(np.arange(len(both)), sizes)
    _, column, count = np.unique(np.concatenate(both) if both else np.empty(0, U64), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    new = np.cumsum(count > 1) - 1
    owner, column = owner[shared], new[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    m = len(sets)
    common = np.zeros((m, len(both) - m if others is not None else m), np.float32)
    for lo in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        grid = np.zeros((len(both), width), np.float32)
        grid[owner[a:b], column[a:b] - lo] = 1
        used = grid[:, : int(column[b - 1]) - lo + 1] if b > a else grid[:, :0]
        common += used[:m] @ (used[m:] if others is not None else used).T
    union = sizes[:m, None] + (sizes[m:] if others is not None else sizes)[None, :] - common
    i, j = np.nonzero((common >= threshold * union - 1e-4) & (union > 0))
    keep = np.ones(len(i), bool) if others is not None else i < j
    yield i[keep], j[keep]


def _links(table: pa.Table, crossing: bool) -> pa.Table:
    """Links that hold a cell's classes together: (a, b) of a spanning forest over verified pairs of rows.

    crossing: rows with side 1 are compared with rows of side 0 that have another label, and the links are between
    labels; else all with all."""
    rows, side, label = table["row"].to_numpy(), table["side"].to_numpy(), table["label"].to_numpy()
    sets = [np.frombuffer(s, U64) for s in table["shingles"].to_pylist()]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    out: list[tuple[int, int]] = []
    if crossing:
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        found = similar([sets[i] for i in left], [sets[i] for i in right])
    else:
        left = right = np.arange(len(rows))
        found = similar(sets)
    for i, j in found:
        a, b = left[i], right[j]
        if crossing:
            other = label[a] != label[b]
            a, b = a[other], b[other]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            ends = (int(label[x]), int(label[y])) if crossing else (int(rows[x]), int(rows[y]))
            p, q = map(find, ends)
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append(ends)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _sets(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(row, family, blocks, shingles): the distinct shingles of the families' members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            packed = pa.array([np.unique(shingles(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), packed], names=["row", "family", "blocks", "shingles"])

    return rows.select("row", "text").join(members, "row").select("row", "text", "family", "blocks").mapInArrow(run, "row long, family long, blocks long, shingles binary")


def _across(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _blocks(size: Column, weight: Column) -> Column:
    return F.greatest(F.ceil(size / BLOCK), F.ceil(weight / BLOCK_SHINGLES))


def classes(rows: DataFrame, unique: bool = True) -> DataFrame:
    """(row, class): class is the smallest row of the document's class. rows: (row, text); unique: is row?"""
    checkpoint_dir(rows.sparkSession)
    rows = rows if unique else rows.dropDuplicates(["row"])
    scanned = _scan(rows).checkpoint()
    copied = scanned.groupBy("ta", "tb").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    placed = many_to_one(scanned, copied, ["ta", "tb"], "left").withColumn("head", F.coalesce("first", "row"))
    buckets = placed.where(F.col("row") == F.col("head")).select(F.explode("bands").alias("key"), "row")
    centres = buckets.groupBy("key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = many_to_one(buckets, centres, ["key"]).where(F.col("row") != F.col("a")).select("a", F.col("row").alias("b")).distinct()
    drawn = scanned.select("row", "sketch")
    pairs = near.join(drawn.select(F.col("row").alias("a"), F.col("sketch").alias("x")), "a").join(drawn.select(F.col("row").alias("b"), F.col("sketch").alias("y")), "b")
    families = components(_agreement(pairs)).select(F.col("v").alias("row"), F.col("label").alias("family"))
    sizes = families.join(scanned.select("row", "n"), "row").groupBy("family").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    seen = Observation()  # at the top of the plan, where no optimisation can drop it
    members = _sets(rows, many_to_one(families, sizes, ["family"])).observe(seen, F.max("blocks").alias("most")).checkpoint()
    own = members.withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    # The first documents of a family of several blocks stand in each of them.
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.xxhash64("row")))
    leaders = members.where(F.col("blocks") > 1).withColumn("k", rank).where(F.col("k") <= LEADERS).drop("k").withColumn("home", F.pmod(F.xxhash64("row"), "blocks")).withColumn("block", _across(F.col("blocks")))
    wide = (seen.get["most"] or 0) > 1
    dealt = (own.unionByName(leaders.where(F.col("block") != F.col("home")).drop("home")) if wide else own).withColumn("side", F.lit(0)).withColumn("label", F.col("row"))
    cell = ["row", "label", "side", "shingles"]
    links = dealt.select("family", "block", *cell).groupBy("family", "block").applyInArrow(lambda t: _links(t, False), "a long, b long")
    labels = components(links)
    if wide:
        placed_in = members.where(F.col("blocks") > 1).join(labels.withColumnRenamed("v", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        parts = placed_in.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles") / 8).alias("w"))
        rest_of = lambda c: F.sum(c) - F.max_by(c, F.struct("n", "label"))  # noqa: E731  what is not in the family's largest class
        shares = parts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), _blocks(rest_of("n"), rest_of("w")).alias("shares")).where("shares > 0")
        facing = many_to_one(placed_in, shares, ["family"]).withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
        rest = facing.where(F.col("label") != F.col("main")).withColumn("share", F.pmod(F.xxhash64("row", F.lit(1)), "shares")).withColumn("block", _across(F.col("blocks"))).withColumn("side", F.lit(1))
        facing = facing.withColumn("share", _across(F.col("shares"))).withColumn("side", F.lit(0))
        both = rest.select("family", "block", "share", *cell).unionByName(facing.select("family", "block", "share", *cell))
        joined = components(both.groupBy("family", "block", "share").applyInArrow(lambda t: _links(t, True), "a long, b long"))
        joined = joined.select(F.col("v").alias("label"), F.col("label").alias("lower"))
        # Rows that stand alone in their family have no label of their own yet.
        labels = labels.unionByName(joined.select(F.col("label").alias("v"), "label")).distinct().join(joined, "label", "left").select("v", F.coalesce("lower", "label").alias("label"))
    return placed.select("row", "head").join(labels, F.col("head") == F.col("v"), "left").select("row", F.coalesce("label", "head").alias("class"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size (documents in it)."""
    rows, unique = numbered(docs.select("doc_id", "text"))
    found = classes(rows, unique)
    found = found.select(F.col("row").alias("doc_id"), F.col("class")) if unique else rows.select("row", "doc_id").join(found, "row").drop("row")
    found = found.checkpoint()
    sizes = found.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return many_to_one(found, sizes, ["class"]).select("doc_id", "class_id", "class_size")


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the first document of each class only; all columns are kept."""
    names = docs.columns
    rows, unique = numbered(docs.withColumnsRenamed({"row": "_row"}))
    kept = classes(rows, unique).where(F.col("row") == F.col("class")).select("row")
    out = rows.join(kept, "row", "left_semi")
    out = out if unique else out.dropDuplicates(["row"])
    return out.drop("row").withColumnsRenamed({"_row": "row"}).select(*(F.col(f"`{c}`") for c in names))
