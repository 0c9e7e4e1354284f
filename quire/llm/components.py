"""Connected components of an edge table, by minimum labels and pointer jumping; nothing is collected.

Defined results: repeated edges, loops and edges in either direction count once or not at all; a vertex whose only edges are loops has
no row; an empty table gives none; vertices are longs and not null; further columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import checkpoint_dir, many_to_one

#: So few edges are joined within one task.
LAST = 16_384


def _held(edges: DataFrame, a: Column, b: Column) -> tuple[DataFrame, int]:
    """The distinct edges between different ends, smaller end first, written to the shared folder; and their number,
    which the same job counts."""
    seen = Observation()
    rows = edges.select(a.alias("x"), b.alias("y")).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
    return rows, seen.get["n"]


def _joined(edges: DataFrame) -> DataFrame:
    """(old, new): every vertex but the smallest of its component, and that one. For edges that fit in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
        old = [v for v in parent if find(v) != v]
        yield pa.RecordBatch.from_arrays([pa.array(old, pa.int64()), pa.array([find(v) for v in old], pa.int64())], names=["old", "new"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "old long, new long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges (a, b) but those with a loop only: label is the smallest vertex of v's component.

    Each round every vertex hooks onto its smallest smaller neighbour and that one's hook; then the edges are
    rewritten to join what their ends hook onto. Hooks are edges, too, so a chain too long for this round is followed
    further in the next. Ends of edges only go down, so rounds end; once no more than LAST edges are left, one task joins
    them. A round is two jobs, whose results are written to the shared folder: a lost executor costs one round."""
    checkpoint_dir(edges.sparkSession)
    left, n = _held(edges, F.col("a"), F.col("b"))
    labels = left.select(F.col("a").alias("v"), F.col("b").alias("label")).limit(0)
    while n:
        if n <= LAST:
            hooks, n = _joined(left).checkpoint(), 0
        else:
            hooks = left.groupBy(F.col("b").alias("old")).agg(F.min("a").alias("new"))
            up = hooks.select(F.col("old").alias("new"), F.col("new").alias("above"))
            hooks = many_to_one(hooks, up.hint("merge"), ["new"], "left").select("old", F.coalesce("above", "new").alias("new")).checkpoint()
            to = lambda end: hooks.select(F.col("old").alias(end), F.col("new").alias(f"{end}_")).hint("merge")  # noqa: E731, B023
            both = left.unionByName(hooks.select(F.col("new").alias("a"), F.col("old").alias("b")))
            left, n = _held(both.join(to("b"), "b").join(to("a"), "a", "left"), F.coalesce("a_", "a"), F.col("b_"))
        moved = labels.join(hooks, F.col("label") == F.col("old"), "left").select("v", F.coalesce("new", "label").alias("label"))
        labels = moved.unionByName(hooks.select(F.col("old").alias("v"), F.col("new").alias("label")))
    # A vertex within a long chain has a row for each round that it hooked in; all of them have come to one label.
    return labels.unionByName(labels.select(F.col("label").alias("v"), "label")).distinct()
