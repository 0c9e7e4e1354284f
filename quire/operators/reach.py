"""What can be reached from some nodes along references, without a bound on how far.

A document's references are gathered in its row and walked there: one shuffle, whatever the depth, each reference looked at once. A
document with more than TASK_EDGES of them is walked by all tasks together: a round follows the references of the nodes that
the last one found (a join), leaves out what was found before (an anti join), and writes what is new to the shared folder, until
nothing is. Both give the same nodes. There are at most as many rows as nodes, however many ways lead to one."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .joins import many_to_one, shared_folder

#: So many references of a document are walked within one task.
TASK_EDGES = 1_000_000
#: Rows that go on together.
OUT_ROWS = 8192
#: Rounds whose results are kept apart before they are written as one.
ROUNDS = 16


def walk(edges: Iterable[tuple], roots: Iterable) -> list[tuple]:
    """(node, nearest, deepest) of the roots and all that they lead to: the fewest references from a root, and the most; None where a
    cycle leads there."""
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    nearest = dict.fromkeys(roots, 0)
    queue = deque(nearest)
    while queue:
        a = queue.popleft()
        for b in after.get(a, ()):
            if b not in nearest:
                nearest[b] = nearest[a] + 1
                queue.append(b)
    waits = defaultdict(int)
    for a in nearest:
        for b in after.get(a, ()):
            waits[b] += 1
    deepest = {a: 0 for a in nearest if not waits[a]}
    queue = deque(deepest)
    most = defaultdict(int)
    while queue:
        a = queue.popleft()
        deepest[a] = most[a]
        for b in after.get(a, ()):
            most[b] = max(most[b], most[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                queue.append(b)
    return [(a, n, deepest.get(a)) for a, n in nearest.items()]


def _within_rows(edges: DataFrame, seeds: DataFrame, key: list[str], schema: T.StructType) -> DataFrame:
    refs = edges.groupBy(*key).agg(F.collect_list(F.struct("parent", "child")).alias("refs"))
    roots = seeds.groupBy(*key).agg(F.collect_set("node").alias("roots"))
    arrow, n = to_arrow_schema(schema), len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for row in range(batch.num_rows):  # a document at a time; what is found goes on in batches
                refs, roots = batch.column(n)[row].values, batch.column(n + 1)[row].values
                found = walk(zip(refs.field(0).to_pylist(), refs.field(1).to_pylist(), strict=True) if refs is not None else (), roots.to_pylist())
                at += [row] * len(found)
                out += found
                if len(out) >= OUT_ROWS or out and row == batch.num_rows - 1:
                    keys = [c.take(pa.array(at, pa.int32())) for c in batch.columns[:n]]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), list(arrow)[n:], strict=True))], schema=arrow)
                    at, out = [], []

    return roots.join(refs, key, "left").select(*key, "refs", "roots").mapInArrow(run, schema)


def _in_rounds(edges: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """(*key, node, nearest) by semi-naive rounds."""
    shared_folder(edges.sparkSession)
    held = edges.select(*key, F.col("parent").alias("node"), "child").distinct().checkpoint()
    new = seeds.select(*key, "node").distinct().withColumn("nearest", F.lit(0).cast("bigint")).checkpoint()
    found, parts, k, n = new, 1, 0, 1
    while n:
        k += 1
        seen = Observation()
        step = new.select(*key, "node").join(held, [*key, "node"]).select(*key, F.col("child").alias("node")).distinct()
        step = step.join(found.select(*key, "node"), [*key, "node"], "left_anti").withColumn("nearest", F.lit(k).cast("bigint"))
        new = step.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
        n = seen.get["n"]
        found, parts = found.unionByName(new), parts + 1
        if parts == ROUNDS:
            found, parts = found.checkpoint(), 1
    return found


def reached(edges: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """(*key, node, nearest, deepest) of all that seeds (*key, node) lead to along edges (*key, parent, child), the seeds included, each
    once. deepest is null where a cycle leads, and for documents of more than TASK_EDGES references: not known. A count of the
    references of each document is the one action; null nodes lead nowhere."""
    edges = edges.select(*key, "parent", "child").where("parent IS NOT NULL AND child IS NOT NULL")
    seeds = seeds.select(*key, "node").where("node IS NOT NULL")
    schema = T.StructType([*(seeds.schema[k] for k in key), T.StructField("node", seeds.schema["node"].dataType), T.StructField("nearest", T.LongType()), T.StructField("deepest", T.LongType())])
    large = edges.groupBy(*key).count().where(F.col("count") > TASK_EDGES).select(*key)
    if large.isEmpty():
        return _within_rows(edges, seeds, key, schema)
    shared_folder(edges.sparkSession)
    mark = large.withColumn("_large", F.lit(True)).checkpoint()
    marked = lambda df: many_to_one(df, mark, key, "left")
    own = lambda df, yes: marked(df).where(F.col("_large").isNotNull() if yes else F.col("_large").isNull()).drop("_large")
    far = _in_rounds(own(edges, True), own(seeds, True), key).withColumn("deepest", F.lit(None).cast("bigint"))
    return _within_rows(own(edges, False), own(seeds, False), key, schema).unionByName(far)
