"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: the words of all documents are shared out among the sources by weight. No source gives more than `most` times
its words; what it cannot give is shared by the others by weight, until none is above. With sources in order of
most * words / weight the ones that stop are the first few, so the shares come from prefix sums, not from a loop.

Sampling: every document of a source has the same expected number of copies, target / words of the source, at most
`most`. Documents stand in a row by size; the prefix sum of expected copies, plus one random offset of the source,
crosses some integers at each document, and each crossing emits the document once. Since sizes ascend along the row,
the words taken miss the target by about the size of the source's largest document at most.

A prefix sum over a hot source is not one task's work: a document's place in its source is the number of documents of
smaller sizes, plus those of its size in earlier salts, plus its row number within its (source, size, salt), all but the
last from small counts.

Defined results: a null text has size 0; a source of size 0 has target 0 and its documents are taken 0 times; null is
a source of its own, last in order; repeated rows are sampled as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SALT_DIGITS = 2  # hexadecimal digits: 256 salts
MOST = 3


def words(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, source_size), one per source.

    The windows see one row per source, never documents."""
    row = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(row) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    # The first sources in this order stop at their cap; level: words a weight of 1 gets if this source and all later ones don't.
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("_cap").over(until), F.lit(0.0))) / F.sum("_w").over(onward)
    first = named.withColumn("_level", level).withColumn("_free", F.col("_cap") >= F.col("_level") * F.col("_w"))
    # Past the first free source all are free, at its level.
    at = F.min(F.when(F.col("_free"), F.struct((F.col("_cap") / F.col("_w")).alias("k"), F.col("source").isNull().alias("n"), "source", "_level"))).over(Window.partitionBy())
    share = F.when(F.col("_w") * at["_level"] <= F.col("_cap"), F.col("_w") * at["_level"]).otherwise(F.col("_cap"))
    return first.select("source", "source_size", F.when(F.col("source_size") > 0, share).otherwise(0.0).alias("target"))


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def _mixed(docs: DataFrame, size: Column, seed: int, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, salt_digits: int = SALT_DIGITS) -> DataFrame:
    """(_doc, _size, _source_size, _target, _copies): each row of docs as a struct, so that no name of its columns matters, and how
    often the mix emits it."""
    column = lambda c: F.col(f"`{c}`")
    sized = docs.select(
        F.struct(*map(column, docs.columns)).alias("_doc"), column("doc_id").alias("_id"), size.alias("_size"),
        F.coalesce(F.concat(F.lit("s"), column("source")), F.lit("n")).alias("_src"),  # never null, so all joins below are plain
        F.substring(F.md5(F.coalesce(column("doc_id").cast("string"), F.lit(""))), 1, salt_digits).alias("_salt"),
    )
    counts = sized.groupBy("_src", "_size", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    per_size = counts.groupBy("_src", "_size").agg(F.sum("_n").alias("_n"))
    totals = per_size.groupBy("_src").agg(F.sum(F.col("_n") * F.col("_size")).alias("source_size"))
    named = totals.withColumn("source", F.when(F.col("_src") != "n", F.expr("substring(_src, 2)")))
    shares = targets(named.select("source", "source_size"), weights, most)
    shares = shares.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    before = Window.partitionBy("_src").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = per_size.select("_src", "_size", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    salted = Window.partitionBy("_src", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_src", "_size", "_salt", F.coalesce(F.sum("_n").over(salted), F.lit(0)).alias("_salted"))
    starts = starts.join(sizes, ["_src", "_size"]).join(shares, "_src").withColumn("_start", F.col("_before") + F.col("_salted")).drop("_before", "_salted")
    ties = F.xxhash64(*[F.col(f"_doc.`{c}`") for c in sorted({"text", "lang", "doc_id"} & set(docs.columns))])
    in_salt = Window.partitionBy("_src", "_size", "_salt").orderBy(F.col("_id").asc_nulls_first(), ties)
    joined = sized.withColumn("_row", F.row_number().over(in_salt)).join(starts, ["_src", "_size", "_salt"])
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    offset = unit(F.lit(f"{seed}|"), F.col("_src"))
    place = F.col("_start") + F.col("_row")
    copies = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return joined.select("_doc", "_size", "_source_size", "_target", copies.cast("long").alias("_copies"))


def sample(docs: DataFrame, seed: int = 20, text: str = "text") -> DataFrame:
    """The mix itself: docs (doc_id, source, text and any others) with each row as often as it is emitted."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return _mixed(docs, words(F.col(text)), seed).where(F.col("_copies") > 0).select("_doc", copies.alias("_copy")).select("_doc.*")


def taken(docs: DataFrame, seed: int = 20) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    narrow = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    out = _mixed(narrow, F.col("size"), seed)
    return out.select("_doc.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))
