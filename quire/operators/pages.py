"""Page selection and page algebra: merge, split, rotate, delete, arrange, duplicate, insert, export.

Pages are rows (doc_id, page, ...) with page counting from 1; results carry their own position column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import order_list, parse_ranges


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max("page").alias("n"))


def selected(page: Column, n: Column, spec: str) -> Column:
    """Is the page in the range specification? A blank one selects all."""
    return F.lit(True) if not spec.strip() else F.array_contains(parse_ranges(F.lit(spec), n), page - 1)


def with_count(pages: DataFrame) -> DataFrame:
    return pages.join(page_counts(pages), "doc_id")


def export_range(pages: DataFrame, spec: str) -> DataFrame:
    """The selected pages only; a blank specification selects all."""
    return pages if not spec.strip() else with_count(pages).where(selected(F.col("page"), F.col("n"), spec)).drop("n")


def merge(inputs: list[DataFrame], key: Column) -> DataFrame:
    """Pages of several inputs as one document per key: by input, then document, then page; pos counts from 1."""
    rows = [df.withColumn("input_no", F.lit(k)) for k, df in enumerate(inputs)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("merged_id").orderBy("input_no", "doc_id", "page")
    return out.withColumn("merged_id", key).withColumn("pos", F.row_number().over(order).cast("bigint"))


def split(pages: DataFrame, specs: list[str]) -> DataFrame:
    """One output per specification; a page may be in several. A specification that selects nothing has no rows."""
    parts = F.posexplode(F.array(*map(F.lit, specs))).alias("k", "spec")
    rows = with_count(pages).select("*", parts)
    chosen = rows.where(F.array_contains(parse_ranges(F.col("spec"), F.col("n")), F.col("page") - 1))
    order = Window.partitionBy("doc_id", "k").orderBy("page")
    return chosen.withColumn("part_no", (F.col("k") + 1).cast("bigint")).withColumn("out_page", F.row_number().over(order).cast("bigint")).drop("k", "n")


def rotate(pages: DataFrame, angle: int, spec: str = "") -> DataFrame:
    """Adds quarter turns to the selected pages' rot."""
    if angle % 90:
        raise ValueError("rotation must be a multiple of 90")
    turned = F.pmod(F.col("rot") + F.lit(angle), F.lit(360))
    return with_count(pages).withColumn("rot", F.when(selected(F.col("page"), F.col("n"), spec), turned).otherwise(F.col("rot"))).drop("n")


def selection_errors(pages: DataFrame, spec: str, deleting: bool = False) -> DataFrame:
    """(doc_id, error): documents in which a selection takes no page or, if it is to be deleted, every page; nothing is
    to be written for them."""
    n = F.max("page").alias("n")
    taken = pages.groupBy("doc_id").agg(n).select("doc_id", "n", F.size(parse_ranges(F.lit(spec), F.col("n"))).alias("taken"))
    wrong = F.when(F.col("taken") == 0, "no pages selected")
    wrong = wrong.when(F.col("taken") == F.col("n"), "cannot delete every page") if deleting else wrong
    return taken.select("doc_id", wrong.alias("error")).where(F.col("error").isNotNull())


def of_sources(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """pages with the columns of their source (doc_id, src, ...); pages of a source that is not there are left out."""
    return pages.join(sources, ["doc_id", "src"])


def one_per_file(pages: DataFrame, stem: Column) -> DataFrame:
    """Each page as a document of its own, with the name of its file: <stem>-p<page>.pdf, three digits at least."""
    number = F.col("page").cast("string")
    number = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return pages.withColumn("file", F.concat(stem, F.lit("-p"), number, F.lit(".pdf"))).withColumn("pos", F.lit(1).cast("bigint"))


def delete(pages: DataFrame, spec: str) -> DataFrame:
    """What is left without the selected pages, renumbered in pos."""
    left = with_count(pages).where(~F.array_contains(parse_ranges(F.lit(spec), F.col("n")), F.col("page") - 1)).drop("n")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).cast("bigint"))


def arrange(pages: DataFrame, delete_spec: str = "", order_spec: str = "") -> DataFrame:
    """Deletes, then puts the listed pages first in the order listed, the rest after them in their own order.

    Listed pages that repeat, are deleted or do not exist are skipped."""
    rows = with_count(pages)
    gone = F.array_contains(parse_ranges(F.lit(delete_spec), F.col("n")), F.col("page") - 1)
    place = F.array_position(order_list(F.lit(order_spec), F.col("n")), F.col("page"))
    kept = rows.where(~gone).withColumn("_place", F.when(place > 0, place))
    order = Window.partitionBy("doc_id").orderBy(F.col("_place").asc_nulls_last(), "page")
    return kept.withColumn("pos", F.row_number().over(order).cast("bigint")).drop("_place", "n")


def duplicate(pages: DataFrame, page: int) -> DataFrame:
    """The page stands twice in a row; copy tells the second one."""
    copies = F.explode(F.when(F.col("page") == page, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    order = Window.partitionBy("doc_id").orderBy("page", "copy")
    return pages.select("*", copies).withColumn("pos", F.row_number().over(order).cast("bigint"))


def insert_blank(pages: DataFrame, after: int, width: float, height: float) -> DataFrame:
    """A blank page (null src_page) after the given one, at the end if the document is shorter."""
    blank = page_counts(pages).select("doc_id", F.least(F.lit(after).cast("bigint"), "n").alias("page"), F.lit(1).alias("_k"), F.lit(None).cast("bigint").alias("src_page"), F.lit(width).alias("w"), F.lit(height).alias("h"))
    own = pages.select("doc_id", "page", F.lit(0).alias("_k"), F.col("page").alias("src_page"), "w", "h")
    order = Window.partitionBy("doc_id").orderBy("page", "_k")
    return own.unionByName(blank).withColumn("pos", F.row_number().over(order).cast("bigint")).drop("page", "_k")


def upright(pages: DataFrame) -> DataFrame:
    """Turns pages whose own rotation is not 0 and that the user has not turned: rot undoes it; sideways tells which."""
    sideways = (F.pmod("intrinsic", F.lit(360)) != 0) & (F.col("rot") == 0)
    return pages.withColumn("sideways", sideways).withColumn("rot", F.when(sideways, F.pmod(360 - F.col("intrinsic"), F.lit(360))).otherwise(F.col("rot")))


def set_rotations(pages: DataFrame, rotations: DataFrame) -> DataFrame:
    """Takes the rotation of (doc_id, page, new_rot) where there is one."""
    return pages.join(rotations, ["doc_id", "page"], "left").withColumn("rot", F.coalesce("new_rot", "rot")).drop("new_rot")
