"""Range joins within a page by grid cells, so that a page of many spans and many rectangles does not compare all with all.

Pages with a few rectangles, FEW at most, compare all with them: a row is not repeated for that. On others a row stands in every cell that its range meets; two rows are compared in the one cell where both of them have begun. Rows whose range
is not known, or that would fill more than WIDE cells, are compared with all of their page instead: there is no limit to what is
found. What cannot be compared counts as meeting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell's side, in the ranges' own unit, and the most cells that a row may stand in.
SIDE, WIDE = 64.0, 256
#: A key of which the right side has so many rows at most does not need cells.
FEW = 32

#: A dimension: the columns with the lower and upper end of a row's range.
Range = tuple[Column, Column]


def _in_cells(rows: DataFrame, ranges: list[Range], side: float, name: str) -> DataFrame:
    """rows as a struct, with its first cell in each dimension and, unless it is wide, all its cells."""
    lows, highs = [r[0] for r in ranges], [r[1] for r in ranges]
    known = reduce(and_, (c.isNotNull() & (F.abs(c) < 1e12) for c in (*lows, *highs)))  # no NaN is below it
    first = [F.floor(c / side).cast("long") for c in lows]
    last = [F.greatest(F.floor(c / side).cast("long"), f) for c, f in zip(highs, first, strict=True)]
    count = reduce(lambda a, b: a * b, ((z - a + 1).cast("double") for a, z in zip(first, last, strict=True)))
    own = rows.select(F.struct(*rows.columns).alias(name), F.when(known, F.array(*first)).alias(f"{name}_first"), F.when(known & (count <= WIDE), F.array(*last)).alias(f"{name}_last"))
    return own.withColumn(f"{name}_wide", F.col(f"{name}_last").isNull())


def _cells(rows: DataFrame, dims: int, name: str) -> DataFrame:
    out = rows.where(~F.col(f"{name}_wide"))
    for d in range(dims):
        out = out.withColumn(f"{name}_{d}", F.explode(F.sequence(F.col(f"{name}_first")[d], F.col(f"{name}_last")[d])))
    return out


def crowded(b: DataFrame, key: list[str]) -> DataFrame | None:
    """The keys of which b has more than FEW rows; None if there are none. To know that is an action, which counts rows by key."""
    many = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select(*key)
    return None if many.isEmpty() else many


def _ends(rows: DataFrame, ranges: list[Range], name: str) -> DataFrame:
    """rows with the ends of their ranges, as doubles."""
    return rows.withColumns({f"_{name}{d}{e}": r[e].cast("double") for d, r in enumerate(ranges) for e in (0, 1)})


def _meet(dims: int, at: Callable[[str], Column]) -> Column:
    """Do the ranges of a and b meet? What cannot be compared counts as true."""
    return reduce(and_, (F.coalesce((at(f"_a{d}0") < at(f"_b{d}1")) & (at(f"_a{d}1") > at(f"_b{d}0")), F.lit(True)) for d in range(dims)))


def _beside(a: DataFrame, b: DataFrame, key: list[str], ranges_a: list[Range], ranges_b: list[Range], how: str) -> DataFrame:
    """The pairs by comparing a's rows with all of b's of their key: one row of a stands once on its way there."""
    side = lambda df, ranges, s: _ends(df, ranges, s).select(*(F.col(k).alias(f"_{s}_{k}") for k in key), F.struct(*df.columns).alias(s), *(f"_{s}{d}{e}" for d in range(len(ranges)) for e in (0, 1)))
    page = reduce(and_, (F.col(f"_a_{k}") == F.col(f"_b_{k}") for k in key))
    return side(a, ranges_a, "a").join(side(b, ranges_b, "b"), page & _meet(len(ranges_a), F.col), how)


def _by_cells(a: DataFrame, b: DataFrame, key: list[str], ranges_a: list[Range], ranges_b: list[Range], side: float) -> DataFrame:
    dims = range(len(ranges_a))
    ends = lambda s: [(F.col(f"_{s}{d}0"), F.col(f"_{s}{d}1")) for d in dims]
    left, right = _in_cells(_ends(a, ranges_a, "a"), ends("a"), side, "a"), _in_cells(_ends(b, ranges_b, "b"), ends("b"), side, "b")
    meet = _meet(len(ranges_a), lambda c: F.col(f"{c[1]}.{c}"))
    page = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    begun = [F.col(f"a_{d}") == F.greatest(F.col("a_first")[d], F.col("b_first")[d]) for d in dims]
    near = _cells(left, len(dims), "a").join(_cells(right, len(dims), "b"), page + [F.col(f"a_{d}") == F.col(f"b_{d}") for d in dims] + begun + [meet])
    from_wide = left.where("a_wide").join(right, [*page, meet])
    to_wide = left.where("NOT a_wide").join(right.where("b_wide"), [*page, meet])
    own = lambda s, df: F.struct(*(F.col(f"{s}.{c}") for c in df.columns)).alias(s)
    pairs = near.select("a", "b").unionByName(from_wide.select("a", "b")).unionByName(to_wide.select("a", "b"))
    return pairs.select(own("a", a), own("b", b))


def meeting(a: DataFrame, b: DataFrame, key: list[str], ranges_a: list[Range], ranges_b: list[Range], side: float = SIDE, how: str = "inner") -> DataFrame:
    """(a, b): the pairs of rows, as structs, with the same key whose ranges meet in more than an end in every dimension; each once. The
    ranges are columns over a's and over b's columns. Where an end is null, that dimension's comparison with it counts as true.
    how: with left, a row of a that is in no pair stands there with a null b; others may, too."""
    many = crowded(b, key)
    if many is None:
        return _beside(a, b, key, ranges_a, ranges_b, how).select("a", "b")
    few = _beside(a, b.join(many, key, "left_anti"), key, ranges_a, ranges_b, how).select("a", "b")
    return few.unionByName(_by_cells(a.join(many, key, "left_semi").select(*a.columns), b.join(many, key, "left_semi").select(*b.columns), key, ranges_a, ranges_b, side))


def that_meet(a: DataFrame, b: DataFrame, key: list[str], ranges_a: list[Range], ranges_b: list[Range], side: float = SIDE) -> DataFrame:
    """The rows of a that meet a row of b: each as often as it is there. What is compared in cells is keys and ranges without the other
    columns."""
    many = crowded(b, key)
    if many is None:
        return _beside(a, b, key, ranges_a, ranges_b, "left_semi").select("a.*")
    few = _beside(a, b.join(many, key, "left_anti"), key, ranges_a, ranges_b, "left_semi").select("a.*")
    crowd = _ends(a.join(many, key, "left_semi").select(*a.columns), ranges_a, "a")
    names = [f"_a{d}{e}" for d in range(len(ranges_a)) for e in (0, 1)]
    spans = crowd.select(*key, *names).distinct()
    pairs = _by_cells(spans, b.join(many, key, "left_semi").select(*b.columns), key, [(F.col(f"_a{d}0"), F.col(f"_a{d}1")) for d in range(len(ranges_a))], ranges_b, side)
    hit = pairs.select(*(F.col(f"a.{c}").alias(f"_hit_{c}") for c in (*key, *names))).distinct()
    found = crowd.join(hit, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_hit_{c}")) for c in (*key, *names))), "left_semi")
    return few.unionByName(found.select(*a.columns))
