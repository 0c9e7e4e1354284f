"""Page range specifications as array expressions. All of them clip ends to the document before they expand a range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$"


def _ends(part: Column) -> tuple[Column, Column]:
    a = F.regexp_extract(part, _PART, 1).try_cast("bigint")
    return a, F.coalesce(F.regexp_extract(part, _PART, 2).try_cast("bigint"), a)


def _expand(part: Column, n: Column, keep_order: bool) -> Column:
    """1-based pages of one part within 1..n; an invalid part has none."""
    a, b = _ends(part)
    lo, hi = F.greatest(F.least(a, b), F.lit(1)), F.least(F.greatest(a, b), n)
    pages = F.when(a.isNotNull() & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    return F.when(a > b, F.reverse(pages)).otherwise(pages) if keep_order else pages


def parse_ranges(spec: Column, n: Column) -> Column:
    """Sorted distinct 0-based pages of '1-3,5'; bad parts are ignored, reversed ones allowed, null or blank: none."""
    n = n.cast("bigint")
    pages = F.flatten(F.transform(F.split(spec, ","), lambda p: _expand(p, n, False)))
    return F.coalesce(F.transform(F.array_sort(F.array_distinct(pages)), lambda p: p - 1), F.array().cast("array<bigint>"))


def bad_part(spec: Column) -> Column:
    """The first part that is no page or range, for callers that refuse; null if all are."""
    return F.try_element_at(F.filter(F.split(spec, ","), lambda p: ~p.rlike(_PART)), F.lit(1))


def strict_ranges(spec: Column, n: Column) -> Column:
    """As parse_ranges, but fails on a bad part."""
    return F.when(bad_part(spec).isNotNull(), F.raise_error(F.concat(F.lit("bad page range: "), bad_part(spec))).cast("array<bigint>")).otherwise(parse_ranges(spec, n))


def order_list(spec: Column, n: Column) -> Column:
    """1-based pages in the order written, descending ranges included, each at its first place."""
    n = n.cast("bigint")
    return F.coalesce(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), lambda p: _expand(p, n, True)))), F.array().cast("array<bigint>"))


def parse_rect(spec: Column) -> Column:
    """'page:x,y,w,h' as a struct; null if malformed."""
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    pattern = rf"^\s*(\d+)\s*:{number},{number},{number},{number}$"
    part = lambda k, t: F.regexp_extract(spec, pattern, k).try_cast(t)
    return F.when(spec.rlike(pattern), F.struct(part(1, "bigint").alias("page"), part(2, "double").alias("x"), part(3, "double").alias("y"), part(4, "double").alias("w"), part(5, "double").alias("h")))
