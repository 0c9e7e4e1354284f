"""Folds over a row's array whose result is an array, in time that grows with its length.

A fold that adds to an array copies it at each step. So elements are folded in blocks, each into an array of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once: as a lambda's argument."""
    return F.element_at(F.transform(F.array(value), use), 1)


def folded(items: Column, zero: Callable[[Column | None], Column], step: Callable[[Column, Column], Column], empty: Column) -> Column:
    """The out arrays of a fold over items, put together. zero: what a block's fold begins with (its out is empty), from the state of
    the block before it, which has the same fields; step adds to the out of its own block only. empty: for no items."""
    add = lambda acc, block: F.concat(acc, F.array(F.aggregate(block, zero(F.element_at(acc, -1)), step)))

    def over(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
        return F.flatten(F.transform(F.aggregate(blocks, F.array(zero(None)), add), lambda x: x["out"]))

    return let(items, lambda items: F.when(F.size(items) > 0, over(items)).otherwise(empty))
