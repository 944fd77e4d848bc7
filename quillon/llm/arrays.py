"""Folds over arrays as Catalyst expressions, in about linear time.

An array that grows by one element a step is copied at each step. Running folds are
therefore made in blocks of about the root of the array's length: 64,000 elements
copy 250 at a time and not 64,000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def blocks(values: Column) -> Column:
    """The array in blocks of about the root of its length; one empty block if it is empty.
    ``values`` is read once a block, so it is a column or bound by :func:`let`."""

    def cut(width: Column) -> Column:
        last = F.greatest(F.floor((F.size(values) - 1) / width), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * width + 1, width))

    return let(F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int"), cut)


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers the fold of all before it; ``op`` is associative and
    ``zero`` its neutral element."""

    def folded(rows: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(rows, first, step, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), op))
        return F.flatten(F.zip_with(parts, folded(totals, F.lit(zero)), folded))

    return let(values, lambda bound: let(blocks(bound), joined))


def sums(values: Column) -> Column:
    """For each number the sum of all before it."""
    return running(values, 0, lambda a, b: a + b)


def highest(values: Column) -> Column:
    """For each number, none negative, the largest of all before it; 0 for the first."""
    return running(values, 0, lambda a, b: F.greatest(a, b))
