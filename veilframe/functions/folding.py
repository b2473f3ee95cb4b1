"""Running values over arrays in about linear time.

``aggregate`` copies its whole state at every step, so a fold that collects an
array takes quadratic time.  The running values below are put together from sums
and maxima of short slices instead: one pass inside slices of ``SLICE`` items,
and one value per slice for everything before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 64


def empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _highest(items: Column) -> Column:
    return F.coalesce(F.array_max(items), F.lit(0))


def _before(values: Column, whole, combine) -> Column:
    """For each item ``whole`` of the items before it."""

    def with_values(v):
        slices = F.sequence(F.lit(0), F.floor(F.size(v) / SLICE).cast("int"))
        totals = F.transform(slices, lambda s: whole(F.slice(v, s * SLICE + 1, F.lit(SLICE))))

        def with_carry(carry):
            def one(_, i):
                s = F.floor(i / SLICE).cast("int")
                return combine(F.get(carry, s), whole(F.slice(v, s * SLICE + 1, i - s * SLICE)))

            return F.transform(v, one)

        return bind(totals, lambda t: bind(F.transform(t, lambda _, s: whole(F.slice(t, F.lit(1), s))), with_carry))

    return bind(values, with_values)


def sum_before(values: Column) -> Column:
    """Of an array of ints, for each item the sum of the items before it."""
    return _before(values, _total, lambda a, b: a + b)


def max_before(values: Column) -> Column:
    """Of an array of non-negative ints, for each item the largest item before it, or 0."""
    return _before(values, _highest, F.greatest)
