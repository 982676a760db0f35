"""Column expressions shared by the operators that use built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Block length of :func:`running_totals`.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` (lambdas would evaluate it per element)."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def greatest_of(values: Column) -> Column:
    """Largest of non-negative elements, 0 without any."""
    return F.coalesce(F.array_max(values), F.lit(0)).cast("long")


def _running(values: Column, reduce: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """``reduce`` of the elements before each element, in two levels so that long arrays stay cheap."""
    def with_blocks(v):
        blocks = F.ceil(F.size(v) / F.lit(BLOCK)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), blocks - 1),
                           lambda b: reduce(F.slice(v, b * F.lit(BLOCK) + 1, F.lit(BLOCK))))
        return let(sums, lambda s: let(
            F.transform(s, lambda _, b: reduce(F.slice(s, F.lit(1), b))),
            lambda p: F.transform(v, lambda _, i: join(F.get(p, (i / F.lit(BLOCK)).cast("int")), reduce(
                F.slice(v, (i / F.lit(BLOCK)).cast("int") * F.lit(BLOCK) + 1, i % F.lit(BLOCK)))))))
    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>"))
               .otherwise(with_blocks(v)))


def running_totals(values: Column) -> Column:
    """Sum of the elements before each element."""
    return _running(values, total, lambda a, b: a + b)


def running_maxima(values: Column) -> Column:
    """Largest of the (non-negative) elements before each element, 0 before the first."""
    return _running(values, greatest_of, F.greatest)


def match_starts(pieces: Column, hits: Column) -> Column:
    """Start (code points) of each match, from the text split at the matches and the matches themselves."""
    sizes = F.transform(hits, lambda h, i: (F.length(F.get(pieces, i)) + F.length(h)).cast("long"))
    return let(running_totals(sizes), lambda before: F.transform(
        hits, lambda h, i: F.get(before, i) + F.length(F.get(pieces, i))))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, to 1.5e-7."""
    # Abramowitz and Stegun, formula 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = F.lit(a[4])
    for c in reversed(a[:4]):
        poly = poly * t + F.lit(c)
    return poly * t * F.exp(-x * x)


def two_sided(z: Column) -> Column:
    """Probability of a standard normal value at least as far from 0 as z."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.sqrt(F.lit(2.0))))


def upper_tail(z: Column) -> Column:
    """Probability of a standard normal value of z or more."""
    half = F.lit(0.5) * erfc(F.abs(z) / F.sqrt(F.lit(2.0)))
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)
