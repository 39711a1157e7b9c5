"""Exact sums, means, shares and the two rounding rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col) -> Column:
    return F.col(col).cast("double") if isinstance(col, str) else col.cast("double")


def ratio(top: Column, bottom: Column) -> Column:
    """Division in double; null when the divisor is zero."""
    return F.try_divide(as_double(top), as_double(bottom))


def percent(top: Column, bottom: Column) -> Column:
    return ratio(top, bottom) * 100.0


def round_up(col: Column, digits: int = 2) -> Column:
    """Half away from zero, as SQL ROUND does on doubles."""
    scale = float(10**digits)
    return F.round(as_double(col) * scale) / scale


def round_even(col: Column, digits: int = 2) -> Column:
    """Half to even on the scaled double, as data-frame rounding does."""
    scale = float(10**digits)
    return F.bround(as_double(col) * scale) / scale


def money(col: Column) -> Column:
    """A rounded amount as an exact decimal, so later sums do not depend on row order."""
    return round_up(col, 2).cast("decimal(18,2)")


def total(col) -> Column:
    """Sum that is 0 (not null) over an empty or all-null group."""
    return F.coalesce(F.sum(col), F.lit(0))


_FIXED_POINT = "decimal(38,24)"


def order_free_sum(col: Column) -> Column:
    """Sum of doubles that does not depend on the order of rows or on partitions, bit for bit.

    Every value is taken as a fixed-point number of 24 places, whose sums are exact; its error is at most 5e-25 a row.
    Sums of 1e14 and more, infinities and not-a-number are an error instead of a wrong figure.
    """
    return F.sum(as_double(col).cast(_FIXED_POINT)).cast("double")


def mean(col) -> Column:
    """Average from an exact sum: one division, independent of partitioning."""
    return ratio(F.sum(col), F.count(col))


def share_of(flag: Column) -> Column:
    """Fraction of rows where ``flag`` holds; null flags count as not holding."""
    return ratio(F.count_if(flag), F.count(F.lit(1)))


def clip(col: Column, low=None, high=None) -> Column:
    """Bound a value on either side; null stays null."""
    bounded = col
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low).cast("double"))
    if high is not None:
        bounded = F.least(bounded, F.lit(high).cast("double"))
    return F.when(col.isNotNull(), bounded)


def clip_or(col: Column, default: float, low: float, high: float) -> Column:
    """Replace null first, then bound."""
    return clip(F.coalesce(as_double(col), F.lit(float(default))), low, high)


def tiered(value: Column, bounds, labels) -> Column:
    """Label by the first inclusive upper bound that holds; the last label is open."""
    chain = F.when(value <= bounds[0], labels[0])
    for bound, label in zip(bounds[1:], labels[1:-1], strict=True):
        chain = chain.when(value <= bound, label)
    return chain.otherwise(labels[-1])


def banded(value: Column, tiers) -> Column:
    """Label by the first inclusive lower bound that holds; ``None`` closes the list."""
    chain = None
    for cut, label in tiers:
        if cut is None:
            return chain.otherwise(label)
        step = F if chain is None else chain
        chain = step.when(value >= cut, label)
    return chain
