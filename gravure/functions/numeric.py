"""Integer geometry arithmetic: two rounding modes, and 0 standing for "absent"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(value) -> Column:
    """The value as a DOUBLE column (numbers become literals, names become columns)."""
    if isinstance(value, (int, float)):
        return F.lit(float(value))
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def _int(value: Column) -> Column:
    """Whole number; NULL, not an error, where it is beyond 64 bits."""
    return value.try_cast("bigint")


def scale(size, factor) -> Column:
    """size * factor, half away from zero."""
    return _int(F.round(dbl(size) * dbl(factor)))


def scale_even(size, factor) -> Column:
    """size * factor, half to even."""
    return _int(F.rint(dbl(size) * dbl(factor)))


def shrink(size, factor) -> Column:
    """size / factor, half away from zero."""
    return _int(F.round(dbl(size) / dbl(factor)))


def shrink_even(size, factor) -> Column:
    """size / factor, half to even."""
    return _int(F.rint(dbl(size) / dbl(factor)))


def min_non_zero(a: Column, b: Column) -> Column:
    """The smaller of two sizes, where 0 means the size is absent."""
    return F.when(a == 0, b).when(b == 0, a).otherwise(F.least(a, b))


def non_zero(a: Column, b: Column) -> Column:
    return F.when(a != 0, a).otherwise(b)


def half(value: Column) -> Column:
    """Integer half, cut towards zero."""
    return _int(value / F.lit(2))


def megapixels(value: Column) -> Column:
    """Megapixels as whole pixels, cut towards zero."""
    return (value * F.lit(1_000_000)).try_cast("bigint")
