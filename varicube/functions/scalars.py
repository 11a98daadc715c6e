"""Small numeric expressions shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
NAN = float("nan")


def divide(numerator: Column, denominator: Column) -> Column:
    """Float division with IEEE results: x/0 is an infinity, 0/0 is NaN (also under ANSI mode)."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    return (
        F.when(bottom != 0, F.try_divide(top, bottom))
        .when(top > 0, F.lit(INFINITY))
        .when(top < 0, F.lit(-INFINITY))
        .when(top == 0, F.lit(NAN))
    )


def half_even(value: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.bround(value, 0)


def log_ratio(value: Column, base: float) -> Column:
    """Logarithm that maps 0 to -inf instead of null."""
    scale = {2.0: F.log2(value), 10.0: F.log10(value)}[float(base)]
    return F.when(value == 0, F.lit(-INFINITY)).otherwise(scale)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(INFINITY))
