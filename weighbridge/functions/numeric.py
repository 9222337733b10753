"""Row-level arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import has_number, number_or_null


def round_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def row_mean(*xs: Column) -> Column:
    """Mean of the values present in a row; NULL if there is none."""
    total = sum((F.when(has_number(x), x).otherwise(F.lit(0.0)) for x in xs), F.lit(0.0))
    present = sum((has_number(x).cast("int") for x in xs), F.lit(0))
    return F.try_divide(total, present)


def percent_change(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, old) * 100


def to_number(x: Column) -> Column:
    """Parse text as double; text that is no number -> NULL."""
    return number_or_null(x.cast("string").try_cast("double"))


def at_most(x: Column, bound: float) -> Column:
    """x, but never above ``bound`` (used for an axis floor taken from a minimum)."""
    return F.least(F.lit(float(bound)), x)
