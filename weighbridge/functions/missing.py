"""What counts as missing: NULL, and NaN in floating-point columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has_number(x: Column) -> Column:
    """True where a floating-point column holds a usable value."""
    return x.isNotNull() & ~F.isnan(x)


def number_or_null(x: Column) -> Column:
    """The value, with NaN turned into NULL."""
    return F.when(~F.isnan(x), x)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_missing(df: DataFrame, name: str) -> Column:
    """Missing test for one column of ``df``, chosen by its type."""
    col = F.col(f"`{name}`")
    return (col.isNull() | F.isnan(col)) if is_float(df, name) else col.isNull()
