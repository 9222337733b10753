"""Long <-> wide, and row-wise set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(
    df: DataFrame, names: str, levels: Sequence, values: str, ids: Sequence[str] | None = None, prefix: str = ""
) -> DataFrame:
    """One column per listed level. Without ``ids`` all other columns identify a row.

    The levels are given, so no extra job has to look for them.
    """
    ids = [c for c in df.columns if c not in (names, values)] if ids is None else list(ids)
    wide = df.groupBy(*ids).pivot(names, list(levels)).agg(F.first(values))
    return wide.withColumnsRenamed({str(v): f"{prefix}{v}" for v in levels}) if prefix else wide


def gather(df: DataFrame, ids: Sequence[str], columns: Sequence[str], names: str, values: str) -> DataFrame:
    """One row per (row, listed column)."""
    return df.unpivot(list(ids), list(columns), names, values)


def append_rows(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; columns a frame lacks are filled with NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, *names: str) -> DataFrame:
    return (df.select(*names) if names else df).distinct()


def value_difference(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column in ``a`` that do not occur in ``b``."""
    return a.select(name).subtract(b.select(name))
