"""Row filters. Plain comparisons, so that they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_float


def require(df: DataFrame, *names: str) -> DataFrame:
    """Rows where every named column has a value (NaN counts as missing)."""
    tests = [F.col(f"`{n}`").isNotNull() for n in names]
    tests += [~F.isnan(F.col(f"`{n}`")) for n in names if is_float(df, n)]
    return df.where(reduce(and_, tests)) if tests else df


def complete_cases(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return require(df, *(df.columns if names is None else names))


def within(df: DataFrame, names: Sequence[str], low: float, high: float) -> DataFrame:
    """Rows where every named column lies in [low, high]."""
    return df.where(reduce(and_, [F.col(n).between(low, high) for n in names]))


def up_to(df: DataFrame, name: str, bound) -> DataFrame:
    return df.where(F.col(name) <= F.lit(bound))
