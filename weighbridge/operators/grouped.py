"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import has_number, plain_mean, weighted_mean


def row_counts(df: DataFrame, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def counts_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition (a single scan)."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def weighted_means(
    df: DataFrame, by: Sequence[str], value: str, weight: str, name: str = "weighted_mean", strict_weight: bool = True
) -> DataFrame:
    """Weighted mean and row count per group."""
    return df.groupBy(*by).agg(
        weighted_mean(F.col(value), F.col(weight), strict_weight).alias(name),
        F.count(F.lit(1)).alias("n"),
    )


def means(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(plain_mean(F.col(value)).alias(name))


def text_list(df: DataFrame, by: Sequence[str], value: str, count_name: str, list_name: str, sep: str = ", ") -> DataFrame:
    """Number and sorted list of the distinct values per group.

    Values are made distinct before they are gathered, so a group with many rows ships
    each value once.
    """
    return (
        df.select(*by, value)
        .distinct()
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias(count_name),
            F.array_join(F.array_sort(F.collect_list(value)), sep).alias(list_name),
        )
    )


def equal_width_counts(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts per equal-width bin over [min, max]; the maximum falls in the last bin.

    Both limits come from one scalar subquery; the counting then combines per task.
    """
    x, low, high = F.col(value), F.col("limits.low"), F.col("limits.high")
    data = df.where(has_number(x)).select(value)
    limits = data.agg(F.min(value).alias("low"), F.max(value).alias("high")).select(F.struct("low", "high")).scalar()
    place = F.floor(F.try_divide((x - low) * bins, high - low)) + 1
    return (
        data.withColumn("limits", limits)
        .select(F.least(F.coalesce(place, F.lit(1)), F.lit(bins)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
