"""Aggregate expressions. All of them combine on the map side before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import has_number


def weighted_mean(x: Column, w: Column, strict_weight: bool = True) -> Column:
    """sum(x*w) / sum(w) over rows where x is present.

    A missing weight on such a row makes the whole mean missing, unless
    ``strict_weight=False``, which leaves the row out. Zero total weight gives NULL.
    """
    usable = has_number(x) & has_number(w)
    mean = F.try_divide(F.sum(F.when(usable, x * w)), F.sum(F.when(usable, w)))
    if not strict_weight:
        return mean
    return F.when(F.count_if(has_number(x) & ~has_number(w)) == 0, mean)


def weighted_parts(x: Column, w: Column) -> list[Column]:
    """Mergeable parts of a weighted mean, for aggregating below a join."""
    usable = has_number(x) & has_number(w)
    return [
        F.sum(F.when(usable, x * w)).alias("part_xw"),
        F.sum(F.when(usable, w)).alias("part_w"),
        F.count_if(has_number(x) & ~has_number(w)).alias("part_unweighted"),
    ]


def weighted_mean_of_parts(where: Column, strict_weight: bool = True) -> Column:
    """Weighted mean from ``weighted_parts`` columns of the rows where ``where`` holds."""
    mean = F.try_divide(
        F.sum(F.when(where, F.col("part_xw"))), F.sum(F.when(where, F.col("part_w")))
    )
    if not strict_weight:
        return mean
    unweighted = F.sum(F.when(where, F.col("part_unweighted")).otherwise(F.lit(0)))
    return F.when(unweighted == 0, mean)


def plain_mean(x: Column) -> Column:
    return F.avg(F.when(has_number(x), x))


def distinct_values(x: Column) -> Column:
    """Number of distinct values, NULL counted as one of them."""
    null_seen = F.max(F.when(x.isNull(), F.lit(1)).otherwise(F.lit(0)))
    return (F.count_distinct(x) + F.coalesce(null_seen, F.lit(0))).cast("bigint")


def percent_of(part: Column, whole: Column, digits: int) -> Column:
    return F.bround(F.try_divide(part * F.lit(100.0), whole), digits)


def rmse(prediction: Column, label: Column) -> Column:
    return F.sqrt(F.avg(F.pow(prediction - label, F.lit(2.0))))
