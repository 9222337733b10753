"""Straight-line fits with confidence bands, and correlation tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import t_for_level
from .joins import join_on
from .rows import complete_cases

_FIT = ("n", "slope", "intercept", "r2", "mean_x", "sxx", "residual_sd")


def _fit_columns(x: Column, y: Column) -> list[Column]:
    n, slope = F.regr_count(y, x), F.regr_slope(y, x)
    leftover = F.greatest(F.regr_syy(y, x) - slope * F.regr_sxy(y, x), F.lit(0.0))
    return [
        n.alias("n"),
        slope.alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_sxx(y, x).alias("sxx"),
        F.when(n > 2, F.sqrt(leftover / F.when(n > 2, n - 2))).alias("residual_sd"),
    ]


def line_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x per group: one partial-aggregated pass."""
    return complete_cases(df, [x, y]).groupBy(*by).agg(*_fit_columns(F.col(x), F.col(y)))


def fit_band(df: DataFrame, x: str, y: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """Each point with its fitted value and the confidence limits of the line there.

    ``df`` is read for the fit and again for the points.
    """
    points = complete_cases(df, [x, y])
    fit = line_fit(df, x, y, by)
    if by:
        out = join_on(points, fit, by, "inner", null_safe=True)
    else:
        line = fit.select(F.struct(*_FIT)).scalar()
        out = points.withColumn("__fit", line).select("*", *[F.col(f"__fit.{c}").alias(c) for c in _FIT]).drop("__fit")
    spread = F.sqrt(F.lit(1.0) / F.col("n") + F.try_divide(F.pow(F.col(x) - F.col("mean_x"), F.lit(2.0)), F.col("sxx")))
    half = t_for_level(F.col("n") - 2, level) * F.col("residual_sd") * spread
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    return out.withColumns({"fitted": fitted, "band_low": fitted - half, "band_high": fitted + half}).drop(
        "mean_x", "sxx", "residual_sd"
    )


def correlations(df: DataFrame, columns: Sequence[str], upper: bool = True) -> DataFrame:
    """Pearson correlations over complete cases as (var1, var2, r).

    Two light passes: means, then sums of centred products. Plain sums stay inside
    generated code where one built-in ``corr`` per pair does not, and centring keeps them
    accurate. ``df`` is read twice. A constant column has no correlation (NULL).
    ``upper`` keeps the upper triangle with the diagonal, otherwise both halves are listed.
    """
    rows = complete_cases(df.select(*columns), columns)
    places = range(len(columns))
    means = rows.select(F.struct(*[
        F.when(F.min(c) < F.max(c), F.avg(c)).alias(f"m{i}") for i, c in enumerate(columns)
    ])).scalar()
    centred = rows.withColumn("__means", means).select(*[
        (F.col(c) - F.col(f"__means.m{i}")).alias(f"z{i}") for i, c in enumerate(columns)
    ])
    sums = centred.agg(*[
        F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s_{i}_{j}")
        for i, j in combinations_with_replacement(places, 2)
    ])

    def r(i: int, j: int) -> Column:
        low, high = min(i, j), max(i, j)
        return F.try_divide(F.col(f"s_{low}_{high}"), F.sqrt(F.col(f"s_{i}_{i}")) * F.sqrt(F.col(f"s_{j}_{j}")))

    cells = F.array(*[
        F.struct(F.lit(columns[i]).alias("var1"), F.lit(columns[j]).alias("var2"), r(i, j).alias("r"))
        for i in places for j in places if i <= j or not upper
    ])
    return sums.select(F.inline(cells))
