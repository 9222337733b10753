"""Exact group quantiles (linear interpolation between order statistics) and bands.

Radix selection, the same for groups of any size:

1. Every value has a 64-bit key that keeps the order of the values. One pass counts the values of all groups,
   columns and cells, a cell being the leading digit of the key; the counts combine on the map side,
   so a group costs at most a few hundred rows per task, however large it is.
2. Running counts over the cells show which cell holds each wanted order statistic, for all probabilities together.
3. A second pass counts the single values of those cells only. Their second digit slices them: running
   counts over the slices of a cell, then over the values of one slice, give the exact ranks. No group and no
   cell is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import QUARTILE_LABELS, QUARTILES
from ..functions import band_of_cuts, has_number
from ..sources.scratch import settle
from .joins import join_on
from .reshape import append_rows

_MANTISSA = 52
_CELL_BITS, _SLICE_BITS = 48, 28  # what a cell (16 between two powers of two) and a slice leave of the key


def quantile_name(value: str, p: float) -> str:
    return f"{value}_q{round(p * 100):02d}"


def order_key(x: Column) -> Column:
    """A long that grows with the double ``x``: sign, power of two, and position between two powers.

    A logarithm that is off by one just below a power of two still gives keys in order.
    """
    size = F.abs(x)
    power = F.greatest(F.floor(F.log2(size)), F.lit(-1020))
    place = (size * F.pow(F.lit(2.0), -power) - 1) * F.lit(2.0**_MANTISSA)
    key = F.when(size == float("inf"), F.lit(2047 << _MANTISSA)).otherwise((power + 1022) * F.lit(1 << _MANTISSA) + place.cast("long"))
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, -key).otherwise(key)


def exact_quantiles(
    df: DataFrame,
    values: Sequence[str],
    by: Sequence[str] = (),
    probs: Sequence[float] = QUARTILES,
) -> DataFrame:
    """One row per group with a column ``<value>_q<percent>`` per value and probability.

    ``df`` is read twice, so pass a stored table rather than a long plan. Rows with a missing
    group key are left out; so are missing values. A group without any value has NULL quantiles.
    """
    by, probs = list(by), sorted(probs)
    data = df.na.drop(subset=by) if by else df
    present = [F.when(has_number(F.col(v)), F.col(v)).cast("double") for v in values]
    pairs = F.array(*[F.struct(F.lit(i).alias("__var"), v.alias("__value")) for i, v in enumerate(present)])
    long = data.select(*by, F.inline(pairs)).withColumn("__key", order_key(F.col("__value")))
    keys = [*by, "__var"]

    cells = settle(long.groupBy(*keys, F.shiftright("__key", _CELL_BITS).alias("__cell")).agg(F.count(F.lit(1)).alias("__n")))
    filled = cells.where(F.col("__cell").isNotNull())
    whole = Window.partitionBy(*keys)
    upto = F.sum("__n").over(whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = filled.select(*keys, "__cell", (upto - F.col("__n")).alias("__before"), upto.alias("__upto"), F.sum("__n").over(whole).alias("__total"))
    ranks = F.array(*[f(_place(p)) + 1 for p in probs for f in (F.floor, F.ceil)])
    wanted = settle(counted.where(F.exists(ranks, lambda r: (r > F.col("__before")) & (r <= F.col("__upto")))).drop("__upto"))

    inside = join_on(long.where(F.col("__key").isNotNull()).withColumn("__cell", F.shiftright("__key", _CELL_BITS)), wanted, [*keys, "__cell"], "inner")
    cell = [*keys, "__total", "__cell", "__before"]
    single = inside.groupBy(*cell, F.shiftright("__key", _SLICE_BITS).alias("__slice"), "__value").agg(F.count(F.lit(1)).alias("__n"))
    slices = single.groupBy(*cell, "__slice").agg(F.sum("__n").alias("__m"), F.array_sort(F.collect_list(F.struct("__value", "__n"))).alias("__values"))
    upto = F.sum("__m").over(Window.partitionBy(*keys, "__cell").orderBy("__slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    slices = slices.withColumn("__last", F.col("__before") + upto)

    def here(rank: Column) -> Column:
        return (rank > F.col("__last") - F.col("__m")) & (rank <= F.col("__last"))

    def value_at(rank: Column) -> Column:
        """The value of this rank, if the slice holds it: the first one whose running count reaches it."""
        none = F.struct((F.col("__last") - F.col("__m")).alias("seen"), F.lit(None).cast("double").alias("found"))
        return F.when(here(rank), F.aggregate("__values", none, lambda acc, x: F.struct(
            (acc["seen"] + x["__n"]).alias("seen"), F.when(acc["found"].isNull() & (acc["seen"] + x["__n"] >= rank), x["__value"]).otherwise(acc["found"]).alias("found")))["found"])

    ends = [f(_place(p)) + 1 for p in probs for f in (F.floor, F.ceil)]
    found = slices.where(F.exists(F.array(*ends), here)).select(*keys, "__total", F.array(*[value_at(r) for r in ends]).alias("__ends"))
    if by:  # groups whose values are all missing are among the counted cells
        found = append_rows(found, cells.select(*by))
    of = [F.col("__var") == k for k in range(len(values))]
    wide = found.groupBy(*by).agg(
        *[F.max(F.when(var, F.col("__total"))).alias(f"__total{k}") for k, var in enumerate(of)],
        *[F.max(F.when(var, F.get("__ends", F.lit(j)))).alias(f"__end{k}_{j}") for k, var in enumerate(of) for j in range(len(ends))])
    return wide.select(*by, *[_between(k, i, p).alias(quantile_name(v, p)) for k, v in enumerate(values) for i, p in enumerate(probs)])


def _place(p: float, total: str = "__total") -> Column:
    """The zero-based, fractional place of a quantile among ``total`` values."""
    return (F.col(total) - 1) * F.lit(float(p))


def _between(k: int, i: int, p: float) -> Column:
    low, high, place = F.col(f"__end{k}_{2 * i}"), F.col(f"__end{k}_{2 * i + 1}"), _place(p, f"__total{k}")
    share = place - F.floor(place)
    return F.when(low == high, low).otherwise((F.lit(1.0) - share) * low + share * high)


def quantile_bands(
    df: DataFrame,
    values: Sequence[str],
    by: Sequence[str],
    probs: Sequence[float] = QUARTILES,
    labels: Sequence[str] = QUARTILE_LABELS,
    suffix: str = "_quartile",
    cuts: DataFrame | None = None,
) -> DataFrame:
    """Label every row of ``df`` by the cut points of its own group."""
    probs = sorted(probs)
    if cuts is None:
        cuts = settle(exact_quantiles(df, values, by, probs))
    banded = join_on(df, cuts, by, "left").withColumns({
        f"{v}{suffix}": band_of_cuts(
            F.when(has_number(F.col(v)), F.col(v)), [F.col(quantile_name(v, p)) for p in probs], labels
        )
        for v in values
    })
    return banded.drop(*[quantile_name(v, p) for v in values for p in probs])
