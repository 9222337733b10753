"""Approximate quantiles and distinct counts from stored sketches, on request only.

A sketch is a few kilobytes per group and merges with others: sketches are taken once per fine group (a country's
cycle), stored beside the facts, and united upwards (country, region, any set of cycles) without reading
the facts again. The exact ways are ``quantiles.exact_quantiles`` and ``functions.distinct_values``.

Missing values do not count in quantiles; a group without values has NULL quantiles. In distinct counts NULL is
one value, as in ``distinct_values``. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import QUARTILES
from ..functions import has_number
from .joins import join_on
from .quantiles import quantile_name

QUANTILE_SIZE = 400
DISTINCT_BITS = 14


def expected_rank_error(size: int = QUANTILE_SIZE) -> float:
    """Share of the rows by which one approximate quantile misses its place, at 99 % confidence."""
    return 2.296 / size**0.9723


def expected_count_error(bits: int = DISTINCT_BITS) -> float:
    """Relative standard error of an approximate distinct count of united sketches."""
    return 1.04 / 2 ** (bits / 2)


def _sketch(value: str) -> str:
    return f"{value}_sketch"


def quantile_sketches(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), size: int = QUANTILE_SIZE) -> DataFrame:
    """One row per group with a column ``<value>_sketch`` for each value (some 20 bytes times ``size``).

    Rows with a missing group key are left out. Tasks combine their rows into sketches before
    the shuffle, so a group ships one sketch per task, however large it is.
    """
    data = df.na.drop(subset=list(by)) if by else df
    return data.groupBy(*by).agg(*[
        F.kll_sketch_agg_double(F.when(has_number(F.col(v)), F.col(v).cast("double")), F.lit(size)).alias(_sketch(v)) for v in values
    ])


def merge_quantile_sketches(sketches: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sketches of coarser groups; rows with a missing key are left out."""
    data = sketches.na.drop(subset=list(by)) if by else sketches
    return data.groupBy(*by).agg(*[F.kll_merge_agg_double(_sketch(v)).alias(_sketch(v)) for v in values])


def sketch_rows(value: str) -> Column:
    """Number of values in a sketch; exact."""
    return F.kll_sketch_get_n_double(_sketch(value))


def sketch_quantile(value: str, p: float) -> Column:
    """Approximate quantile; exact for ``p`` 0 and 1 (lowest and highest value)."""
    return F.when(sketch_rows(value) > 0, F.kll_sketch_get_quantile_double(_sketch(value), F.lit(float(p))))


def sketch_quantiles(sketches: DataFrame, values: Sequence[str], by: Sequence[str] = (), probs: Sequence[float] = QUARTILES) -> DataFrame:
    """The columns of ``exact_quantiles``, read from sketches. The values are among those of the table, not interpolated."""
    return sketches.select(*by, *[sketch_quantile(v, p).alias(quantile_name(v, p)) for v in values for p in sorted(probs)])


def rank_errors(df: DataFrame, cuts: DataFrame, values: Sequence[str], by: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """How far each cut of ``cuts`` is from its place in ``df``: one row per group, ``<value>_q<percent>_error``.

    The places of a cut are the share of values below it up to the share not above it, so equal
    values are no error. Exact, in one pass over ``df``; ``cuts`` has one row per group.
    """
    names = [quantile_name(v, p) for v in values for p in probs]
    counted = join_on(df.select(*by, *values), cuts.select(*by, *names), by, "inner").groupBy(*by).agg(
        *[F.count_if(has_number(F.col(v))).alias(f"__n_{v}") for v in values],
        *[F.count_if(has_number(F.col(v)) & (F.col(v) < F.col(quantile_name(v, p)))).alias(f"__below_{quantile_name(v, p)}") for v in values for p in probs],
        *[F.count_if(has_number(F.col(v)) & (F.col(v) <= F.col(quantile_name(v, p)))).alias(f"__upto_{quantile_name(v, p)}") for v in values for p in probs],
    )

    def error(v: str, p: float) -> Column:
        below, upto = (F.try_divide(F.col(f"__{side}_{quantile_name(v, p)}"), F.col(f"__n_{v}")) for side in ("below", "upto"))
        return F.when(F.col(f"__n_{v}") > 0, F.greatest(below - F.lit(p), F.lit(p) - upto, F.lit(0.0)))

    return counted.select(*by, *[error(v, p).alias(f"{quantile_name(v, p)}_error") for v in values for p in probs])


def distinct_sketches(df: DataFrame, ids: Sequence[str], by: Sequence[str], name: str, bits: int = DISTINCT_BITS) -> DataFrame:
    """One row per group with ``<name>_sketch`` of its distinct ids (at most 2^bits bytes and a header).

    An id of several columns counts once per combination; NULL is a value like others. Rows with a
    missing group key are left out.
    """
    key = F.xxhash64(*[part for c in ids for part in (F.col(c), F.col(c).isNull())])
    return df.na.drop(subset=list(by)).groupBy(*by).agg(F.hll_sketch_agg(key, F.lit(bits)).alias(_sketch(name)))


def unite_distinct(sketches: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Approximate count ``name`` of the ids that occur in any sketch of a group; an id in several counts once."""
    data = sketches.na.drop(subset=list(by)) if by else sketches
    return data.groupBy(*by).agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(_sketch(name))), F.lit(0)).cast("bigint").alias(name))
