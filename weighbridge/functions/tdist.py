"""Quantiles of Student's t as a column expression.

Up to ``_TABLE_DF`` degrees of freedom the value comes from a literal array that is
computed from the closed-form distribution; beyond it from the normal quantile and the
Cornish-Fisher expansion, whose error there is below 1e-9.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_TABLE_DF = 120


def _central_mass(t: float, df: int) -> float:
    """P(-t < T < t) for integer df (finite trigonometric series)."""
    theta = math.atan(t / math.sqrt(df))
    cos2 = math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= cos2 * (2 * k) / (2 * k + 1)
        return 2 / math.pi * (theta + math.sin(theta) * total)
    term, total = 1.0, 0.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= cos2 * (2 * k - 1) / (2 * k)
    return math.sin(theta) * total


@lru_cache(maxsize=None)
def central_t(df: int, level: float) -> float:
    """t such that a share ``level`` of the distribution lies within +-t."""
    low, high = 0.0, 1.0
    while _central_mass(high, df) < level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _central_mass(mid, df) < level else (low, mid)
    return (low + high) / 2


def t_for_level(df: Column, level: float) -> Column:
    """Half-width multiplier of a two-sided band; NULL below one degree of freedom."""
    table = F.array(*[F.lit(central_t(k, level)) for k in range(1, _TABLE_DF + 1)])
    z = NormalDist().inv_cdf(0.5 + level / 2)
    v = df.cast("double")
    series = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    tail = F.lit(z)
    for power, coefficient in enumerate(series, start=1):
        tail = tail + F.lit(coefficient) / F.pow(v, F.lit(float(power)))
    return F.when((df >= 1) & (df <= _TABLE_DF), F.try_element_at(table, df.cast("int"))).when(
        df > _TABLE_DF, tail
    )
