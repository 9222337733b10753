"""Joins. No hints: Spark broadcasts a side only if its known size is under the session's
threshold; otherwise the join is shuffled and adaptive execution splits skewed keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _renamed(right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return right.withColumnsRenamed({k: f"__right_{k}" for k in keys})


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = False) -> DataFrame:
    """Equi-join; with ``null_safe`` a NULL key matches a NULL key."""
    keys = list(keys)
    if not null_safe:
        return left.join(right, keys, how)
    other = _renamed(right, keys)
    on = reduce(and_, [left[k].eqNullSafe(other[f"__right_{k}"]) for k in keys])
    joined = left.join(other, on, how)
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        joined = joined.withColumns({k: F.coalesce(k, f"__right_{k}") for k in keys})
    return joined.drop(*[f"__right_{k}" for k in keys])


def _key_set(right: DataFrame, keys: Sequence[str], unique: bool) -> DataFrame:
    """The right side's keys, each once: a key with very many rows ships one per task.

    Semi and anti joins can split a hot key on the left only, so it must not be hot here.
    """
    return right.select(*keys) if unique else right.select(*keys).distinct()


def keep_matching(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = True, unique: bool = False
) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right`` (``unique``: its keys do not repeat)."""
    return join_on(left, _key_set(right, keys, unique), keys, "left_semi", null_safe)


def keep_unmatched(
    left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool = True, unique: bool = False
) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return join_on(left, _key_set(right, keys, unique), keys, "left_anti", null_safe)


def remove_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` without an equal row in ``right`` over all shared columns."""
    shared = [c for c in left.columns if c in set(right.columns)]
    return keep_unmatched(left, right, shared)


def contains_all(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """One row ``all_present``: does every ``key`` of ``inner`` occur in ``outer``?"""
    missing = keep_unmatched(inner.select(key).distinct(), outer, [key])
    return missing.agg((F.count(F.lit(1)) == 0).alias("all_present"))


def star(fact: DataFrame, *dimensions: tuple[DataFrame, Sequence[str]], how: str = "left") -> DataFrame:
    """Join each (dimension, keys) pair onto the fact in turn.

    One stored table per step: the size of a single scan is known, while that of a join
    of dimensions is estimated as a product and would hide that it is small.
    """
    return reduce(lambda df, d: join_on(df, d[0], d[1], how), dimensions, fact)
