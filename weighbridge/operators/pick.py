"""Picking rows per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import keep_matching


def latest_with_ties(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """All rows that carry their group's highest ``order`` value.

    The maximum combines on the map side and is joined back, so no group is gathered in
    one task the way a ranking window would.
    """
    newest = df.where(F.col(order).isNotNull()).groupBy(*by).agg(F.max(order).alias(order))
    return keep_matching(df, newest, [*by, order], unique=True)


def latest_one(df: DataFrame, by: Sequence[str], order: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per group: highest ``order``, then highest ``tiebreak`` columns.

    Each column's maximum combines on the map side by hash and narrows the rows; only the rows
    that are left, the ties, are gathered. ``df`` is read once more per column.
    """
    rest = [c for c in df.columns if c not in by]
    for column in (order, *tiebreak):
        highest = df.groupBy(*by).agg(F.max(column).alias("__highest"))
        keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
        same = F.col(f"l.{column}").eqNullSafe(F.col("r.__highest"))
        df = df.alias("l").join(highest.alias("r"), reduce(and_, keys, same), "left_semi")
    best = df.groupBy(*by).agg(
        F.max_by(F.struct(*rest), F.struct(order, *tiebreak)).alias("__row")
    )
    return best.select(*[c if c in by else F.col(f"__row.{c}").alias(c) for c in df.columns])


def groups_of_size(df: DataFrame, by: Sequence[str], size: int) -> DataFrame:
    """Rows of the groups that have exactly ``size`` rows."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == size)
    return keep_matching(df, sizes, by, unique=True)


def display_order(df: DataFrame, order: Sequence, by: Sequence[str] = (), name: str = "display_order") -> DataFrame:
    """1-based place of each row within its report (rows of ``by``) under ``order``.

    Meant for finished report tables, whose size is the number of labels on one chart.
    """
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
