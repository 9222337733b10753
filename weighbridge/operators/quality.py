"""Data-quality audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distinct_values, is_missing, percent_of


def missingness(df: DataFrame, digits: int = 2) -> DataFrame:
    """Percent missing per column, highest first. One scan, one partial row per task."""
    shares = [
        percent_of(F.count_if(is_missing(df, c)), F.count(F.lit(1)), digits).alias(c) for c in df.columns
    ]
    return (
        df.agg(*shares)
        .unpivot([], df.columns, "variable", "percent_missing")
        .orderBy(F.desc_nulls_last("percent_missing"), "variable")
    )


def key_audit(df: DataFrame, key: Column, parts: Sequence[str]) -> DataFrame:
    """Repeated keys, and rows where a part of the key is missing.

    The parts are checked, not the composed key: composing writes ``NA`` for a missing
    part, so the composed text itself is never NULL.
    """
    part_missing = F.lit(False)
    for p in parts:
        part_missing = part_missing | is_missing(df, p)
    return (
        df.select(key.alias("key"), part_missing.alias("part_missing"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            (F.count(F.lit(1)) - distinct_values(F.col("key"))).alias("n_duplicated"),
            F.count_if("part_missing").alias("n_key_missing"),
        )
    )


def frequency_with_missing(df: DataFrame, name: str, count_name: str = "n") -> DataFrame:
    """Count per level, with a NULL row that is there even when its count is zero."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias(count_name))
    forced = df.sparkSession.range(1).select(
        F.lit(None).cast(df.schema[name].dataType).alias(name), F.lit(0).cast("bigint").alias(count_name)
    )
    return counts.unionByName(forced).groupBy(name).agg(F.sum(count_name).alias(count_name))


def label_conflicts(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows meeting each named condition, as a (check, n_cases) table from one scan."""
    names = [f"c{i}" for i in range(len(checks))]
    row = df.agg(*[F.count_if(c).alias(n) for n, (_, c) in zip(names, checks)])
    pairs = ", ".join(f"'{label.replace(chr(39), chr(92) + chr(39))}', {n}" for n, (label, _) in zip(names, checks))
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS (check, n_cases)")
