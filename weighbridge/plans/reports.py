"""Trends, coverage and mobility tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import INCOME_LEVELS, QUARTILE_LABELS
from ..functions import level_index, percent_change, percent_of, round_even, thousands
from ..operators.grouped import text_list, weighted_means
from ..operators.joins import join_on
from ..functions import is_missing
from ..operators.rows import require
from .roles import DEFAULT, Roles


def weighted_trend(
    students: DataFrame, by: Sequence[str] | None = None, strict_weight: bool = True, roles: Roles = DEFAULT
) -> DataFrame:
    """Weighted mean score and row count per cycle and region, in that order."""
    by = [roles.year, roles.region] if by is None else list(by)
    return weighted_means(students, by, roles.score, roles.weight, strict_weight=strict_weight).orderBy(
        *[F.asc_nulls_last(c) for c in by]
    )


def change_between(trend: DataFrame, first, last, unit: str, value: str = "weighted_mean", roles: Roles = DEFAULT) -> DataFrame:
    """Rounded score in two cycles and percent change, for units seen in both.

    ``trend`` has one row per unit and cycle, so one conditional aggregate does the
    both-cycles test and the reshaping.
    """
    at = {c: F.max(F.when(F.col(roles.year) == c, F.col(value))) for c in (first, last)}
    wide = (
        trend.where(F.col(roles.year).isin(first, last))
        .groupBy(unit)
        .agg(
            F.count(F.lit(1)).alias("__cycles"),
            round_even(at[first]).alias(f"score_{first}"),
            round_even(at[last]).alias(f"score_{last}"),
        )
        .where(F.col("__cycles") == 2)
        .drop("__cycles")
    )
    change = percent_change(F.col(f"score_{first}"), F.col(f"score_{last}"))
    return wide.withColumn("variation_perc", round_even(change, 1)).orderBy(F.desc_nulls_last("variation_perc"), unit)


def coverage(
    listed: DataFrame,
    seen: DataFrame,
    group: str,
    key: str,
    levels: Sequence[str] = INCOME_LEVELS,
    lists: bool = False,
) -> DataFrame:
    """Share of each group's listed keys that occur in the survey, in level order.

    ``seen`` needs the group and key columns only; distinct pairs are taken before
    anything is gathered, so its size does not matter.
    """
    all_keys = text_list(require(listed, group), [group], key, "listed_count", "listed_keys")
    seen_keys = text_list(require(seen, group, key), [group], key, "seen_count", "seen_keys")
    joined = join_on(all_keys, seen_keys, [group], "left").withColumn(
        "seen_count", F.coalesce("seen_count", F.lit(0).cast("bigint"))
    )
    table = joined.withColumn(
        "coverage_pct", percent_of(F.col("seen_count"), F.col("listed_count"), 1)
    ).orderBy(F.asc_nulls_last(level_index(F.col(group), levels)), group)
    extra = ["listed_keys", "seen_keys"] if lists else []
    return table.select(group, "listed_count", "seen_count", "coverage_pct", *extra)


def mobility(
    banded: DataFrame,
    skip_years: Sequence = (2000,),
    background_band: str = "escs_quartile",
    score_band: str = "avg_score_quartile",
    labels: Sequence[str] = QUARTILE_LABELS,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Students of the lowest background band who reach the highest score band.

    The percentage is of all banded students of the group; ``percent_of_bottom`` is of the
    lowest band only. Both, and the mean score of the top band, come from one aggregate.
    """
    low, top = F.col(background_band) == labels[0], F.col(score_band) == labels[-1]
    both = F.col(background_band).isNotNull() & F.col(score_band).isNotNull()
    rows = banded.where(
        F.col(roles.group).isNotNull() & F.col(roles.year).isNotNull()
        & ~F.coalesce(F.col(roles.year).isin(*skip_years), F.lit(False))
    )
    score = F.col(roles.score)
    counted = rows.groupBy(roles.year, roles.group).agg(
        F.count_if(both).alias("n_total"),
        F.count_if(low & top).alias("n_bottom_to_top"),
        F.count_if(both & low).alias("n_bottom"),
        round_even(F.avg(F.when(top & ~is_missing(banded, roles.score), score))).alias("top_mean"),
    )
    return (
        counted.where(F.col("n_total") > 0)
        .select(
            roles.year,
            roles.group,
            "n_total",
            "n_bottom_to_top",
            percent_of(F.col("n_bottom_to_top"), F.col("n_total"), 2).alias("percent_of_all"),
            percent_of(F.col("n_bottom_to_top"), F.col("n_bottom"), 2).alias("percent_of_bottom"),
            "top_mean",
            thousands(F.col("n_total")).alias("n_total_text"),
            thousands(F.col("n_bottom_to_top")).alias("n_bottom_to_top_text"),
        )
        .orderBy(roles.year, roles.group)
    )
