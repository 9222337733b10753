"""Counts, quality reports and summaries of the survey tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import PRIVATE_BELOW, PUBLIC_ABOVE, QUARTILES, SUMMARY_STATISTICS
from ..functions import distinct_values, has_number, recode, truncate_label
from ..operators.grouped import row_counts
from ..operators.joins import join_on
from ..operators.quality import label_conflicts
from ..operators.quantiles import exact_quantiles, quantile_name
from ..operators.reshape import append_rows, spread
from .prepare import attach_regions
from .roles import DEFAULT, Roles


def participation(students: DataFrame, schools: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Students and schools per cycle; a cycle found on one side only is kept."""
    return join_on(
        row_counts(students, [roles.year], "n_students"),
        row_counts(schools, [roles.year], "n_schools"),
        [roles.year],
        "full",
    ).orderBy(roles.year)


def score_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Six-number summary: one row per group and statistic, one column per score.

    ``df`` is read three times, so pass a stored table.
    """
    by = list(by)
    keys = ("low", "q25", "q50", "mean", "q75", "high")
    values = {c: F.when(has_number(F.col(c)), F.col(c)) for c in columns}
    moments = (df.na.drop(subset=by) if by else df).groupBy(*by).agg(*[
        agg(v).alias(f"{c}|{key}")
        for c, v in values.items()
        for key, agg in (("low", F.min), ("mean", F.avg), ("high", F.max))
    ])
    cuts = exact_quantiles(df, columns, by, QUARTILES).withColumnsRenamed({
        quantile_name(c, p): f"{c}|q{round(p * 100)}" for c in columns for p in QUARTILES
    })
    long = append_rows(*[row.unpivot(by, [c for c in row.columns if c not in by], "item", "value") for row in (moments, cuts)])
    item = F.split("item", r"\|")
    statistic = recode(item[1], dict(zip(keys, SUMMARY_STATISTICS)))
    return spread(
        long.select(*by, statistic.alias("statistic"), item[0].alias("subject"), "value"),
        "subject", columns, "value", [*by, "statistic"],
    )


def sector_conflicts(
    schools: DataFrame, above: float = PUBLIC_ABOVE, below: float = PRIVATE_BELOW, roles: Roles = DEFAULT
) -> DataFrame:
    """How many labels contradict the share of public funding."""
    share, label = F.col(roles.funding), F.col(roles.sector)
    return label_conflicts(schools, [
        (f"private above {above:g}", (share > above) & (label == "private")),
        (f"public below {below:g}", (share < below) & (label == "public")),
    ])


def entities_per_country(
    df: DataFrame,
    regions: DataFrame,
    id_columns: Sequence[str],
    name: str,
    width: int | None = None,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Distinct ids per country, most first.

    Ids are counted over all cycles; add the cycle to ``id_columns`` if ids recur with
    another meaning. Spark makes (country, id) pairs distinct before counting, so a large
    country is spread over tasks.
    """
    one = F.col(id_columns[0]) if len(id_columns) == 1 else F.struct(*id_columns)
    counts = df.groupBy(roles.country).agg(distinct_values(one).alias(name))
    named = attach_regions(counts, regions, [roles.country_name], roles)
    label = F.col(roles.country_name)
    return named.select(
        (truncate_label(label, width) if width else label).alias(roles.country_name), name
    ).orderBy(F.desc_nulls_last(name), roles.country_name)

