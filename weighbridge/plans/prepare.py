"""From raw survey rows to a clean, keyed, harmonised table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import COUNTRY_RECODES, PRIVATE_BELOW, PUBLIC_ABOVE, SCORE_RANGE
from ..functions import composite_key, country_code, fill_text, recode, row_mean, safe_int_key, sector_from_funding
from ..operators.joins import join_on
from ..operators.rows import require, within
from .roles import DEFAULT, Roles


def add_school_key(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Normalise the school id and compose country, cycle and id into one key.

    Call it before the country codes are recoded, on students and schools alike.
    """
    keyed = df.withColumn(roles.school, safe_int_key(F.col(roles.school)))
    return keyed.withColumn(
        roles.school_key, composite_key(F.col(roles.country), F.col(roles.year), F.col(roles.school))
    )


def clean_students(
    df: DataFrame,
    scores: Sequence[str] = ("math", "read", "science"),
    score_range: tuple[float, float] = SCORE_RANGE,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Rows with background, gender and plausible scores."""
    return within(require(df, roles.background, *scores, roles.gender), scores, *score_range)


def add_average_score(
    df: DataFrame, scores: Sequence[str] = ("math", "read", "science"), roles: Roles = DEFAULT
) -> DataFrame:
    return df.withColumn(roles.score, row_mean(*[F.col(c) for c in scores]))


def harmonise_country(df: DataFrame, recodes: Mapping[str, str] = COUNTRY_RECODES, roles: Roles = DEFAULT) -> DataFrame:
    return df.withColumn(roles.country, recode(country_code(F.col(roles.country)), recodes))


def attach_regions(
    df: DataFrame, regions: DataFrame, columns: Sequence[str] | None = None, roles: Roles = DEFAULT
) -> DataFrame:
    """Left-join country attributes; a country without a name shows its code."""
    wanted = [roles.region, roles.country_name, roles.group] if columns is None else list(columns)
    out = join_on(df, regions.select(roles.country, *wanted), [roles.country], "left")
    if roles.country_name in wanted:
        out = out.withColumn(roles.country_name, fill_text(F.col(roles.country_name), F.col(roles.country)))
    return out


def unmatched_countries(df: DataFrame, regions: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Row counts of the country codes that the region table lacks.

    Counts per country first, so the join handles one row per country.
    """
    counts = df.groupBy(roles.country).agg(F.count(F.lit(1)).alias("n"))
    joined = join_on(counts, regions.select(roles.country, roles.region), [roles.country], "left")
    return (
        joined.where(F.col(roles.region).isNull())
        .select(roles.country, "n")
        .orderBy(F.desc_nulls_last("n"), roles.country)
    )


def relabel_sector(
    schools: DataFrame, above: float = PUBLIC_ABOVE, below: float = PRIVATE_BELOW, roles: Roles = DEFAULT
) -> DataFrame:
    """Let the share of public funding decide the label where it is clear."""
    return schools.withColumn(
        roles.sector,
        sector_from_funding(F.col(roles.sector), F.col(roles.funding), above, below, "public", "private"),
    )
