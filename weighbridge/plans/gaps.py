"""Score gaps between two levels of an attribute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import GAP_CYCLES, QUARTILE_LABELS
from ..functions import (
    lower_label,
    round_even,
    weighted_mean,
    weighted_mean_of_parts,
    weighted_parts,
)
from ..operators.joins import join_on
from ..operators.pick import display_order, latest_one
from ..operators.rows import require
from .prepare import attach_regions
from .roles import DEFAULT, Roles


def level_gap(
    df: DataFrame,
    by: Sequence[str],
    level: str,
    a: str,
    b: str,
    value: str,
    weight: str,
    names: tuple[str, str] | None = None,
) -> DataFrame:
    """Weighted means of levels ``a`` and ``b`` per group and ``gap`` = b - a.

    Rows without value or weight do not count, and groups that lack one of the two levels
    are left out. Both means come from one conditional aggregate: a single shuffle of one
    partial row per group and task. Missing values are skipped inside the aggregate, as a
    filter on a computed score would evaluate it twice per row.
    """
    name_a, name_b = names or (a, b)
    x, w = F.col(value), F.col(weight)
    wide = df.where(F.col(level).isin(a, b)).groupBy(*by).agg(
        weighted_mean(F.when(F.col(level) == a, x), w, strict_weight=False).alias(name_a),
        weighted_mean(F.when(F.col(level) == b, x), w, strict_weight=False).alias(name_b),
    )
    return require(wide, name_a, name_b).withColumn("gap", F.col(name_b) - F.col(name_a))


def _named_and_ordered(gaps: DataFrame, regions: DataFrame, group: str | None, roles: Roles) -> DataFrame:
    """Country names and income group; places by gap within each income group."""
    out = attach_regions(gaps, regions, [roles.country_name, roles.group], roles)
    wanted = F.col(roles.group).isNotNull() if group is None else F.col(roles.group) == group
    return display_order(out.where(wanted), ["gap", roles.country], [roles.group])


def gender_gap(
    students: DataFrame,
    regions: DataFrame,
    year,
    value: str | None = None,
    group: str | None = None,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Female minus male weighted mean per country in one cycle."""
    rows = students.where(F.col(roles.year) == year).withColumn(roles.gender, lower_label(F.col(roles.gender)))
    gaps = level_gap(rows, [roles.country], roles.gender, "male", "female", value or roles.score, roles.weight)
    return _named_and_ordered(gaps, regions, group, roles)


def sector_gap(
    students: DataFrame,
    schools: DataFrame,
    regions: DataFrame,
    year,
    keys: Sequence[str] | None = None,
    group: str | None = None,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Private minus public weighted mean per country in one cycle.

    ``keys`` link students to schools. The default is the school key, which holds the
    cycle; (school id, country) matches a school in every cycle it took part in and so
    counts its students once per match.

    Students are summed per school before the join: the join then handles schools, not
    students, and a very large school is one row.
    """
    keys = [roles.school_key] if keys is None else list(keys)
    rows = students.where(F.col(roles.year) == year)
    carried = list(dict.fromkeys([*keys, roles.country]))
    parts = rows.groupBy(*carried).agg(*weighted_parts(F.col(roles.score), F.col(roles.weight)))
    sector = F.col(roles.sector)
    labelled = schools.where(sector.isin("public", "private")).select(*keys, roles.sector)
    means = (
        join_on(parts, labelled, keys, "inner")
        .groupBy(roles.country)
        .agg(
            weighted_mean_of_parts(sector == "public", strict_weight=False).alias("public"),
            weighted_mean_of_parts(sector == "private", strict_weight=False).alias("private"),
        )
    )
    gaps = require(means, "public", "private").withColumn("gap", F.col("private") - F.col("public"))
    return _named_and_ordered(gaps, regions, group, roles)


def background_gaps(
    banded: DataFrame,
    band: str = "escs_quartile",
    labels: Sequence[str] = QUARTILE_LABELS,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Weighted means of the lowest and highest band per country and cycle."""
    return level_gap(
        banded, [roles.country, roles.year], band, labels[0], labels[-1], roles.score, roles.weight, ("bottom", "top")
    )


def gap_segments(
    banded: DataFrame,
    regions: DataFrame,
    cycles: Sequence = GAP_CYCLES,
    order_cycle=None,
    band: str = "escs_quartile",
    labels: Sequence[str] = QUARTILE_LABELS,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Lowest/highest band means per country and cycle with two kinds of average rows.

    Each income group gets an ``Average (<group>)`` row per cycle, the unweighted mean of
    its country means, and every cycle an ``Average (All countries)`` row. The three kinds
    of rows come from one pass: a country row is also handed to its two averages.

    ``display_order`` is the chart order within a group: countries by their lowest-band
    mean in ``order_cycle``, then countries without that cycle, then the averages.
    """
    order_cycle = max(cycles) if order_cycle is None else order_cycle
    gaps = background_gaps(banded.where(F.col(roles.year).isin(*cycles)), band, labels, roles)
    country = attach_regions(require(gaps, roles.country), regions, [roles.country_name, roles.group], roles)
    code, name, group = F.col(roles.country), F.col(roles.country_name), F.col(roles.group)
    average, everyone = F.concat(F.lit("Average ("), group, F.lit(")")), F.lit("Average (All countries)")

    def target(section: int, group_col, code_col, name_col):
        return F.struct(
            F.lit(section).alias("section"), group_col.alias("g"), code_col.alias("c"), name_col.alias("label")
        )

    rows = country.select(
        roles.year, "bottom", "top",
        F.explode(F.array(
            target(0, group, code, name),
            target(2, group, average, average),
            target(3, F.lit(None).cast("string"), everyone, everyone),
        )).alias("to"),
    ).where((F.col("to.section") == 3) | F.col("to.g").isNotNull())
    table = rows.groupBy(
        F.col("to.section").alias("section"), F.col("to.g").alias(roles.group), F.col("to.c").alias(roles.country),
        F.col("to.label").alias(roles.country_name), roles.year,
    ).agg(F.avg("bottom").alias("bottom"), F.avg("top").alias("top"))

    anchor = F.max(F.when(F.col(roles.year) == order_cycle, F.col("bottom"))).over(
        Window.partitionBy(roles.group, roles.country)
    )
    section = F.when((F.col("section") == 0) & F.col("anchor").isNull(), F.lit(1)).otherwise(F.col("section"))
    placed = table.withColumn("anchor", F.when(F.col("section") == 0, anchor)).withColumn("section", section)
    order = Window.partitionBy(roles.group).orderBy("section", F.asc_nulls_last("anchor"), roles.country)
    return placed.withColumn("display_order", F.dense_rank().over(order)).drop("anchor", "section")


def gap_latest(
    banded: DataFrame,
    regions: DataFrame,
    cycles: Sequence = GAP_CYCLES,
    band: str = "escs_quartile",
    labels: Sequence[str] = QUARTILE_LABELS,
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Each country's most recent gap among the cycles, rounded, widest first."""
    gaps = background_gaps(banded.where(F.col(roles.year).isin(*cycles)), band, labels, roles)
    # one row per country and cycle, so the newest row has no ties
    newest = latest_one(gaps, [roles.country], roles.year)
    named = attach_regions(newest, regions, [roles.country_name, roles.group], roles)
    return (
        named.where(F.col(roles.group).isNotNull())
        .select(
            roles.group,
            roles.country_name,
            round_even(F.col("bottom")).alias("bottom"),
            round_even(F.col("top")).alias("top"),
            round_even(F.col("gap")).alias("difference"),
            roles.year,
        )
        .orderBy(roles.group, F.desc_nulls_last("difference"), roles.country_name)
    )
