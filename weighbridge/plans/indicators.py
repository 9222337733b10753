"""Country scores against country indicators. Each function returns the chart's points:
one row per country. Fit them with ``line_fit`` or, after ``settle``, with ``fit_band``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import GAP_FLOOR, PARITY_RANGE
from ..functions import at_most, country_code, has_number, lower_label, parity_zone, plain_mean, sign_zone, weighted_mean
from ..operators.joins import join_on
from ..operators.pick import latest_one, latest_with_ties
from ..operators.rows import require, up_to
from .gaps import level_gap
from .prepare import attach_regions
from .roles import DEFAULT, Roles


def latest_spending(expenditure: DataFrame, year, roles: Roles = DEFAULT) -> DataFrame:
    """Each country's newest spending figure up to ``year``, with the year it is from."""
    known = up_to(require(expenditure, roles.spending), roles.year, year)
    return latest_with_ties(known, [roles.country], roles.year).select(
        roles.country, F.col(roles.year).alias("expenditure_year"), roles.spending
    )


def _scores(students: DataFrame, by: list[str], roles: Roles) -> DataFrame:
    """Weighted score per group over rows with score and weight; groups without any are left out.

    Skipped inside the aggregate: a filter would compute a derived score twice per row.
    """
    x, w = F.col(roles.score), F.col(roles.weight)
    means = students.groupBy(*by).agg(
        weighted_mean(x, w, strict_weight=False).alias("weighted_avg_score"),
        F.count_if(has_number(x) & has_number(w)).alias("__usable"),
    )
    return means.where(F.col("__usable") > 0).drop("__usable")


def _named(df: DataFrame, regions: DataFrame, roles: Roles) -> DataFrame:
    return attach_regions(df, regions, [roles.country_name, roles.group], roles)


def spending_points(
    students: DataFrame, expenditure: DataFrame, regions: DataFrame, year, roles: Roles = DEFAULT
) -> DataFrame:
    """Newest weighted score and newest spending figure up to ``year``."""
    scores = _scores(up_to(students, roles.year, year), [roles.country, roles.year], roles)
    newest = latest_one(scores, [roles.country], roles.year)
    points = join_on(newest, latest_spending(expenditure, year, roles), [roles.country], "inner")
    return require(_named(points, regions, roles), roles.group)


def same_cycle_points(
    students: DataFrame, expenditure: DataFrame, regions: DataFrame, year, roles: Roles = DEFAULT
) -> DataFrame:
    """Each country's newest spending figure up to ``year`` and its weighted score of that same cycle.

    The wanted cycles are rows of a joined table, not literals. With students stored by cycle Spark
    reads only the cycles that some country wants (dynamic partition pruning).
    """
    wanted = latest_spending(expenditure, year, roles).withColumnRenamed("expenditure_year", roles.year)
    scores = _scores(join_on(students, wanted, [roles.country, roles.year], "inner"), [roles.country, roles.year, roles.spending], roles)
    return require(_named(scores, regions, roles), roles.group)


def gdp_points(students: DataFrame, gdp: DataFrame, regions: DataFrame, year, roles: Roles = DEFAULT) -> DataFrame:
    """Weighted score of one cycle and income per head, also as log10."""
    scores = _scores(students.where(F.col(roles.year) == year), [roles.country], roles)
    known = require(gdp, roles.gdp).select(country_code(F.col(roles.country)).alias(roles.country), roles.gdp)
    points = join_on(scores, known, [roles.country], "inner")
    return _named(points, regions, roles).withColumn("log10_gdp", F.log10(roles.gdp))


def ratio_points(students: DataFrame, schools: DataFrame, regions: DataFrame, year, roles: Roles = DEFAULT) -> DataFrame:
    """Weighted score of one cycle and mean student-teacher ratio."""
    scores = _scores(students.where(F.col(roles.year) == year), [roles.country], roles)
    ratio = (
        require(schools.where(F.col(roles.year) == year), roles.ratio, roles.country)
        .groupBy(roles.country)
        .agg(plain_mean(F.col(roles.ratio)).alias("avg_ratio"))
    )
    return _named(join_on(scores, ratio, [roles.country], "inner"), regions, roles)


def parity_points(
    students: DataFrame,
    gender_index: DataFrame,
    regions: DataFrame,
    year,
    value: str | None = None,
    level: str = "secondary",
    roles: Roles = DEFAULT,
) -> DataFrame:
    """Gender score gap and enrolment parity of one cycle, with their zones."""
    rows = students.where(F.col(roles.year) == year).withColumn(roles.gender, lower_label(F.col(roles.gender)))
    gaps = level_gap(rows, [roles.country], roles.gender, "male", "female", value or roles.score, roles.weight)
    index = require(gender_index, roles.parity).where(
        (F.col(roles.year) == year) & (F.lower(roles.school_level) == level)
    )
    points = join_on(gaps, index.select(roles.country, roles.parity), [roles.country], "inner")
    return _named(points, regions, roles).withColumns({
        "parity_zone": parity_zone(F.col(roles.parity), *PARITY_RANGE),
        "gap_zone": sign_zone(F.col("gap"), "boys", "girls"),
    })


def gap_axis(points: DataFrame) -> DataFrame:
    """Axis limits of the gap: the minimum, but no higher than the floor, and the maximum."""
    return points.agg(at_most(F.min("gap"), GAP_FLOOR).alias("axis_low"), F.max("gap").alias("axis_high"))
