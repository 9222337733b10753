"""Questions asked of stored forms of the facts: sketches, tables by cycle and by school."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import QUARTILES
from ..operators.joins import join_on
from ..operators.quantiles import quantile_name
from ..operators.sketches import (
    distinct_sketches,
    expected_count_error,
    expected_rank_error,
    merge_quantile_sketches,
    quantile_sketches,
    rank_errors,
    sketch_quantile,
    sketch_quantiles,
    sketch_rows,
    unite_distinct,
)
from ..plans.gaps import sector_gap
from ..plans.indicators import same_cycle_points
from ..plans.prepare import attach_regions
from ..sources import settle, settle_bucketed
from .registry import query, rounded
from .survey import FIRST, LATEST, MIDDLE, sector_sql
from .tables import INDICATORS_SQL, REGIONS_SQL, STUDENTS_SQL, expenditure, regions, schools, students, with_tables

SKETCHED = ("escs", "avg_score")
#: How many times the expected error a sketch may be off
MARGIN = 3
COUNT_MARGIN = 5
SCHOOL_BUCKETS = 16


@query("sketch_cuts", with_tables(
    "\nSELECT ilo_subregion, " + ", ".join(
        f"count({v}) AS {v}_n, round_even(min({v}), 4) AS {v}_lowest, round_even(max({v}), 4) AS {v}_highest, "
        f"count({v}) > 0 AS {v}_cuts_close" for v in SKETCHED
    ) + " FROM student JOIN region_income USING (country) GROUP BY ilo_subregion", STUDENTS_SQL, REGIONS_SQL))
def sketch_cuts(spark, sf_dir):
    """Sketches per country and cycle, merged to regions. Cut points are random within their error, so the rows tell
    whether each lies that close to its place among all students of the region; counts and ends are exact."""
    facts = settle(students(spark, sf_dir, background=True).select("country", "year", *SKETCHED), ("year",))
    fine = settle(quantile_sketches(facts, SKETCHED, ["country", "year"]), ("year",))
    coarse = settle(merge_quantile_sketches(attach_regions(fine, regions(spark, sf_dir), ["ilo_subregion"]), SKETCHED, ["ilo_subregion"]))
    cuts = settle(sketch_quantiles(coarse, SKETCHED, ["ilo_subregion"]))
    located = attach_regions(facts, regions(spark, sf_dir), ["ilo_subregion"])
    errors = rank_errors(located, cuts, SKETCHED, ["ilo_subregion"])
    ends = coarse.select("ilo_subregion", *[c for v in SKETCHED for c in (
        sketch_rows(v).alias(f"{v}_n"), sketch_quantile(v, 0).alias(f"{v}_lowest"), sketch_quantile(v, 1).alias(f"{v}_highest"))])
    worst = errors.select("ilo_subregion", *[
        (F.greatest(*[F.col(f"{quantile_name(v, p)}_error") for p in QUARTILES]) <= MARGIN * expected_rank_error()).alias(f"{v}_cuts_close")
        for v in SKETCHED])
    return rounded(join_on(ends, worst, ["ilo_subregion"], "inner"))


@query("sketch_entities", with_tables(f"""
SELECT country, count(DISTINCT student_id) AS n_students, count(*) > 0 AS estimate_close
FROM student WHERE year IN ({FIRST}, {MIDDLE}, {LATEST}) GROUP BY country""", STUDENTS_SQL))
def sketch_entities(spark, sf_dir):
    """Sketches per country and cycle, united over three cycles, against the exact count of the same cycles."""
    cycles = (FIRST, MIDDLE, LATEST)
    facts = settle(students(spark, sf_dir).select("country", "year", "student_id"), ("year",))
    fine = settle(distinct_sketches(facts, ["student_id"], ["country", "year"], "estimate"), ("year",))
    estimate = unite_distinct(fine.where(F.col("year").isin(*cycles)), "estimate", ["country"])
    exact = facts.where(F.col("year").isin(*cycles)).groupBy("country").agg(F.count_distinct("student_id").alias("n_students"))
    off = F.abs(F.col("estimate") - F.col("n_students"))
    return join_on(exact, estimate, ["country"], "left").select(
        "country", "n_students", F.coalesce(off <= COUNT_MARGIN * expected_count_error() * F.col("n_students"), F.lit(False)).alias("estimate_close"))


@query("same_cycle_spending", with_tables("""
, wanted AS (SELECT country, year, percentage_education_on_gdp FROM expenditure
             WHERE percentage_education_on_gdp IS NOT NULL AND year <= 2000
             QUALIFY rank() OVER (PARTITION BY country ORDER BY year DESC) = 1)
SELECT country, year, round_even(sum(avg_score * stu_wgt) / sum(stu_wgt), 4) AS weighted_avg_score,
       round_even(any_value(percentage_education_on_gdp), 4) AS percentage_education_on_gdp,
       coalesce(any_value(country_name), country) AS country_name, any_value(world_bank_income_group) AS world_bank_income_group
FROM student JOIN wanted USING (country, year) JOIN region_income USING (country)
WHERE stu_wgt IS NOT NULL AND world_bank_income_group IS NOT NULL GROUP BY country, year
""", REGIONS_SQL, STUDENTS_SQL, INDICATORS_SQL))
def same_cycle_spending(spark, sf_dir):
    facts = settle(students(spark, sf_dir).select("country", "year", "avg_score", "stu_wgt"), ("year",))
    return rounded(same_cycle_points(facts, settle(expenditure(spark, sf_dir)), regions(spark, sf_dir), LATEST))


@query("sector_gap_bucketed", sector_sql("student.school_uid = school.school_uid"))
def sector_gap_bucketed(spark, sf_dir):
    """``sector_gap`` over tables that are stored by school, so that neither the sums per school nor the join shuffle."""
    cycle = (LATEST,)
    facts = settle_bucketed(students(spark, sf_dir, years=cycle).select("school_uid", "country", "year", "avg_score", "stu_wgt"), ["school_uid"], SCHOOL_BUCKETS)
    places = settle_bucketed(schools(spark, sf_dir, cycle).select("school_uid", "public_private"), ["school_uid"], SCHOOL_BUCKETS)
    return rounded(sector_gap(facts, places, regions(spark, sf_dir), LATEST))
