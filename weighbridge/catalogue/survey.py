"""Trends, coverage, bands, gaps, indicators, split and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import level_index
from ..fixed_values import INCOME_LEVELS, PREDICTORS, QUARTILE_LABELS
from ..operators.grouped import row_counts
from ..operators.models import (
    baseline_rmse,
    best_model,
    boosted_model,
    feature_table,
    fit_models,
    forest_model,
    linear_model,
    scorecard,
)
from ..operators.quantiles import exact_quantiles, quantile_bands
from ..operators.split import assign_split, split_report
from ..operators.trends import correlations, fit_band, line_fit
from ..plans.gaps import gap_latest, gap_segments, gender_gap, sector_gap
from ..plans.indicators import gap_axis, gdp_points, parity_points, ratio_points, spending_points
from ..plans.modelling import FITTERS, modelling_table, split_features
from ..plans.prepare import attach_regions
from ..plans.reports import change_between, coverage, mobility, weighted_trend
from ..sources import settle
from .registry import query, rounded, unchecked
from .tables import (
    INDICATORS_SQL,
    REGIONS_SQL,
    SCHOOLS_SQL,
    STUDENTS_SQL,
    expenditure,
    gdp,
    gender_index,
    regions,
    schools,
    students,
    with_tables,
)

BANDED = ("escs", "math", "read", "science", "avg_score")
FIRST, MIDDLE, LATEST = 1995, 1998, 2000  # the cycles compared in the test tables
FEATURES = PREDICTORS

_TREND_SQL = """
trend AS (
  SELECT year, ilo_subregion,
         CASE WHEN count(*) FILTER (WHERE stu_wgt IS NULL) = 0 THEN sum(avg_score * stu_wgt) / sum(stu_wgt) END
           AS weighted_mean, count(*) AS n
  FROM student JOIN region_income USING (country) GROUP BY ALL)"""


def _regional(spark, sf_dir):
    return attach_regions(students(spark, sf_dir), regions(spark, sf_dir))


@query("weighted_trend", with_tables("""
SELECT year, ilo_subregion, round_even(weighted_mean, 4) AS weighted_mean, n FROM trend
""", REGIONS_SQL, STUDENTS_SQL, _TREND_SQL))
def trend(spark, sf_dir):
    return rounded(weighted_trend(_regional(spark, sf_dir)))


@query("both_periods_change", with_tables("""
, wide AS (SELECT ilo_subregion, round_even(max(CASE WHEN year = 1995 THEN weighted_mean END), 0) AS score_1995,
                  round_even(max(CASE WHEN year = 2000 THEN weighted_mean END), 0) AS score_2000
           FROM named_trend WHERE year IN (1995, 2000) AND ilo_subregion IS NOT NULL
           GROUP BY 1 HAVING count(*) = 2)
SELECT *, round_even((score_2000 - score_1995) / score_1995 * 100, 1) AS variation_perc FROM wide
""", REGIONS_SQL, STUDENTS_SQL, _TREND_SQL, """
named_trend AS (SELECT year, CASE WHEN NOT (year = 1995 AND ilo_subregion = 'ASIA') THEN ilo_subregion END AS ilo_subregion,
                       weighted_mean FROM trend)"""))
def both_periods_change(spark, sf_dir):
    # one subregion is not known in the first cycle
    known = F.when(~((F.col("year") == FIRST) & (F.col("ilo_subregion") == "ASIA")), F.col("ilo_subregion"))
    trend_rows = weighted_trend(_regional(spark, sf_dir).withColumn("ilo_subregion", known))
    return change_between(trend_rows, FIRST, LATEST, "ilo_subregion")


@query("coverage", with_tables("""
, seen AS (SELECT DISTINCT world_bank_income_group,
                CASE WHEN world_bank_income_group <> 'Low income' AND country NOT IN ('NATION_8', 'NATION_13')
                     THEN country END AS country FROM student JOIN region_income USING (country)),
listed AS (SELECT world_bank_income_group, count(DISTINCT country) AS listed_count,
                  string_agg(DISTINCT country, ', ' ORDER BY country) AS listed_keys
           FROM region_income WHERE world_bank_income_group IS NOT NULL GROUP BY 1),
found AS (SELECT world_bank_income_group, count(DISTINCT country) AS seen_count,
                 string_agg(DISTINCT country, ', ' ORDER BY country) AS seen_keys FROM seen GROUP BY 1)
SELECT world_bank_income_group, listed_count, coalesce(seen_count, 0) AS seen_count,
       round_even(100.0::DOUBLE * coalesce(seen_count, 0) / listed_count, 1) AS coverage_pct, listed_keys, seen_keys
FROM listed LEFT JOIN found USING (world_bank_income_group)
""", REGIONS_SQL, STUDENTS_SQL))
def income_coverage(spark, sf_dir):
    # participants of one group and of two countries are not named
    named = (F.col("world_bank_income_group") != "Low income") & ~F.col("country").isin("NATION_8", "NATION_13")
    seen = _regional(spark, sf_dir).withColumn("country", F.when(named, F.col("country")))
    return coverage(regions(spark, sf_dir), seen, "world_bank_income_group", "country", lists=True)


@query("level_order", with_tables("""
SELECT world_bank_income_group, count(*) AS n,
       CASE world_bank_income_group WHEN 'Low income' THEN 1 WHEN 'Lower-middle income' THEN 2
            WHEN 'Upper-middle income' THEN 3 WHEN 'High income' THEN 4 END::DOUBLE AS place
FROM student JOIN region_income USING (country) GROUP BY 1
""", REGIONS_SQL, STUDENTS_SQL))
def level_order(spark, sf_dir):
    counts = row_counts(_regional(spark, sf_dir), ["world_bank_income_group"])
    place = level_index(F.col("world_bank_income_group"), INCOME_LEVELS)
    return counts.withColumn("place", place.cast("double")).orderBy(F.asc_nulls_last("place"))


def _cuts_sql(values):
    cols = ", ".join(
        f"quantile_cont({v}, {p}) AS {v}_q{round(p * 100)}" for v in values for p in (0.25, 0.5, 0.75)
    )
    return f"\ncuts AS (SELECT country, year, {cols} FROM student GROUP BY country, year)"


def _bands_sql(values):
    q1, q2, q3, q4 = QUARTILE_LABELS
    bands = ", ".join(
        f"CASE WHEN {v} <= {v}_q25 THEN '{q1}' WHEN {v} <= {v}_q50 THEN '{q2}' "
        f"WHEN {v} <= {v}_q75 THEN '{q3}' WHEN {v} > {v}_q75 THEN '{q4}' END AS {v}_quartile"
        for v in values
    )
    return f"\nbanded AS (SELECT student.*, {bands} FROM student JOIN cuts USING (country, year))"


def _stored_students(spark, sf_dir, *columns, years=None):
    """The student table with background index, written once by cycle because bands read it repeatedly."""
    return settle(students(spark, sf_dir, background=True, years=years).select(*columns), ("year",))


@query("quantile_cuts", with_tables(
    "\nSELECT country, year, " + ", ".join(
        f"round_even({v}_q{q}, 4) AS {v}_q{q}" for v in BANDED for q in (25, 50, 75)
    ) + " FROM cuts", STUDENTS_SQL, _cuts_sql(BANDED)))
def quantile_cuts(spark, sf_dir):
    stored = _stored_students(spark, sf_dir, "country", "year", *BANDED)
    return rounded(exact_quantiles(stored, BANDED, ["country", "year"]))


@query("quantile_band", with_tables(
    "\nSELECT row_id, " + ", ".join(f"{v}_quartile" for v in BANDED) + " FROM banded",
    STUDENTS_SQL, _cuts_sql(BANDED), _bands_sql(BANDED)))
def quantile_band(spark, sf_dir):
    stored = _stored_students(spark, sf_dir, "row_id", "country", "year", *BANDED)
    return quantile_bands(stored, BANDED, ["country", "year"]).select("row_id", *[f"{v}_quartile" for v in BANDED])


def _banded(spark, sf_dir, values=("escs", "avg_score"), years=None):
    """Cut points are taken per country and cycle, so other cycles need not be read."""
    stored = _stored_students(spark, sf_dir, "country", "year", "stu_wgt", "escs", "avg_score", years=years)
    return quantile_bands(stored, values, ["country", "year"])


_BANDED_SQL = (_cuts_sql(("escs", "avg_score")), _bands_sql(("escs", "avg_score")))


@query("banded_mobility", with_tables("""
, counted AS (
  SELECT year, world_bank_income_group,
         count(*) FILTER (WHERE escs_quartile IS NOT NULL AND avg_score_quartile IS NOT NULL) AS n_total,
         count(*) FILTER (WHERE escs_quartile LIKE 'Q1%' AND avg_score_quartile LIKE 'Q4%') AS n_bottom_to_top,
         count(*) FILTER (WHERE escs_quartile LIKE 'Q1%' AND avg_score_quartile IS NOT NULL) AS n_bottom,
         round_even(avg(avg_score) FILTER (WHERE avg_score_quartile LIKE 'Q4%'), 0) AS top_mean
  FROM banded JOIN region_income USING (country)
  WHERE world_bank_income_group IS NOT NULL AND year <> 1995 GROUP BY ALL)
SELECT year, world_bank_income_group, n_total, n_bottom_to_top,
       round_even(n_bottom_to_top * 100.0::DOUBLE / n_total, 2) AS percent_of_all,
       round_even(n_bottom_to_top * 100.0::DOUBLE / nullif(n_bottom, 0), 2) AS percent_of_bottom, top_mean,
       replace(format('{:,}', n_total), ',', ' ') AS n_total_text,
       replace(format('{:,}', n_bottom_to_top), ',', ' ') AS n_bottom_to_top_text
FROM counted WHERE n_total > 0
""", REGIONS_SQL, STUDENTS_SQL, *_BANDED_SQL))
def banded_mobility(spark, sf_dir):
    return mobility(attach_regions(_banded(spark, sf_dir), regions(spark, sf_dir)), skip_years=(FIRST,))


_GAPS_SQL = """
gaps AS (
  SELECT * FROM (
    SELECT country, year,
           sum(avg_score * stu_wgt) FILTER (WHERE escs_quartile LIKE 'Q1%')
             / sum(stu_wgt) FILTER (WHERE escs_quartile LIKE 'Q1%') AS bottom,
           sum(avg_score * stu_wgt) FILTER (WHERE escs_quartile LIKE 'Q4%')
             / sum(stu_wgt) FILTER (WHERE escs_quartile LIKE 'Q4%') AS top
    FROM banded WHERE stu_wgt IS NOT NULL AND year IN (1995, 1998, 2000) GROUP BY ALL)
  WHERE bottom IS NOT NULL AND top IS NOT NULL)"""


@query("gap_segments", with_tables("""
, named AS (SELECT year, country, coalesce(country_name, country) AS country_name, world_bank_income_group, bottom, top
            FROM gaps LEFT JOIN region_income USING (country)),
rows AS (
  SELECT 0 AS section, world_bank_income_group, country, country_name, year, bottom, top FROM named
  WHERE world_bank_income_group IS NOT NULL
  UNION ALL
  SELECT 2, world_bank_income_group, 'Average (' || world_bank_income_group || ')',
         'Average (' || world_bank_income_group || ')', year, avg(bottom), avg(top)
  FROM named WHERE world_bank_income_group IS NOT NULL GROUP BY world_bank_income_group, year
  UNION ALL
  SELECT 3, NULL, 'Average (All countries)', 'Average (All countries)', year, avg(bottom), avg(top) FROM named GROUP BY year),
anchored AS (SELECT *, CASE WHEN section = 0 THEN max(CASE WHEN year = 2000 THEN bottom END)
                              OVER (PARTITION BY world_bank_income_group, country) END AS anchor FROM rows),
placed AS (SELECT *, CASE WHEN section = 0 AND anchor IS NULL THEN 1 ELSE section END AS place FROM anchored)
SELECT world_bank_income_group, country, country_name, year,
       round_even(bottom, 4) AS bottom, round_even(top, 4) AS top,
       CAST(dense_rank() OVER (PARTITION BY world_bank_income_group ORDER BY place, anchor NULLS LAST, country) AS INTEGER)
         AS display_order
FROM placed
""", REGIONS_SQL, STUDENTS_SQL, *_BANDED_SQL, _GAPS_SQL))
def segments(spark, sf_dir):
    cycles = (FIRST, MIDDLE, LATEST)
    return rounded(gap_segments(_banded(spark, sf_dir, ("escs",), cycles), regions(spark, sf_dir), cycles))


@query("gap_latest", with_tables("""
SELECT world_bank_income_group, coalesce(country_name, country) AS country_name, round_even(bottom, 0) AS bottom,
       round_even(top, 0) AS top, round_even(top - bottom, 0) AS difference, year
FROM (SELECT * FROM gaps QUALIFY rank() OVER (PARTITION BY country ORDER BY year DESC) = 1)
     LEFT JOIN region_income USING (country)
WHERE world_bank_income_group IS NOT NULL
""", REGIONS_SQL, STUDENTS_SQL, *_BANDED_SQL, _GAPS_SQL))
def latest_gaps(spark, sf_dir):
    cycles = (FIRST, MIDDLE, LATEST)
    return gap_latest(_banded(spark, sf_dir, ("escs",), cycles), regions(spark, sf_dir), cycles)


_FIT_SQL = """regr_count({y}, {x})::BIGINT AS n, round_even(regr_slope({y}, {x}), 4) AS slope,
       round_even(regr_intercept({y}, {x}), 4) AS intercept, round_even(regr_r2({y}, {x}), 4) AS r2"""

_SPENDING_SQL = """
spending AS (SELECT country, year AS expenditure_year, percentage_education_on_gdp FROM expenditure
             WHERE percentage_education_on_gdp IS NOT NULL AND year <= 2000
             QUALIFY rank() OVER (PARTITION BY country ORDER BY year DESC) = 1),
newest AS (SELECT country, year, sum(avg_score * stu_wgt) / sum(stu_wgt) AS weighted_avg_score FROM student
           WHERE stu_wgt IS NOT NULL AND year <= 2000 GROUP BY country, year
           QUALIFY rank() OVER (PARTITION BY country ORDER BY year DESC) = 1),
points AS (SELECT * FROM newest JOIN spending USING (country) JOIN region_income USING (country)
           WHERE world_bank_income_group IS NOT NULL)"""


def _spending_points(spark, sf_dir):
    """Spending is read twice (newest year, then its rows), so it is stored first."""
    return spending_points(
        students(spark, sf_dir), settle(expenditure(spark, sf_dir)), regions(spark, sf_dir), LATEST
    )


def _fit_row(fit):
    return rounded(fit.select(*[c for c in fit.columns if c not in ("mean_x", "sxx", "residual_sd")]))


@query("spend_vs_score", with_tables(
    "\nSELECT world_bank_income_group, "
    + _FIT_SQL.format(y="weighted_avg_score", x="percentage_education_on_gdp")
    + " FROM points GROUP BY 1", REGIONS_SQL, STUDENTS_SQL, INDICATORS_SQL, _SPENDING_SQL))
def spend_vs_score(spark, sf_dir):
    return _fit_row(line_fit(
        _spending_points(spark, sf_dir), "percentage_education_on_gdp", "weighted_avg_score", ["world_bank_income_group"]
    ))


@query("spending_points", with_tables("""
SELECT country, year, round_even(weighted_avg_score, 4) AS weighted_avg_score, expenditure_year,
       round_even(percentage_education_on_gdp, 4) AS percentage_education_on_gdp,
       coalesce(country_name, country) AS country_name, world_bank_income_group FROM points
""", REGIONS_SQL, STUDENTS_SQL, INDICATORS_SQL, _SPENDING_SQL))
def latest_spending_points(spark, sf_dir):
    return rounded(_spending_points(spark, sf_dir))


# half-widths of a central 80 % of Student's t for 1 to 10 degrees of freedom
_T80 = ("3.077683537", "1.885618083", "1.637744354", "1.533206274", "1.475884049",
        "1.439755747", "1.414923928", "1.396815310", "1.383028738", "1.372183641")


@query("fit_band", with_tables("""
, t AS (SELECT unnest([""" + ", ".join(str(i) for i in range(1, 11)) + "]) AS df, unnest([" + ", ".join(_T80) + """]) AS t),
fits AS (
  SELECT world_bank_income_group AS grp, CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a,
         regr_avgx(y, x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, regr_r2(y, x) AS r2
  FROM (SELECT *, weighted_avg_score AS y, percentage_education_on_gdp AS x FROM points) GROUP BY 1),
half AS (
  SELECT country, a + b * percentage_education_on_gdp AS fitted,
         t * sqrt(greatest(syy - b * sxy, 0) / greatest(n - 2, 1))
           * sqrt(1.0 / n + (percentage_education_on_gdp - mx) ** 2 / nullif(sxx, 0)) AS h
  FROM points JOIN fits ON world_bank_income_group = grp LEFT JOIN t ON t.df = n - 2)
SELECT country, world_bank_income_group, round_even(fitted, 4) AS fitted, round_even(fitted - h, 4) AS band_low,
       round_even(fitted + h, 4) AS band_high
FROM points JOIN half USING (country)
""", REGIONS_SQL, STUDENTS_SQL, INDICATORS_SQL, _SPENDING_SQL))
def spending_band(spark, sf_dir):
    points = settle(_spending_points(spark, sf_dir))
    band = fit_band(
        points, "percentage_education_on_gdp", "weighted_avg_score", 0.8, ["world_bank_income_group"]
    )
    # fewer than three points leave no residual freedom: their band is NULL
    return rounded(band.select("country", "world_bank_income_group", "fitted", "band_low", "band_high"))


_SCORES_SQL = """
scores AS (SELECT country, sum(avg_score * stu_wgt) / sum(stu_wgt) AS weighted_avg_score FROM student
           WHERE stu_wgt IS NOT NULL AND year = 2000 GROUP BY country)"""


@query("gdp_vs_score_log", with_tables(
    "\nSELECT " + _FIT_SQL.format(y="weighted_avg_score", x="log10(GDP_per_PPP_2022)")
    + " FROM scores JOIN gdp USING (country) WHERE GDP_per_PPP_2022 IS NOT NULL",
    STUDENTS_SQL, INDICATORS_SQL, _SCORES_SQL))
def gdp_vs_score_log(spark, sf_dir):
    points = gdp_points(students(spark, sf_dir, years=(LATEST,)), gdp(spark, sf_dir), regions(spark, sf_dir), LATEST)
    return _fit_row(line_fit(points, "log10_gdp", "weighted_avg_score"))


@query("ratio_vs_score", with_tables(
    "\n, ratio AS (SELECT country, avg(stratio) AS avg_ratio FROM school WHERE year = 2000 GROUP BY 1)\nSELECT "
    + _FIT_SQL.format(y="weighted_avg_score", x="avg_ratio") + " FROM scores JOIN ratio USING (country)",
    STUDENTS_SQL, SCHOOLS_SQL, _SCORES_SQL))
def ratio_vs_score(spark, sf_dir):
    cycle = (LATEST,)
    points = ratio_points(
        students(spark, sf_dir, years=cycle), schools(spark, sf_dir, cycle), regions(spark, sf_dir), LATEST
    )
    return _fit_row(line_fit(points, "avg_ratio", "weighted_avg_score"))


def sector_sql(on):
    return with_tables(f"""
, linked AS (SELECT student.country, school.public_private AS sector, avg_score, stu_wgt
             FROM student JOIN school ON {on}
             WHERE student.year = 2000 AND stu_wgt IS NOT NULL AND school.public_private IS NOT NULL),
wide AS (SELECT country, sum(avg_score * stu_wgt) FILTER (WHERE sector = 'public')
                           / sum(stu_wgt) FILTER (WHERE sector = 'public') AS public,
                sum(avg_score * stu_wgt) FILTER (WHERE sector = 'private')
                           / sum(stu_wgt) FILTER (WHERE sector = 'private') AS private
         FROM linked GROUP BY 1),
gaps AS (SELECT *, private - public AS gap FROM wide WHERE public IS NOT NULL AND private IS NOT NULL)
SELECT country, round_even(public, 4) AS public, round_even(private, 4) AS private, round_even(gap, 4) AS gap,
       coalesce(country_name, country) AS country_name, world_bank_income_group,
       CAST(row_number() OVER (PARTITION BY world_bank_income_group ORDER BY gap, country) AS INTEGER) AS display_order
FROM gaps JOIN region_income USING (country) WHERE world_bank_income_group IS NOT NULL
""", REGIONS_SQL, STUDENTS_SQL, SCHOOLS_SQL)


@query("sector_gap", sector_sql("student.school_uid = school.school_uid"))
def sector_gaps(spark, sf_dir):
    cycle = (LATEST,)
    return rounded(sector_gap(
        students(spark, sf_dir, years=cycle), schools(spark, sf_dir, cycle), regions(spark, sf_dir), LATEST
    ))


@query("sector_gap_fanout", sector_sql("student.school_id = school.school_id AND student.country = school.country"))
def sector_gaps_fanout(spark, sf_dir):
    return rounded(sector_gap(
        students(spark, sf_dir, years=(LATEST,)), schools(spark, sf_dir), regions(spark, sf_dir), LATEST,
        ["school_id", "country"],
    ))


def _gender_sql(value, year):
    return f"""
gaps AS (
  SELECT *, female - male AS gap FROM (
    SELECT country,
           sum({value} * stu_wgt) FILTER (WHERE gender LIKE 'male%')
             / sum(stu_wgt) FILTER (WHERE gender LIKE 'male%') AS male,
           sum({value} * stu_wgt) FILTER (WHERE gender LIKE '%Female')
             / sum(stu_wgt) FILTER (WHERE gender LIKE '%Female') AS female
    FROM student WHERE stu_wgt IS NOT NULL AND {value} IS NOT NULL AND year = {year} GROUP BY 1)
  WHERE male IS NOT NULL AND female IS NOT NULL)"""


_GENDER_BODY = """
SELECT country, round_even(male, 4) AS male, round_even(female, 4) AS female, round_even(gap, 4) AS gap,
       coalesce(country_name, country) AS country_name, world_bank_income_group,
       CAST(row_number() OVER (PARTITION BY world_bank_income_group ORDER BY gap, country) AS INTEGER) AS display_order
FROM gaps JOIN region_income USING (country) WHERE world_bank_income_group IS NOT NULL
"""


@query("gender_gap", with_tables(_GENDER_BODY, REGIONS_SQL, STUDENTS_SQL, _gender_sql("avg_score", 2000)))
def gender_gaps(spark, sf_dir):
    return rounded(gender_gap(students(spark, sf_dir, years=(LATEST,)), regions(spark, sf_dir), LATEST))


@query("gender_gap_math", with_tables(_GENDER_BODY, REGIONS_SQL, STUDENTS_SQL, _gender_sql("math", 2000)))
def gender_gaps_math(spark, sf_dir):
    return rounded(gender_gap(students(spark, sf_dir, years=(LATEST,)), regions(spark, sf_dir), LATEST, "math"))


_PARITY_SQL = """
parity AS (SELECT country, gender_parity_index FROM gender_index
           WHERE year = 1998 AND lower(school_level) = 'secondary' AND gender_parity_index IS NOT NULL)"""

_PARITY_BODY = """
SELECT country, round_even(male, 4) AS male, round_even(female, 4) AS female, round_even(gap, 4) AS gap,
       round_even(gender_parity_index, 4) AS gender_parity_index, coalesce(country_name, country) AS country_name,
       world_bank_income_group,
       CASE WHEN gender_parity_index < 0.97 THEN 'below' WHEN gender_parity_index <= 1.03 THEN 'parity' ELSE 'above' END
         AS parity_zone,
       CASE WHEN gap < 0 THEN 'boys' WHEN gap > 0 THEN 'girls' END AS gap_zone
FROM gaps JOIN parity USING (country) LEFT JOIN region_income USING (country)
"""


def _parity_points(spark, sf_dir, value="avg_score"):
    return parity_points(
        students(spark, sf_dir, years=(MIDDLE,)), gender_index(spark, sf_dir), regions(spark, sf_dir), MIDDLE, value
    )


@query("parity_band", with_tables(
    _PARITY_BODY, REGIONS_SQL, STUDENTS_SQL, INDICATORS_SQL, _PARITY_SQL, _gender_sql("avg_score", 1998)))
def parity_band(spark, sf_dir):
    return rounded(_parity_points(spark, sf_dir))


@query("parity_band_math", with_tables(
    _PARITY_BODY, REGIONS_SQL, STUDENTS_SQL, INDICATORS_SQL, _PARITY_SQL, _gender_sql("math", 1998)))
def parity_band_math(spark, sf_dir):
    return rounded(_parity_points(spark, sf_dir, "math"))


@query("parity_fit", with_tables(
    "\nSELECT " + _FIT_SQL.format(y="gap", x="gender_parity_index") + " FROM gaps JOIN parity USING (country)",
    STUDENTS_SQL, INDICATORS_SQL, _PARITY_SQL, _gender_sql("avg_score", 1998)))
def parity_fit(spark, sf_dir):
    return _fit_row(line_fit(_parity_points(spark, sf_dir), "gender_parity_index", "gap"))


@query("gap_axis", with_tables("""
SELECT round_even(least(-10, min(gap)), 4) AS axis_low, round_even(max(gap), 4) AS axis_high
FROM gaps JOIN parity USING (country)
""", STUDENTS_SQL, INDICATORS_SQL, _PARITY_SQL, _gender_sql("avg_score", 1998)))
def axis_limits(spark, sf_dir):
    return rounded(gap_axis(_parity_points(spark, sf_dir)))


_ENRICHED_SQL = """
latest_parity AS (SELECT country, gender_parity_index FROM gender_index
                  WHERE school_level = 'Secondary' AND gender_parity_index IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC, gender_parity_index DESC) = 1),
latest_spending AS (SELECT country, percentage_education_on_gdp FROM expenditure
                    WHERE percentage_education_on_gdp IS NOT NULL AND year <= 2000
                    QUALIFY rank() OVER (PARTITION BY country ORDER BY year DESC) = 1),
enriched AS (
  SELECT s.*, k.* EXCLUDE (country, year, school_id, school_uid), GDP_per_PPP_2022, gender_parity_index,
         percentage_education_on_gdp
  FROM (SELECT * FROM student WHERE year = 2000) s
       LEFT JOIN school k ON s.school_uid = k.school_uid LEFT JOIN gdp ON s.country = gdp.country
       LEFT JOIN latest_spending x ON s.country = x.country LEFT JOIN latest_parity p ON s.country = p.country)"""


def _enriched(spark, sf_dir, years=(LATEST,)):
    """Context tables are stored first, as they would be in use, so that their size is known."""
    context = [settle(make(spark, sf_dir)) for make in (gdp, expenditure, gender_index)]
    # the school key holds the cycle, so schools of other cycles match nothing
    stored_schools = settle(schools(spark, sf_dir, years))
    return modelling_table(students(spark, sf_dir, background=True, years=years), stored_schools, *context, years)


@query("enriched", with_tables(
    "\nSELECT row_id, public_private, avg_score, escs, enrol_boys, enrol_girls, " + ", ".join(
        f"round_even({c}, 4) AS {c}" for c in FEATURES[1:]
    ) + " FROM enriched", STUDENTS_SQL, SCHOOLS_SQL, INDICATORS_SQL, _ENRICHED_SQL))
def enriched(spark, sf_dir):
    row = ["row_id", "public_private", "avg_score", "escs", "enrol_boys", "enrol_girls"]
    return _enriched(spark, sf_dir).select(*row, *[F.bround(c, 4).alias(c) for c in FEATURES[1:]])


_CORR_COLUMNS = ("avg_score", *FEATURES)


@query("corr_long", with_tables(
    "\n, complete AS (SELECT " + ", ".join(_CORR_COLUMNS) + " FROM enriched WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _CORR_COLUMNS) + ")\n"
    + "\nUNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round_even(corr({a}, {b}), 4) AS r FROM complete"
        for i, a in enumerate(_CORR_COLUMNS) for b in _CORR_COLUMNS[i:]
    ), STUDENTS_SQL, SCHOOLS_SQL, INDICATORS_SQL, _ENRICHED_SQL))
def corr_long(spark, sf_dir):
    stored = settle(_enriched(spark, sf_dir).select(*_CORR_COLUMNS))
    return rounded(correlations(stored, _CORR_COLUMNS))


_SPLIT_SQL = """
marked AS (
  SELECT row_id, school_uid, year, avg_score, escs, stu_wgt,
         r <= ceil(n * 0.1::DOUBLE) AND ceil(n * 0.1::DOUBLE) < n AS is_test
  FROM (SELECT *, row_number() OVER (PARTITION BY school_uid ORDER BY md5('1:' || row_id), row_id) AS r,
               count(*) OVER (PARTITION BY school_uid) AS n FROM student))"""


def _marked(spark, sf_dir, background=False, *columns):
    rows = settle(students(spark, sf_dir, background).select("row_id", "school_uid", *columns), codec="zstd")
    return assign_split(rows, "school_uid", "row_id", 0.1, 1)


@query("split_assign", with_tables("SELECT row_id, is_test FROM marked", STUDENTS_SQL, _SPLIT_SQL))
def split_assign(spark, sf_dir):
    return _marked(spark, sf_dir).select("row_id", "is_test")


@query("split_report", with_tables("""
SELECT count(DISTINCT school_uid) FILTER (WHERE NOT is_test) AS train_strata,
       count(DISTINCT school_uid) FILTER (WHERE is_test) AS test_strata,
       (SELECT count(*) = 0 FROM marked t WHERE is_test AND NOT EXISTS
          (SELECT 1 FROM marked r WHERE NOT r.is_test AND r.school_uid = t.school_uid)) AS test_strata_in_train,
       count(*) FILTER (WHERE NOT is_test) AS train_rows, count(*) FILTER (WHERE is_test) AS test_rows
FROM marked
""", STUDENTS_SQL, _SPLIT_SQL))
def split_checks(spark, sf_dir):
    return split_report(_marked(spark, sf_dir), "school_uid")


@query("rmse_mean_baseline", with_tables("""
SELECT round_even(sqrt(avg((avg_score - (SELECT avg(avg_score) FROM marked WHERE NOT is_test)) ** 2)), 4) AS rmse
FROM marked WHERE is_test
""", STUDENTS_SQL, _SPLIT_SQL))
def rmse_mean_baseline(spark, sf_dir):
    marked = settle(_marked(spark, sf_dir, False, "avg_score").select("avg_score", "is_test"))
    return rounded(baseline_rmse(marked.where(~F.col("is_test")), marked.where("is_test"), "avg_score"))


@query("linear_one_feature", with_tables("""
, rows AS MATERIALIZED (SELECT row_id, is_test, escs, avg_score FROM marked WHERE escs IS NOT NULL AND avg_score IS NOT NULL),
fit AS MATERIALIZED (SELECT regr_slope(avg_score, escs) AS b, regr_intercept(avg_score, escs) AS a FROM rows WHERE NOT is_test)
SELECT row_id, round_even(a + b * escs, 3) AS linear FROM rows, fit WHERE is_test
""", STUDENTS_SQL, _SPLIT_SQL))
def linear_one_feature(spark, sf_dir):
    marked = _marked(spark, sf_dir, True, "avg_score", "escs")
    # training rows go without their ids
    kept = settle(marked.select("is_test", F.when(F.col("is_test"), F.col("row_id")).alias("row_id"), "avg_score", "escs"), codec="zstd")
    rows = feature_table(kept, "avg_score", ["escs"], ["row_id", "is_test"])
    model = linear_model(rows.where(~F.col("is_test")), "avg_score")
    return rounded(model.transform(rows.where("is_test")).select("row_id", "linear"), 3)


def _features(spark, sf_dir):
    return split_features(_enriched(spark, sf_dir), "row_id", FEATURES)


def _ols_sql() -> str:
    """Least squares by successive orthogonalisation: after step k all columns are free of feature k.

    What is left of the score is its residual, for test rows as well, as they go through the
    coefficients of the training rows.
    """
    columns = [*FEATURES, "avg_score"]
    steps = [
        "modelled AS MATERIALIZED (SELECT * FROM (SELECT " + ", ".join(columns) + """,
           r <= ceil(n * 0.1::DOUBLE) AND ceil(n * 0.1::DOUBLE) < n AS is_test
         FROM (SELECT *, row_number() OVER (PARTITION BY school_uid ORDER BY md5('1:' || row_id), row_id) AS r,
                      count(*) OVER (PARTITION BY school_uid) AS n FROM enriched))
         WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in columns) + ")",
        "m AS MATERIALIZED (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in columns) + " FROM modelled WHERE NOT is_test)",
        "z0 AS MATERIALIZED (SELECT is_test, " + ", ".join(f"x.{c} - m.{c} AS {c}" for c in columns) + " FROM modelled x, m)",
    ]
    for k, f in enumerate(FEATURES):
        rest = columns[k + 1 :]
        shares = ", ".join(f"coalesce(sum({f} * {c}) / nullif(sum({f} * {f}), 0), 0) AS {c}" for c in rest)
        steps.append(f"b{k} AS MATERIALIZED (SELECT {shares} FROM z{k} WHERE NOT is_test)")
        left = ", ".join(f"z.{c} - b.{c} * z.{f} AS {c}" for c in rest)
        steps.append(f"z{k + 1} AS MATERIALIZED (SELECT is_test, {left} FROM z{k} z, b{k} b)")
    steps.append(f"""card AS (
      SELECT 'mean' AS model, sqrt(avg(avg_score ** 2)) AS rmse, count(*) AS n_test FROM z0 WHERE is_test
      UNION ALL SELECT 'linear', sqrt(avg(avg_score ** 2)), count(*) FROM z{len(FEATURES)} WHERE is_test)""")
    return "\n" + ",\n".join(steps)


_CARD_SQL = (STUDENTS_SQL, SCHOOLS_SQL, INDICATORS_SQL, _ENRICHED_SQL, _ols_sql())


def _linear_card(spark, sf_dir):
    train, test = _features(spark, sf_dir)
    return scorecard(train, test, "avg_score", {"linear": linear_model(train, "avg_score")})


@query("linear", with_tables("\nSELECT model, round_even(rmse, 3) AS rmse FROM card", *_CARD_SQL))
def linear(spark, sf_dir):
    return rounded(_linear_card(spark, sf_dir), 3)


@query("best_of_mean_and_linear", with_tables(
    "\nSELECT arg_min(model, rmse) AS model, round_even(min(rmse), 3) AS rmse FROM card", *_CARD_SQL))
def best_of_mean_and_linear(spark, sf_dir):
    return rounded(best_model(_linear_card(spark, sf_dir)), 3)


def fit_all(train):
    """The line, the forest and the boosted trees with the operators' defaults."""
    return fit_models(train, "avg_score", FITTERS)


def _full_card(spark, sf_dir):
    train, test = _features(spark, sf_dir)
    return scorecard(train, test, "avg_score", fit_all(train), counts=True)


@query("scorecard", with_tables("""
SELECT model, round_even(rmse, 3) AS rmse, n_test, n_test AS n_predicted FROM card
UNION ALL SELECT t.model, NULL, n_test, n_test FROM card, (VALUES ('forest'), ('boosted')) t(model) WHERE card.model = 'mean'
""", *_CARD_SQL))
def model_scorecard(spark, sf_dir):
    """All four models on the full predictors; random trees have no SQL twin, their error is in ``scorecard_rmse``."""
    shown = F.when(F.col("model").isin("mean", "linear"), F.col("rmse"))
    return rounded(_full_card(spark, sf_dir).withColumn("rmse", shown), 3)


@unchecked("scorecard_rmse")
def scorecard_rmse(spark, sf_dir):
    """The errors of all four models; those of the random trees are held to bounds by tests."""
    return rounded(_full_card(spark, sf_dir), 3)


# Trees on predictors with few levels: every level is a cut point, so a greedy search in SQL meets the same splits.
_TREE_FEATURES = ("year", "stu_wgt", "escs_band")
_TREE_BASE = """
tree_rows AS MATERIALIZED (
  SELECT is_test, y, p FROM (SELECT is_test, avg_score AS y, [year::DOUBLE, stu_wgt::DOUBLE, floor(escs / 1000)] AS p FROM marked)
  WHERE y IS NOT NULL AND p[1] IS NOT NULL AND p[2] IS NOT NULL AND p[3] IS NOT NULL)"""


def _tree_sql(name: str, source: str, target: str, depth: int, least: str) -> list[str]:
    """Greedy variance splits, level by level: ``{name}`` is ``source`` with the tree's prediction ``t``.

    A split needs ``least`` training rows on both sides; of equal gains the first predictor and the lowest level count.
    """
    steps = [f"{name}_0 AS MATERIALIZED (SELECT *, {target} AS r, 1 AS node FROM {source})"]
    for level in range(depth):
        rows = f"{name}_{level}"
        steps.append(f"""
{name}_split{level} AS MATERIALIZED (
  WITH cells AS (SELECT node, f, v, sum(r) AS s, count(*) AS n FROM (
                   SELECT node, r, unnest([1, 2, 3]) AS f, unnest(p) AS v FROM {rows} WHERE NOT is_test AND node >= {2 ** level}) GROUP BY node, f, v),
  cuts AS (SELECT node, f, v, sum(s) OVER upto AS sl, sum(n) OVER upto AS nl, sum(s) OVER whole AS sa, sum(n) OVER whole AS na FROM cells
           WINDOW upto AS (PARTITION BY node, f ORDER BY v), whole AS (PARTITION BY node, f)),
  gains AS (SELECT node, f, v, sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl) - sa * sa / na AS gain FROM cuts
            WHERE nl >= {least} AND na - nl >= {least})
  SELECT node, f, v FROM gains WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)""")
        steps.append(f"""
{name}_{level + 1} AS MATERIALIZED (SELECT x.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN x.node WHEN p[s.f] <= s.v THEN 2 * x.node ELSE 2 * x.node + 1 END AS node
  FROM {rows} x LEFT JOIN {name}_split{level} s ON s.node = x.node)""")
    steps.append(f"""
{name} AS MATERIALIZED (SELECT x.* EXCLUDE (node, r), t FROM {name}_{depth} x JOIN (
  SELECT node, avg(r) AS t FROM {name}_{depth} WHERE NOT is_test GROUP BY node) USING (node))""")
    return steps


def _card_sql(model: str, source: str, prediction: str) -> str:
    return f"""
SELECT '{model}' AS model, round_even(sqrt(avg((y - {prediction}) ** 2)), 3) AS rmse, count(*) AS n_test, count(*) AS n_predicted FROM {source} WHERE is_test
UNION ALL SELECT 'mean', round_even(sqrt(avg((y - (SELECT avg(y) FROM tree_rows WHERE NOT is_test)) ** 2)), 3), count(*), count(*) FROM tree_rows WHERE is_test"""


def _forest_sql(depth: int, leaf_share: float) -> str:
    least = f"(SELECT greatest(5, ceil(count(*) * {leaf_share}::DOUBLE)) FROM tree_rows WHERE NOT is_test)"
    return ",\n" + ",".join([_TREE_BASE.strip(), *_tree_sql("tree", "tree_rows", "y", depth, least)]) + _card_sql("forest", "tree", "t")


def _boosted_sql(rounds: int, depth: int, rate: float) -> str:
    steps, source = [_TREE_BASE.strip(), "f0 AS (SELECT *, 0::DOUBLE AS f FROM tree_rows)"], "f0"
    for k in range(rounds):
        steps += _tree_sql(f"tree{k}", source, "y - f", depth, "1")
        source = f"f{k + 1}"
        steps.append(f"{source} AS MATERIALIZED (SELECT is_test, y, p, f + {1 if k == 0 else rate} * t AS f FROM tree{k})")
    return ",\n" + ",".join(steps) + _card_sql("boosted", source, "f")


def _tree_card(spark, sf_dir, name, fit):
    """Hold-out error of one tree model on three predictors of few levels."""
    marked = _marked(spark, sf_dir, True, "avg_score", "year", "stu_wgt", F.floor(F.col("escs") / 1000).cast("double").alias("escs_band"))
    rows = settle(feature_table(marked, "avg_score", _TREE_FEATURES, ["is_test"]), codec="zstd")
    train, test = rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")
    return rounded(scorecard(train, test, "avg_score", {name: fit(train)}, counts=True), 3)


@query("forest", with_tables(_forest_sql(4, 0.01), STUDENTS_SQL, _SPLIT_SQL))
def forest(spark, sf_dir):
    return _tree_card(spark, sf_dir, "forest", lambda train: forest_model(
        train, "avg_score", trees=10, depth=4, predictors="all", bootstrap=False, leaf_share=0.01))


@query("boosted", with_tables(_boosted_sql(5, 3, 0.3), STUDENTS_SQL, _SPLIT_SQL))
def boosted(spark, sf_dir):
    return _tree_card(spark, sf_dir, "boosted", lambda train: boosted_model(train, "avg_score", rounds=5, depth=3))
