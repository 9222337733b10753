"""Whole questions on small hand-made survey tables."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import row_set, rows
from weighbridge.fixed_values import QUARTILE_LABELS, SUMMARY_STATISTICS
from weighbridge.operators.quantiles import quantile_bands
from weighbridge.plans import audit, gaps, indicators, modelling, prepare, reports

NAN = float("nan")
LOW, MID, HIGH = "Low income", "Upper-middle income", "High income"
STUDENT = ("year INT, country STRING, school_id STRING, student_id STRING, gender STRING, escs DOUBLE, "
           "math DOUBLE, read DOUBLE, science DOUBLE, stu_wgt DOUBLE")
REGION = "country STRING, country_name STRING, ilo_subregion STRING, world_bank_income_group STRING"


@pytest.fixture
def region(frame):
    return frame(REGION, ("AAA", "Aland", "North", HIGH), ("BBB", "Bland", "North", HIGH), ("CCC", None, "South", MID),
                 ("DDD", "Dland", "South", None), ("EEE", "Eland", "South", LOW))


def scores(frame, *data):
    """(year, country, gender, escs, score, weight[, school]) rows."""
    full = [d if len(d) == 7 else (*d, "1") for d in data]
    return frame("year INT, country STRING, gender STRING, escs DOUBLE, avg_score DOUBLE, stu_wgt DOUBLE, school_id STRING",
                 *full).withColumn("school_uid", F.concat_ws("_", "country", F.col("year").cast("string"), "school_id"))


# preparation -------------------------------------------------------------------------

def test_cleaning_rules(frame):
    ok = (2022, "A", "1", "s", "male", 0.1, 500.0, 500.0, 500.0, 1.0)

    def but(**kw):
        names = [c.split()[0] for c in STUDENT.split(", ")]
        return tuple(kw.get(n, v) for n, v in zip(names, ok))

    kept = [ok, but(math=50.0), but(read=1000.0), but(stu_wgt=None)]
    gone = [but(escs=None), but(escs=NAN), but(gender=None), but(math=None), but(math=49.9), but(science=1000.1), but(read=NAN)]
    assert row_set(prepare.clean_students(frame(STUDENT, *kept, *gone))) == sorted(kept, key=repr)


def test_school_key(frame):
    df = frame("country STRING, year INT, school_id STRING", ("A", 2022, "0012"), ("A", 2022, "x1"), (None, 2022, "3"))
    assert [r.school_uid for r in prepare.add_school_key(df).collect()] == ["A_2022_12", "A_2022_NA", "NA_2022_3"]


def test_harmonise_attach_and_audit(frame, region):
    df = prepare.harmonise_country(frame("country STRING", (" qci\t",), ("aaa",), ("ccc",), ("zzz",), ("zzz",)))
    assert [r.country for r in df.collect()] == ["CHN", "AAA", "CCC", "ZZZ", "ZZZ"]
    named = prepare.attach_regions(df, region).select("country", "country_name", "world_bank_income_group")
    assert row_set(named.distinct()) == row_set(frame(
        "c STRING, n STRING, g STRING", ("CHN", "CHN", None), ("AAA", "Aland", HIGH), ("CCC", "CCC", MID), ("ZZZ", "ZZZ", None)))
    assert rows(prepare.unmatched_countries(df, region)) == [("ZZZ", 2), ("CHN", 1)]


def test_average_score_and_sector(frame):
    df = frame("math DOUBLE, read DOUBLE, science DOUBLE", (1.0, 2.0, None), (None, None, None))
    assert [r.avg_score for r in prepare.add_average_score(df).collect()] == [1.5, None]
    schools = frame("public_private STRING, fund_gov DOUBLE", ("private", 90.0), ("public", 10.0), ("public", 60.0))
    assert row_set(audit.sector_conflicts(schools)) == [("private above 80", 1), ("public below 50", 1)]
    fixed = prepare.relabel_sector(schools)
    assert [r.public_private for r in fixed.collect()] == ["public", "private", "public"]
    assert {r.n_cases for r in audit.sector_conflicts(fixed).collect()} == {0}


# audits ------------------------------------------------------------------------------

def test_participation_keeps_one_sided_cycles(frame):
    s, k = frame("year INT", (2018,), (2018,), (2022,)), frame("year INT", (2022,), (2025,))
    assert rows(audit.participation(s, k)) == [(2018, 2, None), (2022, 1, 1), (2025, None, 1)]


def test_score_summary(frame):
    df = frame("math DOUBLE, read DOUBLE", (1.0, 5.0), (2.0, None), (3.0, NAN), (6.0, 7.0))
    got = {r.statistic: (r.math, r.read) for r in audit.score_summary(df, ["math", "read"]).collect()}
    assert got == dict(zip(SUMMARY_STATISTICS, [(1.0, 5.0), (1.75, 5.5), (2.5, 6.0), (3.0, 6.0), (3.75, 6.5), (6.0, 7.0)]))


def test_entities_per_country(frame, region):
    df = frame("country STRING, year INT, student_id STRING", ("AAA", 1, "x"), ("AAA", 2, "x"), ("CCC", 1, None), ("CCC", 1, "y"))
    assert rows(audit.entities_per_country(df, region, ["student_id"], "n")) == [("CCC", 2), ("Aland", 1)]
    assert rows(audit.entities_per_country(df, region, ["year", "student_id"], "n", width=4)) == [("A...", 2), ("CCC", 2)]


# trends, coverage --------------------------------------------------------------------

def test_trend_and_change(frame):
    df = frame("year INT, ilo_subregion STRING, avg_score DOUBLE, stu_wgt DOUBLE",
               (2009, "N", 400.0, 1.0), (2009, "N", 500.0, 3.0), (2022, "N", 427.5, 1.0), (2009, "S", 1.0, 1.0),
               (2015, "S", 1.0, None), (2022, "W", 5.0, 1.0))
    trend = reports.weighted_trend(df)
    assert rows(trend) == [(2009, "N", 475.0, 2), (2009, "S", 1.0, 1), (2015, "S", None, 1), (2022, "N", 427.5, 1),
                           (2022, "W", 5.0, 1)]
    assert rows(reports.change_between(trend, 2009, 2022, "ilo_subregion")) == [("N", 475.0, 428.0, -9.9)]


def test_coverage_of_published_counts(spark):
    """90/59/57/28 listed countries with 50/30/15/0 seen."""
    groups = {LOW: (28, 0), "Lower-middle income": (57, 15), MID: (59, 30), HIGH: (90, 50)}
    listed = [(g, f"{g[:3]}{i:02d}") for g, (n, _) in groups.items() for i in range(n)]
    seen = [(g, f"{g[:3]}{i:02d}") for g, (_, n) in groups.items() for i in range(n)] * 3
    ddl = "g STRING, country STRING"
    got = reports.coverage(spark.createDataFrame(listed + [(None, "X")], ddl), spark.createDataFrame(seen, ddl), "g", "country")
    assert rows(got) == [(LOW, 28, 0, 0.0), ("Lower-middle income", 57, 15, 26.3), (MID, 59, 30, 50.8), (HIGH, 90, 50, 55.6)]


def test_mobility(frame):
    q1, _, q3, q4 = QUARTILE_LABELS
    df = frame("year INT, world_bank_income_group STRING, escs_quartile STRING, avg_score_quartile STRING, avg_score DOUBLE",
               (2022, HIGH, q1, q4, 600.0), (2022, HIGH, q1, q3, 500.0), (2022, HIGH, q4, q4, 701.0), (2022, HIGH, None, q4, 800.0),
               (2022, None, q1, q4, 1.0), (2000, HIGH, q1, q4, 1.0), (2018, HIGH, None, q4, 1.0))
    got = reports.mobility(df).drop("n_total_text", "n_bottom_to_top_text")
    assert rows(got) == [(2022, HIGH, 3, 1, 33.33, 50.0, 700.0)]


# gaps --------------------------------------------------------------------------------

def test_level_gap_rules(frame):
    df = frame("c STRING, l STRING, x DOUBLE, w DOUBLE", ("A", "m", 1.0, 1.0), ("A", "f", 4.0, 1.0), ("A", "f", 6.0, 3.0),
               ("A", "f", 9.0, None), ("A", "f", None, 1.0), ("B", "m", 1.0, 1.0), ("C", "m", 1.0, 0.0), ("C", "f", 1.0, 1.0))
    assert rows(gaps.level_gap(df, ["c"], "l", "m", "f", "x", "w")) == [("A", 1.0, 5.5, 4.5)]
    back = gaps.level_gap(df, ["c"], "l", "f", "m", "x", "w")
    assert [r.gap for r in back.collect()] == [-4.5]


def test_gender_gap(frame, region):
    df = scores(frame, (2022, "AAA", " Male\t", 0.0, 10.0, 1.0), (2022, "AAA", "FEMALE", 0.0, 14.0, 1.0),
                (2022, "BBB", "male", 0.0, 10.0, 1.0), (2022, "BBB", "female", 0.0, 11.0, 1.0),
                (2018, "BBB", "female", 0.0, 99.0, 1.0), (2022, "CCC", "female", 0.0, 1.0, 1.0),
                (2022, "DDD", "male", 0.0, 1.0, 1.0), (2022, "DDD", "female", 0.0, 2.0, 1.0))
    got = gaps.gender_gap(df, region, 2022).select("country_name", "gap", "display_order")
    assert row_set(got) == [("Aland", 4.0, 2), ("Bland", 1.0, 1)]
    assert gaps.gender_gap(df, region, 2022, group=MID).count() == 0


def sector_tables(frame):
    students = scores(frame, (2022, "AAA", "m", 0.0, 100.0, 1.0, "1"), (2022, "AAA", "m", 0.0, 200.0, 1.0, "1"),
                      (2022, "AAA", "m", 0.0, 300.0, 2.0, "2"), (2022, "AAA", "m", 0.0, 900.0, None, "2"),
                      (2018, "AAA", "m", 0.0, 900.0, 1.0, "2"))
    schools = frame("country STRING, year INT, school_id STRING, public_private STRING",
                    ("AAA", 2022, "1", "public"), ("AAA", 2022, "2", "private"), ("AAA", 2018, "1", "private"))
    return students, prepare.add_school_key(schools)


def test_sector_gap_with_and_without_the_cycle(frame, region):
    students, schools = sector_tables(frame)
    one = gaps.sector_gap(students, schools, region, 2022).first()
    assert (one.public, one.private, one.gap) == (150.0, 300.0, 150.0)
    # without the cycle, school 1 also counts as private: (100 + 200 + 2 * 300) / 4
    fan = gaps.sector_gap(students, schools, region, 2022, ["school_id", "country"]).first()
    assert (fan.public, fan.private, fan.gap) == (150.0, 225.0, 75.0)


def test_sector_gap_equals_the_row_level_join(frame, region):
    students, schools = sector_tables(frame)
    linked = students.where("year = 2022").join(schools.select("school_id", "country", "public_private"),
                                                ["school_id", "country"])
    by_row = gaps.level_gap(linked, ["country"], "public_private", "public", "private", "avg_score", "stu_wgt").first()
    fan = gaps.sector_gap(students, schools, region, 2022, ["school_id", "country"]).first()
    assert (by_row.public, by_row.private) == (fan.public, fan.private)


@pytest.fixture
def banded(frame):
    data = []
    for year, country, base, step in ((2003, "AAA", 400, 10), (2022, "AAA", 420, 20), (2022, "BBB", 410, 5),
                                      (2018, "CCC", 300, 8), (2022, "DDD", 350, 4), (2015, "BBB", 1, 1)):
        data += [(year, country, "m", float(i), float(base + step * i), 1.0) for i in range(1, 9)]
    return quantile_bands(scores(frame, *data), ["escs"], ["country", "year"])


def test_gap_segments(banded, region):
    got = gaps.gap_segments(banded, region)
    table = {(r.country, r.year): (r.world_bank_income_group, r.bottom, r.top, r.display_order) for r in got.collect()}
    # bands of eight equal steps: rows 1-2 are the lowest, rows 7-8 the highest
    assert table["AAA", 2022] == (HIGH, 450.0, 570.0, 2)
    assert table["BBB", 2022] == (HIGH, 417.5, 447.5, 1)
    assert table["CCC", 2018] == (MID, 312.0, 360.0, 1)
    assert table[f"Average ({HIGH})", 2022] == (HIGH, 433.75, 508.75, 3)
    assert table[f"Average ({HIGH})", 2003] == (HIGH, 415.0, 475.0, 3)
    everyone = table["Average (All countries)", 2022]
    assert everyone[0] is None
    assert everyone[1] == pytest.approx((450 + 417.5 + 356) / 3)  # the country without a group counts here
    assert len(table) == 4 + 3 + 3


def test_one_grouped_run_equals_single_group_runs(banded, region):
    whole = gaps.gap_latest(banded, region)
    for group in (HIGH, MID):
        only = region.where(F.col("world_bank_income_group") == group)
        members = banded.join(only.select("country"), "country", "left_semi")
        assert row_set(gaps.gap_latest(members, region)) == row_set(whole.where(F.col("world_bank_income_group") == group))


def test_gap_latest(banded, region):
    assert rows(gaps.gap_latest(banded, region)) == [
        (HIGH, "Aland", 450.0, 570.0, 120.0, 2022), (HIGH, "Bland", 418.0, 448.0, 30.0, 2022),
        (MID, "CCC", 312.0, 360.0, 48.0, 2018),
    ]


# indicators --------------------------------------------------------------------------

@pytest.fixture
def people(frame):
    return scores(frame, (2018, "AAA", "male", 0.0, 400.0, 1.0), (2022, "AAA", "male", 0.0, 500.0, 1.0),
                  (2022, "AAA", "female", 0.0, 520.0, 3.0), (2025, "AAA", "male", 0.0, 9.0, 1.0),
                  (2018, "CCC", "male", 0.0, 300.0, 1.0), (2018, "CCC", "female", 0.0, 290.0, 1.0),
                  (2022, "DDD", "male", 0.0, 100.0, 1.0), (2022, "BBB", "male", 0.0, 450.0, 1.0))


def test_spending_points(frame, region, people):
    spending = frame("country STRING, year INT, percentage_education_on_gdp DOUBLE", ("AAA", 2019, 4.0), ("AAA", 2021, 5.0),
                     ("AAA", 2023, 9.0), ("CCC", 2010, 3.0), ("CCC", 2022, None), ("DDD", 2020, 2.0))
    got = indicators.spending_points(people, spending, region, 2022)
    assert row_set(got.select("country_name", "year", "weighted_avg_score", "expenditure_year", "percentage_education_on_gdp")) == [
        ("Aland", 2022, 515.0, 2021, 5.0), ("CCC", 2018, 295.0, 2010, 3.0),
    ]


def test_gdp_points(frame, region, people):
    gdp = frame("country STRING, GDP_per_PPP_2022 DOUBLE", (" aaa", 1000.0), ("BBB", None), ("DDD", 100.0))
    got = indicators.gdp_points(people, gdp, region, 2022).select("country_name", "weighted_avg_score", "log10_gdp")
    assert [(n, s, round(v, 9)) for n, s, v in row_set(got)] == [("Aland", 515.0, 3.0), ("Dland", 100.0, 2.0)]


def test_ratio_points(frame, region, people):
    schools = frame("country STRING, year INT, stratio DOUBLE", ("AAA", 2022, 10.0), ("AAA", 2022, 20.0), ("AAA", 2022, NAN),
                    ("AAA", 2018, 99.0), ("BBB", 2022, None))
    got = indicators.ratio_points(people, schools, region, 2022)
    assert row_set(got.select("country_name", "weighted_avg_score", "avg_ratio")) == [("Aland", 515.0, 15.0)]


def test_parity_points_and_axis(frame, region, people):
    index = frame("country STRING, year INT, school_level STRING, gender_parity_index DOUBLE", ("CCC", 2018, "Secondary", 0.97),
                  ("CCC", 2018, "Primary", 2.0), ("CCC", 2022, "Secondary", 3.0), ("AAA", 2018, "secondary", 1.0))
    got = indicators.parity_points(people, index, region, 2018)
    assert rows(got.select("country_name", "gap", "gender_parity_index", "parity_zone", "gap_zone")) == [
        ("CCC", -10.0, 0.97, "parity", "boys"),
    ]
    assert rows(indicators.gap_axis(got)) == [(-10.0, -10.0)]


# modelling ---------------------------------------------------------------------------

def test_modelling_table(frame, people):
    schools = frame("school_uid STRING, school_size DOUBLE", ("AAA_2022_1", 500.0))
    gdp = frame("country STRING, GDP_per_PPP_2022 DOUBLE", ("AAA", 1000.0))
    spending = frame("country STRING, year INT, percentage_education_on_gdp DOUBLE", ("AAA", 2021, 5.0), ("AAA", 2023, 9.0))
    index = frame("country STRING, year INT, school_level STRING, gender_parity_index DOUBLE",
                  ("AAA", 2019, "Secondary", 1.1), ("AAA", 2020, "Secondary", 0.9), ("AAA", 2021, "Primary", 3.0),
                  ("AAA", 2022, "Secondary", None))
    got = modelling.modelling_table(people, schools, gdp, spending, index, [2022], ["school_size"])
    wanted = ["country", "avg_score", "school_size", "GDP_per_PPP_2022", "percentage_education_on_gdp", "gender_parity_index"]
    assert row_set(got.select(wanted)) == row_set(frame(
        "c STRING, a DOUBLE, s DOUBLE, g DOUBLE, p DOUBLE, i DOUBLE", ("AAA", 500.0, 500.0, 1000.0, 5.0, 0.9),
        ("AAA", 520.0, 500.0, 1000.0, 5.0, 0.9), ("DDD", 100.0, None, None, None, None), ("BBB", 450.0, None, None, None, None)))


def test_split_fit_and_compare(frame):
    data = [(f"r{i}", f"S{i % 12}", 500.0 + 3.0 * (i % 31) - (i % 7), float(i % 31), float(i % 7)) for i in range(480)]
    table = frame("row_id STRING, school_uid STRING, avg_score DOUBLE, a DOUBLE, b DOUBLE", *data)
    train, test = modelling.split_features(table, "row_id", ["a", "b"])
    assert (train.count(), test.count()) == (432, 48)
    card = dict(rows(modelling.compare_models(train, test, {"linear": modelling.FITTERS["linear"]})))
    assert card["linear"] < 1e-6 < card["mean"]
    assert math.isfinite(card["mean"])
