import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from weighbridge.operators.quantiles import exact_quantiles
from weighbridge.operators.sketches import (
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
from weighbridge.sources import settle

NAN = float("nan")


@pytest.fixture(scope="module")
def scores(spark):
    """A hot country with most rows, heavy tails, ties and missing values; three cycles."""
    df = spark.range(200_000, numPartitions=8)
    share = (F.xxhash64("id") % 1000) / 1000.0
    return settle(df.select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("country"),
        (F.lit(2000) + F.col("id") % 5 % 3).cast("int").alias("year"),
        F.when(F.col("id") % 11 > 0, F.exp(share * 9)).alias("x"),
        F.when(F.col("id") % 13 > 0, F.floor(share * 4).cast("double")).otherwise(F.lit(NAN)).alias("tied"),
        (F.col("id") % 30_000).alias("pupil"),
    ))


def test_quantiles_of_merged_sketches_stay_within_the_rank_error(scores):
    fine = settle(quantile_sketches(scores, ["x", "tied"], ["country", "year"]))
    merged = merge_quantile_sketches(fine, ["x", "tied"], ["country"])
    probs = (0.05, 0.25, 0.5, 0.75, 0.95)
    cuts = settle(sketch_quantiles(merged, ["x", "tied"], ["country"], probs))
    errors = rows(rank_errors(scores, cuts, ["x", "tied"], ["country"], probs))
    assert len(errors) == 8
    assert all(e <= 3 * expected_rank_error() for row in errors for e in row[1:])


def test_counts_and_ends_are_exact_at_every_level(scores):
    fine = quantile_sketches(scores, ["x"], ["country", "year"])
    for by in (["country"], ["year"], []):
        got = merge_quantile_sketches(fine, ["x"], by).select(*by, sketch_rows("x"), sketch_quantile("x", 0), sketch_quantile("x", 1))
        want = scores.groupBy(*by).agg(F.count("x"), F.min("x"), F.max("x"))
        assert sorted(rows(got)) == sorted(rows(want))


def test_rank_errors_against_numpy(frame):
    rng = random.Random(5)
    data = [("a", rng.choice([1.0, 2.0, 2.0, 5.0, 9.0])) for _ in range(400)] + [("a", None), ("a", NAN)]
    cuts = frame("g STRING, x_q25 DOUBLE, x_q50 DOUBLE", ("a", 2.0, 9.0))
    got = rank_errors(frame("g STRING, x DOUBLE", *data), cuts, ["x"], ["g"], (0.25, 0.5)).first()
    xs = np.array([v for _, v in data if v is not None and v == v])
    want = [max((xs < c).mean() - p, p - (xs <= c).mean(), 0.0) for p, c in ((0.25, 2.0), (0.5, 9.0))]
    assert list(got)[1:] == pytest.approx(want)
    assert want[1] > 0.2  # a wrong cut is seen


def test_small_groups_are_exact(frame):
    df = frame("g STRING, x DOUBLE", *[("a", float(i)) for i in range(101)])
    got = sketch_quantiles(quantile_sketches(df, ["x"], ["g"]), ["x"], ["g"])
    assert rows(got.select("x_q50")) == rows(exact_quantiles(df, ["x"], ["g"]).select("x_q50")) == [(50.0,)]


def test_groups_without_values_and_empty_tables(frame):
    df = frame("g STRING, x DOUBLE", ("a", None), ("a", NAN), ("b", 1.0), (None, 2.0))
    fine = quantile_sketches(df, ["x"], ["g"])
    assert sorted(rows(sketch_quantiles(fine, ["x"], ["g"], (0.5,)))) == [("a", None), ("b", 1.0)]
    assert rows(merge_quantile_sketches(fine, ["x"]).select(sketch_rows("x"))) == [(1,)]
    assert rows(rank_errors(df, sketch_quantiles(fine, ["x"], ["g"], (0.5,)), ["x"], ["g"], (0.5,)).orderBy("g")) == [("a", None), ("b", 0.0)]
    assert rows(sketch_quantiles(quantile_sketches(df.limit(0), ["x"], ["g"]), ["x"], ["g"])) == []
    assert rows(unite_distinct(distinct_sketches(df.limit(0), ["x"], ["g"], "n"), "n")) == [(0,)]


def test_distinct_counts_of_any_set_of_cycles(scores):
    fine = settle(distinct_sketches(scores, ["pupil"], ["country", "year"], "pupils"), ("year",))
    for years in ([2000], [2000, 2002], [2000, 2001, 2002]):
        got = dict(rows(unite_distinct(fine.where(F.col("year").isin(years)), "pupils", ["country"])))
        want = dict(rows(scores.where(F.col("year").isin(years)).groupBy("country").agg(F.count_distinct("pupil"))))
        assert got.keys() == want.keys()
        for country, n in want.items():
            assert abs(got[country] - n) <= 4 * expected_count_error() * n, (years, country)


def test_united_sketches_count_an_id_once(frame):
    df = frame("g STRING, a STRING, b STRING", *[(g, str(i), "k") for g in "xyz" for i in range(50)], ("x", None, "k"), ("x", "k", None), ("x", None, None))
    fine = distinct_sketches(df, ["a", "b"], ["g"], "n")
    assert dict(rows(unite_distinct(fine, "n", ["g"]))) == {"x": 53, "y": 50, "z": 50}
    assert rows(unite_distinct(fine, "n")) == [(53,)]


def test_stored_sketches_are_read_by_cycle_without_the_facts(scores):
    fine = settle(distinct_sketches(scores, ["pupil"], ["country", "year"], "pupils"), ("year",))
    plan = unite_distinct(fine.where(F.col("year") == 2001), "pupils", ["country"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and plan.count("FileScan") == 1
