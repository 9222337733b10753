"""Properties over generated data."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weighbridge.functions import weighted_mean
from weighbridge.operators.quantiles import exact_quantiles
from weighbridge.operators.split import assign_split

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
number = st.one_of(st.none(), st.floats(-1e6, 1e6).map(lambda v: round(v, 3)))


def quantile(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    low, high = values[math.floor(h)], values[math.ceil(h)]
    return low + (h - math.floor(h)) * (high - low)


@few
@given(st.lists(st.tuples(number, st.one_of(st.none(), st.integers(0, 9).map(float))), min_size=1, max_size=40))
def test_weighted_mean_by_hand(spark, data):
    got = spark.createDataFrame(data, "x DOUBLE, w DOUBLE").agg(weighted_mean(F.col("x"), F.col("w"))).first()[0]
    kept = [(x, w) for x, w in data if x is not None]
    total = sum(w for _, w in kept if w is not None)
    if any(w is None for _, w in kept) or total == 0:
        assert got is None
    else:
        assert math.isclose(got, sum(x * w for x, w in kept) / total, rel_tol=1e-9, abs_tol=1e-6)


@few
@given(st.lists(st.tuples(st.sampled_from("ab"), number), min_size=1, max_size=60))
def test_quantiles_by_hand(spark, data):
    df = spark.createDataFrame(data, "g STRING, x DOUBLE")
    for g, *cuts in exact_quantiles(df, ["x"], ["g"]).collect():
        values = [x for k, x in data if k == g and x is not None]
        want = [quantile(values, p) for p in (0.25, 0.5, 0.75)] if values else [None] * 3
        for a, b in zip(cuts, want):
            assert a is b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)


@few
@given(st.lists(st.integers(1, 30), min_size=1, max_size=5), st.sampled_from([0.1, 0.25, 0.5]))
def test_split_sizes(spark, sizes, p):
    data = [(f"s{k}", f"{k}-{i}") for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, "s STRING, id STRING")
    got = dict(assign_split(df, "s", "id", p, 3).groupBy("s").agg(F.count_if("is_test")).collect())
    for k, n in enumerate(sizes):
        drawn = math.ceil(n * p)
        assert got[f"s{k}"] == (drawn if drawn < n else 0)
