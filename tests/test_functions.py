import math

import pytest
from pyspark.sql import functions as F

from helpers import rows, values
from weighbridge import functions as fn
from weighbridge.fixed_values import COUNTRY_RECODES, QUARTILE_LABELS
from weighbridge.functions.tdist import central_t

NAN = float("nan")


def one(frame, ddl, row, *cols):
    return tuple(frame(ddl, row).select(*cols).first())


def test_trim_and_case(frame):
    df = frame("x STRING", (" \tabc \r\n",), (None,))
    assert values(df.select(fn.country_code(F.col("x")).alias("c")), "c") == ["ABC", None]
    assert values(df.select(fn.lower_label(F.col("x")).alias("c")), "c") == ["abc", None]


def test_safe_int_key(frame):
    df = frame("x STRING", ("0012",), ("x1",), ("99999999999",), (None,), ("0",))
    assert values(df.select(fn.safe_int_key(F.col("x")).alias("k")), "k") == ["12", None, None, None, "0"]


def test_composite_key_keeps_place_of_missing_part(frame):
    key = fn.composite_key(F.col("a"), F.col("b"), F.col("c"))
    assert one(frame, "a STRING, b INT, c STRING", ("A", None, "1"), key) == ("A_NA_1",)


def test_recode_many_to_one_and_pass_through(frame):
    df = frame("c STRING", ("QCI",), ("QCN",), ("QCH",), ("FRA",), (None,))
    assert values(df.select(fn.recode(F.col("c"), COUNTRY_RECODES).alias("c")), "c") == [
        "CHN", "CHN", "CHN", "FRA", None,
    ]
    assert len(COUNTRY_RECODES) == 20


def test_fill_text(frame):
    df = frame("n STRING, c STRING", (None, "CIV"), ("NA", "CUW"), ("Peru", "PER"))
    assert values(df.select(fn.fill_text(F.col("n"), F.col("c")).alias("n")), "n") == ["CIV", "CUW", "Peru"]


def test_truncate_label(frame):
    df = frame("x STRING", ("a" * 22,), ("b" * 23,), (None,))
    assert values(df.select(fn.truncate_label(F.col("x")).alias("x")), "x") == ["a" * 22, "b" * 19 + "...", None]


def test_number_text(frame):
    assert one(frame, "n BIGINT", (1234567,), fn.thousands(F.col("n"))) == ("1 234 567",)
    df = frame("x DOUBLE", (1.2345,), (2.0,))
    assert values(df.select(fn.fixed_decimals(F.col("x"), 3).alias("t")), "t") == ["1.234", "2.000"]
    df = frame("x STRING", ("4.5",), ("abc",), ("NaN",), (None,))
    assert values(df.select(fn.to_number(F.col("x")).alias("v")), "v") == [4.5, None, None, None]


def test_round_half_even(frame):
    df = frame("x DOUBLE", (0.5,), (1.5,), (2.5,), (-2.5,))
    assert values(df.select(fn.round_even(F.col("x")).alias("r")), "r") == [0.0, 2.0, 2.0, -2.0]


def test_row_mean(frame):
    df = frame("a DOUBLE, b DOUBLE, c DOUBLE", (1.0, 2.0, 6.0), (1.0, None, 3.0), (None, NAN, 4.0), (None, None, NAN))
    assert values(df.select(fn.row_mean(*map(F.col, "abc")).alias("m")), "m") == [3.0, 2.0, 4.0, None]


def test_percent_change_and_floor(frame):
    df = frame("a DOUBLE, b DOUBLE", (200.0, 210.0), (0.0, 1.0))
    assert values(df.select(fn.percent_change(F.col("a"), F.col("b")).alias("p")), "p") == [5.0, None]
    assert one(frame, "x DOUBLE", (-3.0,), fn.at_most(F.col("x"), -10)) == (-10.0,)
    assert one(frame, "x DOUBLE", (-30.0,), fn.at_most(F.col("x"), -10)) == (-30.0,)


def test_membership_rules_keep_null(frame):
    df = frame("x STRING", ("a",), ("b",), (None,), ("Average (x)",))
    assert values(df.where(fn.outside(F.col("x"), ["a"])), "x") == ["b", None, "Average (x)"]
    assert values(df.where(fn.without_text(F.col("x"), "Average")), "x") == ["a", "b", None]


def test_level_index(frame):
    df = frame("x STRING", ("b",), ("z",), (None,))
    assert values(df.select(fn.level_index(F.col("x"), ["a", "b"]).alias("i")), "i") == [2, None, None]


def test_sector_from_funding(frame):
    df = frame("s STRING, f DOUBLE", ("public", 49.9), ("public", 50.0), ("private", 80.0), ("private", 80.1),
               ("private", None), (None, 90.0), (None, 60.0))
    col = fn.sector_from_funding(F.col("s"), F.col("f"), 80, 50, "public", "private")
    assert values(df.select(col.alias("s")), "s") == [
        "private", "public", "private", "public", "private", "public", None,
    ]


def test_first_match_treats_unknown_as_false(frame):
    df = frame("x INT", (1,), (None,))
    col = fn.first_match([(F.col("x") > 0, "pos")], default=F.lit("other"))
    assert values(df.select(col.alias("y")), "y") == ["pos", "other"]


def test_band_of_cuts_edges(frame):
    df = frame("x DOUBLE", (1.0,), (1.1,), (2.0,), (3.0,), (3.1,), (None,))
    col = fn.band_of_cuts(F.col("x"), [F.lit(1.0), F.lit(2.0), F.lit(3.0)], QUARTILE_LABELS)
    q1, q2, q3, q4 = QUARTILE_LABELS
    assert values(df.select(col.alias("b")), "b") == [q1, q2, q2, q3, q4, None]


def test_zones(frame):
    df = frame("x DOUBLE", (0.969,), (0.97,), (1.03,), (1.031,), (None,))
    assert values(df.select(fn.parity_zone(F.col("x"), 0.97, 1.03).alias("z")), "z") == [
        "below", "parity", "parity", "above", None,
    ]
    df = frame("x DOUBLE", (-1.0,), (0.0,), (2.0,))
    assert values(df.select(fn.sign_zone(F.col("x"), "boys", "girls").alias("z")), "z") == ["boys", None, "girls"]


@pytest.mark.parametrize("data, strict, lenient", [
    ([(1.0, 2.0), (None, 5.0), (3.0, 2.0)], 2.0, 2.0),
    ([(1.0, 2.0), (NAN, 5.0), (3.0, 2.0)], 2.0, 2.0),
    ([(1.0, 2.0), (3.0, None)], None, 1.0),
    ([(1.0, 2.0), (None, None)], 1.0, 1.0),
    ([(1.0, 0.0), (3.0, 0.0)], None, None),
    ([(7.0, 3.0)], 7.0, 7.0),
    ([(None, 1.0)], None, None),
])
def test_weighted_mean(frame, data, strict, lenient):
    df = frame("x DOUBLE, w DOUBLE", *data)
    x, w = F.col("x"), F.col("w")
    assert tuple(df.agg(fn.weighted_mean(x, w), fn.weighted_mean(x, w, False)).first()) == (strict, lenient)
    parts = df.groupBy().agg(*fn.weighted_parts(x, w))
    assert parts.agg(fn.weighted_mean_of_parts(F.lit(True))).first()[0] == strict


def test_equal_weights_give_the_mean(frame):
    df = frame("x DOUBLE", *[(float(i * i % 17),) for i in range(50)])
    a, b = df.agg(fn.weighted_mean(F.col("x"), F.lit(3.0)), F.avg("x")).first()
    assert math.isclose(a, b)


def test_distinct_values_counts_null_once(frame):
    df = frame("g STRING, x STRING", ("a", "1"), ("a", "1"), ("a", None), ("a", None), ("b", "2"), ("c", None))
    got = df.groupBy("g").agg(fn.distinct_values(F.col("x")).alias("n"))
    assert dict(rows(got)) == {"a": 2, "b": 1, "c": 1}


def test_rmse(frame):
    df = frame("p DOUBLE, y DOUBLE", (1.0, 2.0), (3.0, 5.0))
    assert math.isclose(df.agg(fn.rmse(F.col("p"), F.col("y"))).first()[0], math.sqrt(2.5))


def test_snake_names():
    assert fn.snake_names(["Income Group", "schoolUid", "GDP_per_PPP_2022", "a.b", "a b", "Coverage (%)", "2022x"]) == [
        "income_group", "school_uid", "gdp_per_ppp_2022", "a_b", "a_b_2", "coverage_percent", "x2022x",
    ]


def test_t_quantiles():
    # published table values of the 90 % point and the quartile
    for df, t in {1: 3.0777, 2: 1.8856, 3: 1.6377, 5: 1.4759, 10: 1.3722, 30: 1.3104}.items():
        assert abs(central_t(df, 0.8) - t) < 5e-5
    for df, t in {1: 1.0, 2: 0.8165, 10: 0.6998}.items():
        assert abs(central_t(df, 0.5) - t) < 5e-5


def test_t_for_level_is_continuous_at_the_table_end(frame):
    df = frame("d INT", (0,), (5,), (120,), (121,), (1000,))
    got = values(df.select(fn.t_for_level(F.col("d"), 0.95).alias("t")), "t")
    assert got[0] is None
    for k, t in zip((5, 120, 121, 1000), got[1:]):
        assert abs(t - central_t(k, 0.95)) < 1e-9
