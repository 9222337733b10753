
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import row_set, rows, values
from weighbridge.operators import columns, grouped, joins, pick, quality, reshape
from weighbridge.operators import rows as filters

NAN = float("nan")


# columns -----------------------------------------------------------------------------

def test_keep_strict_and_tolerant(frame):
    df = frame("a INT, b INT, c INT", (1, 2, 3))
    assert columns.keep(df, ["c", "a"]).columns == ["c", "a"]
    assert columns.keep(df, ["c", "zz"], strict=False).columns == ["c"]
    with pytest.raises(ValueError):
        columns.keep(df, ["c", "zz"])


def test_drop_prefixed_rename_snake(frame):
    df = frame("`Income Group` STRING, grp_x INT, grp_y INT", ("a", 1, 2))
    assert columns.drop_prefixed(df, "grp_").columns == ["Income Group"]
    assert columns.rename(df, x="grp_x").columns == ["Income Group", "x", "grp_y"]
    assert columns.snake_case(df).columns == ["income_group", "grp_x", "grp_y"]


def test_to_strings(frame):
    df = frame("a INT, b DOUBLE, c STRING", (1, 2.5, "x"))
    assert [t for _, t in columns.to_strings(df).dtypes] == ["string"] * 3
    assert [t for _, t in columns.to_strings(df, (T.DoubleType,)).dtypes] == ["int", "string", "string"]


def test_drop_degenerate_follows_train(frame):
    ddl = "a DOUBLE, b STRING, c STRING, d DOUBLE, e DOUBLE"
    train = frame(ddl, (None, "x", "p", 1.0, NAN), (None, "x", "q", 1.0, None), (NAN, None, "q", 1.0, NAN))
    test = frame(ddl, (5.0, "y", "p", 2.0, 1.0))
    assert columns.degenerate_columns(train) == ["a", "b", "e"]
    tr, te = columns.drop_degenerate(train, test)
    assert tr.columns == te.columns == ["c", "d"]


# rows --------------------------------------------------------------------------------

def test_require_and_range(frame):
    df = frame("i INT, x DOUBLE", (1, 50.0), (2, 49.9), (3, 1000.0), (4, 1000.1), (5, None), (6, NAN))
    assert values(filters.require(df, "x"), "i") == [1, 2, 3, 4]
    assert values(filters.within(df, ["x"], 50, 1000), "i") == [1, 3]
    assert values(filters.complete_cases(df), "i") == [1, 2, 3, 4]
    assert values(filters.up_to(df, "i", 2), "i") == [1, 2]


def test_filters_reach_the_scan(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    frame("a INT, x DOUBLE, y DOUBLE", (1, 60.0, 1.0)).write.parquet(path)
    df = filters.within(filters.require(spark.read.parquet(path), "a"), ["x"], 50, 1000).select("a")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(a)" in plan and "GreaterThanOrEqual(x,50.0)" in plan
    assert "y#" not in plan


# joins -------------------------------------------------------------------------------

def test_null_safe_join(frame):
    a = frame("k STRING, x INT", ("a", 1), (None, 2), ("c", 3))
    b = frame("k STRING, y INT", ("a", 10), (None, 20), ("d", 40))
    assert row_set(joins.join_on(a, b, ["k"])) == row_set(
        frame("k STRING, x INT, y INT", ("a", 1, 10), (None, 2, None), ("c", 3, None)))
    assert row_set(joins.join_on(a, b, ["k"], null_safe=True)) == row_set(
        frame("k STRING, x INT, y INT", ("a", 1, 10), (None, 2, 20), ("c", 3, None)))
    full = joins.join_on(a, b, ["k"], "full", null_safe=True)
    assert row_set(full.select("k", "x", "y")) == row_set(
        frame("k STRING, x INT, y INT", ("a", 1, 10), (None, 2, 20), ("c", 3, None), ("d", None, 40)))


def test_semi_anti_and_all_column_anti(frame):
    a = frame("k STRING, x INT", ("a", 1), ("a", 2), (None, 2), ("c", 3))
    b = frame("k STRING, x INT", ("a", 1), (None, 2))
    assert values(joins.keep_matching(a, b, ["k"]), "x") == [1, 2, 2]
    assert values(joins.keep_unmatched(a, b, ["k"]), "x") == [3]
    assert row_set(joins.remove_rows(a, b)) == [("a", 2), ("c", 3)]


def test_null_safe_join_is_a_hash_or_merge_join(frame):
    a, b = frame("k STRING, x INT", ("a", 1)), frame("k STRING, x INT", ("a", 1))
    plan = joins.remove_rows(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contains_all(frame):
    a, b = frame("k STRING", ("a",), ("b",)), frame("k STRING", ("a",), ("b",), ("c",))
    assert rows(joins.contains_all(a, b, "k")) == [(True,)]
    assert rows(joins.contains_all(b, a, "k")) == [(False,)]


def test_fan_out_and_star(frame):
    fact = frame("sid STRING, c STRING, year INT", ("1", "A", 2022), ("2", "A", 2022))
    school = frame("sid STRING, c STRING, year INT, s STRING", ("1", "A", 2018, "private"), ("1", "A", 2022, "public"))
    assert joins.join_on(fact, school.drop("year"), ["sid", "c"]).count() == 3
    assert joins.join_on(fact, school, ["sid", "c", "year"]).count() == 2
    dim = frame("c STRING, g DOUBLE", ("A", 1.5))
    assert row_set(joins.star(fact, (school, ["sid", "c", "year"]), (dim, ["c"])).select("sid", "s", "g")) == [
        ("1", "public", 1.5), ("2", None, 1.5),
    ]


# grouped -----------------------------------------------------------------------------

def test_counts(frame):
    df = frame("g STRING, x INT", ("a", 1), ("a", None), ("b", 3))
    assert dict(rows(grouped.row_counts(df, ["g"]))) == {"a": 2, "b": 1}
    assert rows(grouped.counts_where(df, big=F.col("x") > 1, small=F.col("x") <= 1)) == [(1, 1)]
    assert rows(grouped.row_counts(df)) == [(3,)]


def test_means_skip_nan(frame):
    df = frame("g STRING, x DOUBLE", ("a", 1.0), ("a", NAN), ("a", 3.0), ("b", None))
    assert dict(rows(grouped.means(df, ["g"], "x", "m"))) == {"a": 2.0, "b": None}


def test_text_list(frame):
    df = frame("g STRING, k STRING", ("a", "z"), ("a", "b"), ("a", "z"), ("b", "q"))
    assert row_set(grouped.text_list(df, ["g"], "k", "n", "ks")) == [("a", 2, "b, z"), ("b", 1, "q")]


def test_histogram_limits_and_constant(frame):
    df = frame("x DOUBLE", *[(float(i),) for i in range(31)], (None,), (NAN,))
    got = dict(rows(grouped.equal_width_counts(df, "x", 30)))
    assert sum(got.values()) == 31 and got[30] == 2 and got[1] == 1 and max(got) == 30
    assert rows(grouped.equal_width_counts(frame("x DOUBLE", (5.0,), (5.0,)), "x", 30)) == [(1, 2)]


# quality -----------------------------------------------------------------------------

def test_missingness(frame):
    df = frame("a INT, b DOUBLE, c STRING", (1, None, "x"), (2, NAN, None), (3, 1.0, "y"))
    assert rows(quality.missingness(df)) == [("b", 66.67), ("c", 33.33), ("a", 0.0)]


def test_key_audit(frame):
    df = frame("a STRING, b STRING", ("x", "1"), ("x", "1"), ("x", None), (None, "1"), ("y", "2"))
    from weighbridge.functions import composite_key
    audit = quality.key_audit(df, composite_key(F.col("a"), F.col("b")), ["a", "b"])
    assert rows(audit) == [(5, 1, 2)]


def test_frequency_forces_a_missing_row(frame):
    df = frame("s STRING", ("p",), ("p",), ("q",))
    assert row_set(quality.frequency_with_missing(df, "s")) == row_set(
        frame("s STRING, n BIGINT", ("p", 2), ("q", 1), (None, 0)))
    df = frame("s STRING", ("p",), (None,))
    assert (None, 1) in rows(quality.frequency_with_missing(df, "s"))


def test_label_conflicts(frame):
    df = frame("s STRING, f DOUBLE", ("private", 90.0), ("public", 10.0), ("public", None), (None, 90.0))
    checks = [("it's high", (F.col("f") > 80) & (F.col("s") == "private")), ("low", (F.col("f") < 50) & (F.col("s") == "public"))]
    assert rows(quality.label_conflicts(df, checks)) == [("it's high", 1), ("low", 1)]


# picking -----------------------------------------------------------------------------

def test_latest_with_and_without_ties(frame):
    df = frame("k STRING, y INT, v INT", ("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 5, 4), ("b", None, 5))
    assert row_set(pick.latest_with_ties(df, ["k"], "y")) == row_set(
        frame("k STRING, y INT, v INT", ("a", 2, 2), ("a", 2, 3), (None, 5, 4)))
    assert row_set(pick.latest_one(df, ["k"], "y", ["v"])) == row_set(
        frame("k STRING, y INT, v INT", ("a", 2, 3), (None, 5, 4), ("b", None, 5)))


def test_groups_of_size(frame):
    df = frame("k STRING, v INT", ("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5))
    assert sorted(values(pick.groups_of_size(df, ["k"], 2), "v")) == [1, 2, 4, 5]


def test_display_order(frame):
    df = frame("g STRING, k STRING, v DOUBLE", ("x", "a", 2.0), ("x", "b", 1.0), ("y", "c", 5.0))
    assert row_set(pick.display_order(df, ["v"], ["g"]).select("k", "display_order")) == [("a", 2), ("b", 1), ("c", 1)]


# reshape -----------------------------------------------------------------------------

def test_spread_and_gather(frame):
    df = frame("c STRING, y INT, v DOUBLE", ("a", 2009, 1.0), ("a", 2022, 2.0), ("b", 2009, 3.0))
    wide = reshape.spread(df, "y", [2009, 2022], "v", prefix="score_")
    assert wide.columns == ["c", "score_2009", "score_2022"]
    assert row_set(wide) == [("a", 1.0, 2.0), ("b", 3.0, None)]
    back = reshape.gather(wide, ["c"], ["score_2009", "score_2022"], "y", "v")
    assert back.where("v IS NOT NULL").count() == 3


def test_append_and_difference(frame):
    a, b = frame("x INT, y STRING", (1, "p")), frame("x INT, z INT", (1, 7), (2, 8))
    assert row_set(reshape.append_rows(a, b)) == row_set(
        frame("x INT, y STRING, z INT", (1, "p", None), (1, None, 7), (2, None, 8)))
    assert rows(reshape.value_difference(b, a, "x")) == [(2,)]
    assert reshape.distinct_rows(b.union(b), "x").count() == 2


