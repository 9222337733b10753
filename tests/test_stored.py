"""Layouts of stored facts: what the plans over them no longer read or shuffle."""

import pytest
from pyspark.sql import functions as F

from helpers import row_set
from weighbridge.operators.joins import join_on
from weighbridge.operators.split import assign_split
from weighbridge.plans import gaps, indicators
from weighbridge.sources import settle, settle_bucketed


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pupils(spark):
    n = F.col("id")
    return settle(spark.range(20_000, numPartitions=4).select(
        F.concat(F.lit("C"), (n % 6).cast("string")).alias("country"), (F.lit(1992) + n % 9).cast("int").alias("year"),
        F.concat_ws("_", F.lit("S"), (n % 6).cast("string"), (n % 252).cast("string")).alias("school_uid"),
        (n % 701).cast("double").alias("avg_score"), (n % 5 + 1).cast("double").alias("stu_wgt")))


@pytest.fixture(scope="module")
def places(spark):
    n = F.col("id")
    return settle(spark.range(252).select(
        F.concat_ws("_", F.lit("S"), (n % 6).cast("string"), n.cast("string")).alias("school_uid"),
        F.when(n % 5 > 1, "public").when(n % 5 == 1, "private").alias("public_private")))


@pytest.fixture(scope="module")
def region(spark):
    return spark.createDataFrame([(f"C{i}", f"Land {i}", "North", "High income") for i in range(6)],
                                 "country STRING, country_name STRING, ilo_subregion STRING, world_bank_income_group STRING")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cycles_wanted_by_a_joined_table_prune_the_facts(pupils, spark, region):
    by_cycle = settle(pupils, ("year",))
    spending = settle(spark.createDataFrame(
        [(f"C{i}", y, 3.0 + i if y != 2000 or i % 2 else None) for i in range(6) for y in range(1992, 2002)],
        "country STRING, year INT, percentage_education_on_gdp DOUBLE"))
    points = indicators.same_cycle_points(by_cycle, spending, region, 2000)
    plan = plan_of(points)
    assert "dynamicpruningexpression(year" in plan
    plain = indicators.same_cycle_points(pupils, spending, region, 2000)
    assert row_set(points) == row_set(plain)
    assert {r["year"] for r in points.collect()} == {1999, 2000}


def test_pruned_facts_read_fewer_files(pupils, spark, region):
    by_cycle = settle(pupils, ("year",))
    spending = settle(spark.createDataFrame([(f"C{i}", 1994, 3.0) for i in range(6)] + [("C0", 2005, 1.0)],
                                            "country STRING, year INT, percentage_education_on_gdp DOUBLE"))
    points = indicators.same_cycle_points(by_cycle, spending, region, 2000)
    points.collect()
    nodes = points._jdf.queryExecution().executedPlan()
    scans = nodes.collectLeaves()
    read = []

    def visit(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            visit(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            visit(node.plan())
        elif name == "FileSourceScanExec" and "dynamicpruning" in node.toString():
            read.append(node.metrics().apply("numPartitions").value())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    assert scans.size() >= 1
    visit(nodes)
    assert read == [1]  # one of nine cycles


def test_stored_by_school_joins_and_sums_without_exchange(pupils, places, region, no_broadcast):
    a, b = (settle_bucketed(df, ["school_uid"], 8) for df in (pupils, places))
    plan = plan_of(join_on(a, b, ["school_uid"], "inner"))
    assert "Exchange" not in plan and plan.count("Bucketed: true") >= 2
    gap = gaps.sector_gap(a, b, region, 2000)
    assert "hashpartitioning(school_uid" not in plan_of(gap)
    assert "hashpartitioning(school_uid" in plan_of(gaps.sector_gap(pupils, places, region, 2000))
    assert row_set(gap) == row_set(gaps.sector_gap(pupils, places, region, 2000))


def test_rows_of_a_school_are_counted_without_exchange(pupils, no_broadcast):
    stored = settle_bucketed(pupils, ["school_uid"], 8)
    sizes = stored.groupBy("school_uid").agg(F.count(F.lit(1)))
    assert "Exchange" not in plan_of(sizes)
    assert row_set(sizes) == row_set(pupils.groupBy("school_uid").agg(F.count(F.lit(1))))


def test_split_by_school_without_exchange(pupils, spark, no_broadcast):
    """With Spark's setting that lets a join use a partitioning on some of its keys."""
    numbered = pupils.withColumn("row_id", F.monotonically_increasing_id().cast("string"))
    numbered = settle(numbered)
    stored = settle_bucketed(numbered, ["school_uid"], 8)
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        marked = assign_split(stored, "school_uid", "row_id", 0.1, 1)
        assert "Exchange" not in plan_of(marked)
    finally:
        spark.conf.set(setting, before)
    assert row_set(marked.select("row_id", "is_test")) == row_set(assign_split(numbered, "school_uid", "row_id", 0.1, 1).select("row_id", "is_test"))


def test_a_hot_school_is_not_bound_to_one_task(pupils, places):
    hot = pupils.withColumn("school_uid", F.when(F.rand(1) < 0.6, F.lit("S_0_0")).otherwise(F.col("school_uid")))
    stored = settle_bucketed(settle(hot), ["school_uid"], 8)
    assert "Bucketed: true" not in plan_of(stored.groupBy("school_uid").count())
    assert stored.count() == pupils.count()


def test_empty_tables_null_keys_and_release(frame, spark):
    df = frame("k STRING, v INT", *[(None if i % 7 == 0 else str(i), i) for i in range(70)])
    stored = settle_bucketed(df, ["k"], 4)
    assert row_set(stored) == row_set(df)
    assert settle_bucketed(df.limit(0), ["k"], 4).count() == 0
    assert any(t.name.startswith("settled_") for t in spark.catalog.listTables())
