"""Every registered query against its SQL on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_results import compare, duck  # noqa: E402

from weighbridge.catalogue import QUERIES, SQL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    good, text = compare(spark, con, name, SF_DIR)
    assert good, text


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["year", "ilo_subregion", "weighted_mean", "n"]
    assert QUERIES.keys() <= entry.queries().keys() and SQL.keys() <= entry.oracle_sql().keys()


def test_cycles_reach_the_scan(spark):
    for name, year in (("gender_gap", 2000), ("parity_fit", 1998), ("ratio_vs_score", 2000)):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual(l_shipdate,{year}-01-01" in plan, name
