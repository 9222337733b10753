import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from weighbridge.fixed_values import QUARTILE_LABELS
from weighbridge.operators.quantiles import exact_quantiles, order_key, quantile_bands

NAN = float("nan")


def expected(groups, probs):
    return {g: [float(np.quantile(v, p)) for p in probs] for g, v in groups.items()}


@pytest.fixture
def mixed(frame):
    """Groups of very different size and shape, ties and missing values included."""
    rng = random.Random(7)
    groups = {
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(4000)],
        "tied": [float(rng.randrange(4)) for _ in range(3000)],
        "same": [2.5] * 900,
        "tail": [rng.paretovariate(0.3) for _ in range(2500)],
        "four": [1.0, 2.0, 3.0, 4.0],
        "one": [8.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs]
    data += [("wide", None), ("four", NAN), ("tied", NAN), (None, 5.0)]
    rng.shuffle(data)
    return frame("g STRING, x DOUBLE", *data), groups


def test_agrees_with_numpy(mixed):
    df, groups = mixed
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    got = {r[0]: list(r[1:]) for r in rows(exact_quantiles(df, ["x"], ["g"], probs))}
    want = expected(groups, probs)
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12), g


def test_without_groups_and_several_columns(frame):
    df = frame("x DOUBLE, y DOUBLE", *[(float(i), float(i % 7)) for i in range(1001)])
    row = exact_quantiles(df, ["x", "y"]).first()
    assert tuple(row) == (250.0, 500.0, 750.0, 1.0, 3.0, 5.0)


def test_worked_example(frame):
    df = frame("x DOUBLE", (1.0,), (2.0,), (3.0,), (4.0,))
    assert tuple(exact_quantiles(df, ["x"]).first()) == (1.75, 2.5, 3.25)


def test_group_with_only_missing_values(frame):
    df = frame("g STRING, x DOUBLE", ("a", None), ("a", NAN), ("a", None), ("b", 1.0), ("b", 3.0))
    got = {r[0]: r[2] for r in rows(exact_quantiles(df, ["x"], ["g"]))}
    assert got == {"a": None, "b": 2.0}


def test_keys_keep_the_order_of_values(frame):
    rng = random.Random(5)
    edge = [0.0, -0.0, 5e-324, 1e-308, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf")]
    around = [float(np.nextafter(2.0**k, side)) for k in range(-60, 60) for side in (-np.inf, np.inf)] + [2.0**k for k in range(-1022, 1024)]
    some = [rng.uniform(1, 2) * 2.0 ** rng.randrange(-300, 300) for _ in range(2000)]
    data = sorted({v * sign for v in [*edge, *around, *some] for sign in (1, -1)})
    keys = [r.k for r in frame("x DOUBLE", *[(v,) for v in data]).select("x", order_key(F.col("x")).alias("k")).orderBy("x").collect()]
    assert all(a <= b for a, b in zip(keys, keys[1:]))
    assert len(set(keys)) > 0.95 * len(keys)  # direct neighbours may share a key


def test_values_of_one_cell_and_extremes(frame):
    close = [1.0 + k * 2**-50 for k in range(3000)] + [-1e308, 1e308, float("inf"), -float("inf"), 0.0]
    row = exact_quantiles(frame("x DOUBLE", *[(v,) for v in close]), ["x"], probs=(0.0, 0.1, 0.5, 1.0)).first()
    assert row[0] == -float("inf") and row[3] == float("inf")
    assert [row[1], row[2]] == [float(np.quantile(close, p)) for p in (0.1, 0.5)]


def test_no_window_orders_a_whole_group(mixed):
    """Running sums go over counted cells, over slices of a cell, or over the values of one slice."""
    df, _ = mixed
    plan = exact_quantiles(df, ["x"], ["g"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 1 and "__cell#" in windows[0] and "__slice#" in windows[0] and "NestedLoop" not in plan


def test_bands(frame):
    q1, q2, q3, q4 = QUARTILE_LABELS
    data = [("a", float(i)) for i in (1, 2, 3, 4)] + [("a", None), ("a", NAN), (None, 1.0)] + [("b", 5.0)] * 3
    out = quantile_bands(frame("g STRING, x DOUBLE", *data), ["x"], ["g"])
    assert out.columns == ["g", "x", "x_quartile"]
    got = sorted(((r.g, str(r.x), r.x_quartile) for r in out.collect()), key=repr)
    assert got == sorted([
        ("a", "1.0", q1), ("a", "2.0", q2), ("a", "3.0", q3), ("a", "4.0", q4), ("a", "None", None),
        ("a", "nan", None), (None, "1.0", None), ("b", "5.0", q1), ("b", "5.0", q1), ("b", "5.0", q1),
    ], key=repr)


def test_bands_cover_every_present_value(mixed):
    df, groups = mixed
    out = quantile_bands(df, ["x"], ["g"]).where("g IS NOT NULL")
    n = out.where(F.col("x_quartile").isNotNull()).count()
    assert n == sum(len(v) for v in groups.values())
