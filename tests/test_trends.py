import math

import numpy as np
import pytest

from helpers import rows
from weighbridge.functions.tdist import central_t
from weighbridge.operators.trends import correlations, fit_band, line_fit

NAN = float("nan")


def test_worked_fit(frame):
    df = frame("x DOUBLE, y DOUBLE", (1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (None, 7.0), (9.0, NAN))
    fit = line_fit(df, "x", "y").first()
    assert fit.n == 3
    assert fit.slope == pytest.approx(1.95) and fit.intercept == pytest.approx(0.1)
    assert fit.r2 == pytest.approx(0.998031, abs=1e-6)


@pytest.mark.parametrize("grouped", [False, True])
def test_band_against_the_formula(frame, grouped):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, 25)
    y = 3 * x + rng.normal(0, 2, 25)
    df = frame("g STRING, x DOUBLE, y DOUBLE", *[("a", float(a), float(b)) for a, b in zip(x, y)])
    out = fit_band(df, "x", "y", 0.8, ["g"] if grouped else ()).collect()
    slope, intercept = np.polyfit(x, y, 1)
    s = math.sqrt(np.sum((y - slope * x - intercept) ** 2) / 23)
    half = central_t(23, 0.8) * s * np.sqrt(1 / 25 + (x - x.mean()) ** 2 / np.sum((x - x.mean()) ** 2))
    want = {round(float(a), 9): (f - h, f, f + h) for a, f, h in zip(x, slope * x + intercept, half)}
    assert len(out) == 25
    for r in out:
        assert (r.band_low, r.fitted, r.band_high) == pytest.approx(want[round(r.x, 9)])


def test_band_of_two_points_has_no_width_estimate(frame):
    out = fit_band(frame("x DOUBLE, y DOUBLE", (1.0, 1.0), (2.0, 3.0)), "x", "y", 0.8).orderBy("x").collect()
    assert [r.fitted for r in out] == pytest.approx([1.0, 3.0])
    assert all(r.band_low is None and r.band_high is None for r in out)


def test_correlations(frame):
    rng = np.random.default_rng(9)
    m = rng.normal(0, 1, (200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) + 1e6
    data = [tuple(map(float, r)) for r in m] + [(None, 1.0, 2.0), (1.0, NAN, 2.0)]
    df = frame("a DOUBLE, b DOUBLE, c DOUBLE", *data)
    want = np.corrcoef(m, rowvar=False)
    full = {(r.var1, r.var2): r.r for r in correlations(df, ["a", "b", "c"], upper=False).collect()}
    assert len(full) == 9
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            assert full[p, q] == pytest.approx(want[i, j], abs=1e-9)
    assert len(rows(correlations(df, ["a", "b", "c"]))) == 6


def test_constant_column_has_no_correlation(frame):
    df = frame("a DOUBLE, b DOUBLE", (0.1, 1.0), (0.1, 2.0), (0.1, 5.0))
    got = {(r.var1, r.var2): r.r for r in correlations(df, ["a", "b"]).collect()}
    assert got["a", "a"] is None and got["a", "b"] is None and got["b", "b"] == pytest.approx(1.0)
