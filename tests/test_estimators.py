"""Golden vectors and properties of the numpy kernels."""

import itertools

import numpy as np
import pytest

from geodrift.functions.geodesy import geodesic_metres, mercator_xy, utm_xy
from geodrift.operators.midas import Midas, both_ways, midas, year_pairs
from geodrift.operators.robust import l1_line, robust_linear_fit
from geodrift.operators.trend import interannual_slopes

A_DAYS, A_VALUES = np.array([0, 365, 400, 765, 1200]), np.array([0.0, 0.010, 0.013, 0.024, 0.030])


def test_pairs_of_fixtures():
    assert year_pairs(A_DAYS / 365.25).tolist() == [[0, 1], [1, 3], [2, 3], [3, 4]]
    assert both_ways(A_DAYS / 365.25)[4:].tolist() == [[3, 4], [2, 3], [0, 2], [0, 1]]
    assert year_pairs(np.array([0, 1, 2, 500, 600, 700]) / 365.25).tolist() == [[0, 3], [1, 4], [2, 5]]


@pytest.mark.parametrize("seed", range(60))
def test_properties_of_pairs(seed):
    """What the rule promises of any series; the driver queries hold whole pair lists against recursive SQL."""
    r = np.random.default_rng(seed)
    t = np.sort(r.choice(1500, r.integers(2, 160), replace=False)) / 365.25
    steps = np.sort(r.uniform(0, 4, r.integers(0, 4))) if seed % 2 else np.zeros(0)
    for times, jumps in ((t, steps), (-t[::-1], np.sort(-steps))):
        pairs = year_pairs(times, jumps)
        first, second = pairs[:, 0], pairs[:, 1]
        assert (np.diff(first) > 0).all()
        year = np.abs(times[None, :] - times[:, None] - 1) < 0.001
        apart = np.searchsorted(jumps, times)[None, :] != np.searchsorted(jumps, times)[:, None] if len(jumps) else np.zeros_like(year)
        clear = ~(np.abs(times[:, None] - jumps[None, :]) < 0.003).any(1) if len(jumps) else np.ones(len(times), bool)
        partner = dict(pairs.tolist())
        for i in np.flatnonzero((year & ~apart).any(1) & clear):
            j = int(np.flatnonzero(year[i] & ~apart[i])[0])
            if clear[j]:
                assert partner[i] == j  # an epoch a year on, the first of them, is the partner
        assert not apart[first[clear[first] & clear[second]], second[clear[first] & clear[second]]].any()
        gaps = np.abs(times[second] - times[first] - 1) >= 0.001
        taken = second[gaps]
        rises = np.split(taken, np.flatnonzero(np.diff(taken) < 0) + 1)
        # until the epochs run out, no epoch serves two gaps
        assert all((np.diff(x[x < len(times) - 1]) > 0).all() for x in rises if not len(jumps))


def test_midas_of_fixture():
    m = midas(A_DAYS / 365.25, A_VALUES)
    assert m.velocity == pytest.approx(0.011007534246575341) and m.velocity_uncertainty == pytest.approx(0.00424148862424501)
    assert m.velocity_scatter == pytest.approx(0.0013816169152397262) and m.outlier_fraction == 0.25 and m.reference_position == pytest.approx(0, abs=1e-15)
    assert m.residuals == pytest.approx([0, -0.001, 0.00094521, 0.00094521, -0.00616438], abs=1e-8)
    scaled = 1000 * m
    assert scaled.velocity == pytest.approx(11.0075342) and scaled.outlier_fraction == 0.25 and isinstance(scaled, Midas)


def test_midas_degenerate_and_equivariant():
    t = np.arange(0, 1200, 7) / 365.25
    flat = midas(t, np.ones(len(t)))
    assert np.isnan(flat.velocity) and flat.outlier_fraction == 1
    assert np.isnan(midas(t[:20], t[:20]).velocity)
    y = np.random.default_rng(1).normal(size=len(t)).cumsum()
    assert midas(t, 3 * y + 5).velocity == pytest.approx(3 * midas(t, y).velocity)
    assert midas(t, y + 2 * t).velocity == pytest.approx(midas(t, y).velocity + 2)


def test_theil_sen_of_fixture():
    slopes = interannual_slopes(A_DAYS.astype(float), A_VALUES)
    assert sorted(slopes) == pytest.approx(sorted([0.010 / 365, 0.011 / 365])) and np.median(slopes) == pytest.approx(2.8767123287671234e-05)
    r = np.random.default_rng(5)
    t, y = np.sort(r.choice(2000, 150, replace=False)).astype(float), r.normal(size=150)
    want = [(y[j] - y[i]) / (t[j] - t[i]) for i, j in itertools.combinations(range(150), 2) if t[j] - t[i] > 180 and abs((t[j] - t[i] + 180) % 365 - 180) < 30]
    assert sorted(interannual_slopes(t, y)) == pytest.approx(sorted(want))


@pytest.mark.parametrize("seed", range(25))
def test_l1_reaches_the_minimum(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(3, 14))
    x, y, w = np.round(r.uniform(0, 5, n), 1), np.round(r.normal(size=n), 2), r.uniform(0.5, 2, n) if seed % 2 else np.ones(n)
    if len(np.unique(x)) < 2:
        return
    lines = [((y[j] - y[i]) / (x[j] - x[i]), i) for i, j in itertools.combinations(range(n), 2) if x[i] != x[j]]
    best = min(np.sum(w * np.abs(y - s * x - (y[i] - s * x[i]))) for s, i in lines)
    a, b = l1_line(x, y, w)
    assert np.sum(w * np.abs(y - a * x - b)) == pytest.approx(best, rel=1e-9, abs=1e-9)


def test_robust_fit_shapes():
    x = np.arange(10.0)
    fits, cov = robust_linear_fit(x, np.stack([2 * x + 1, -x], 1), return_cov=True)
    assert fits == pytest.approx(np.array([[2, -1], [1, 0]]), abs=1e-9) and cov.shape == (2, 2)
    assert robust_linear_fit(x, 2 * x + 1) == pytest.approx([2, 1])


def test_geodesy():
    zero, one = np.zeros(1), np.ones(1)
    assert geodesic_metres(zero, zero, one, zero)[0] == pytest.approx(111319.4908, abs=1e-3)
    assert geodesic_metres(zero, zero, zero, 90 * one)[0] == pytest.approx(10001965.729, abs=1e-2)
    assert geodesic_metres(one, one, one, one)[0] == 0
    x, y = utm_xy(np.array([3.0, 2.2945]), np.array([0.0, 48.8582]), 31)
    assert (x[0], y[0]) == pytest.approx((500000, 0), abs=1e-6) and (x[1], y[1]) == pytest.approx((448251.8, 5411932.68), abs=0.2)
    assert mercator_xy(np.array([180.0]), np.array([0.0]))[0][0] == pytest.approx(20037508.342789, abs=1e-5)


def brute_sum(x, y):
    """Least sum over all lines through two points."""
    i, j = np.triu_indices(len(x), 1)
    i, j = i[x[i] != x[j]], j[x[i] != x[j]]
    slope = (y[j] - y[i]) / (x[j] - x[i])
    return np.abs(y - slope[:, None] * x - (y[i] - slope * x[i])[:, None]).sum(1).min()


def test_robust_lines_of_daily_fixture(spark):
    import datetime

    from geodrift.operators.robust import robust_lines

    r, rows, want = np.random.default_rng(8), [], {}
    for k in range(6):
        days = np.sort(r.choice(400, 70, replace=False))
        y = np.round(0.01 * days * k + r.standard_t(2, 70), r.integers(0, 6))
        rows += [(f"s{k}", datetime.date(2001, 1, 1) + datetime.timedelta(int(d)), float(v)) for d, v in zip(days, y)]
        want[f"s{k}"] = brute_sum((days - days[0]) / 365.25, y)
    got = {x.station: x for x in robust_lines(spark.createDataFrame(rows, "station string, date date, value double")).collect()}
    assert {s: x.objective for s, x in got.items()} == pytest.approx(want, rel=1e-9) and all(x.n == 70 for x in got.values())


def test_robust_fit_runs_over_whole_daily_series(spark):
    from geodrift.plans import adapters
    from geodrift.plans.queries import QUERIES

    d, series = "/root/testdata/sf0.001", {}
    for x in adapters.dense(spark, d).collect():
        series.setdefault(x.station, []).append((x.date, x.value))
    got = {x.station: x for x in QUERIES["robust_fit_daily"](spark, d).collect()}
    assert got.keys() == series.keys()
    for station, points in series.items():
        line, points = got[station], sorted(points)
        x, y = np.array([(p[0] - points[0][0]).days / 365.25 for p in points]), np.array([float(p[1]) for p in points])

        def total(slope):
            return np.abs(y - slope * x - np.median(y - slope * x)).sum()

        assert line.n == len(points) and line.objective == pytest.approx(np.abs(y - line.slope * x - line.intercept).sum(), rel=1e-12)
        # the sum is convex in the slope, so a least one nearby is the least
        assert all(line.objective <= total(line.slope + s * e) + 1e-9 for e in (1e-6, 1e-4, 1e-2, 1.0) for s in (-1, 1))
