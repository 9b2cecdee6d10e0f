"""Local polynomials and the Gaussian process against NumPy."""

import numpy as np
import pytest

from wheelmark.operators import smoothing

KT = 1852 / 3600


def samples():
    rng = np.random.default_rng(4)
    out = []
    for name, n in (("A", 23), ("B", 4), ("C", 2), ("D", 1), ("E", 40)):
        t = 1000 + np.cumsum(rng.uniform(1, 6, n))
        v = 70 - 8 * np.tanh((t - t[n // 2]) / 10) + rng.normal(0, 0.4, n)
        out += [(name, k, float(a), float(b / KT)) for k, (a, b) in enumerate(zip(t, v, strict=True))]
    return [*out, ("A", 99, None, 100.0), ("A", 98, 1001.0, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(samples(), "flight_id string, seq int, t double, gs_kt double").repartition(3)


def sides(knees):
    by: dict = {}
    for f, seq, t, v in samples():
        if t is not None and v is not None:
            by.setdefault((f, int(t >= knees[f]) if f in knees else 0), []).append((t, seq, v * KT))
    return {k: np.array([(t, v) for t, _, v in sorted(x)]).T for k, x in by.items()}


def fitted(u, y, w, order):
    """Coefficients and covariance by NumPy, on scaled times."""
    n, p, h = len(u), order + 1, max(np.abs(u).max(), 1e-9)
    x = np.vander(u / h, p, increasing=True)
    inverse = np.linalg.inv(x.T @ (w[:, None] * x))
    beta = inverse @ (x.T @ (w * y))
    left = y - x @ beta
    cov = inverse * float(w @ left**2) / (w.sum() / n * max(n - p, 1))
    scale = h ** -np.arange(p)
    return beta * scale, np.diag(cov) * scale**2


@pytest.mark.parametrize("method, window, order, knees", [("savgol", 5, 1, {}), ("savgol", 7, 2, {"A": 1040.0}), ("savgol", 7, 3, {}), ("savgol", 9, 4, {"E": 1060.0}), ("gp", 0, 2, {"A": 1040.0})])
def test_local_fits(spark, rows, method, window, order, knees):
    table = spark.createDataFrame(list(knees.items()) or [("none", 0.0)], "flight_id string, t_knee double")
    got = {(r.flight_id, round(r.t, 6)): r for r in smoothing.smoothed_derivatives(rows, method, window or 7, order, 8.0, 0.5, table).collect()}
    assert len(got) == 70
    for (flight, _), (t, v) in sides(knees).items():
        for k in range(len(t)):
            r = got[flight, round(t[k], 6)]
            near = np.argsort(np.abs(t - t[k]), kind="stable")[:window] if method == "savgol" else np.flatnonzero(np.abs(t - t[k]) <= 24)
            u = t[near] - t[k]
            w = np.ones(len(near)) if method == "savgol" else np.exp(-((u / 8) ** 2) / 2)
            eff = min(order, len(near) - 1)
            assert r.n == len(near)
            if eff < 1:
                assert r.decel is None and r.jerk is None
                continue
            beta, var = fitted(u, v[near], w, eff)
            least = 0.5 / w.sum() if method == "gp" else 0
            assert (r.value, r.decel) == pytest.approx((beta[0], beta[1]), rel=1e-6, abs=1e-7)
            assert (r.value_var, r.decel_var) == pytest.approx((var[0], max(var[1], least)), rel=1e-4, abs=1e-9)
            assert r.jerk == pytest.approx(2 * beta[2] if eff > 1 else 0, rel=1e-6, abs=1e-7)
            assert r.jerk_var == (pytest.approx(4 * var[2], rel=1e-4, abs=1e-9) if eff > 1 else None)


@pytest.mark.parametrize("stretch", [200, 9])
def test_process(spark, rows, monkeypatch, stretch):
    monkeypatch.setattr(smoothing, "STRETCH", stretch)
    got = {(r.flight_id, round(r.t, 6)): r for r in smoothing.smoothed_derivatives(rows, "process", length_s=4.0, noise=0.3).collect()}
    for (flight, _), (t, v) in sides({}).items():
        if len(t) < 2:
            assert got[flight, round(t[0], 6)].decel is None
            continue
        slope, level = np.polyfit(t - t.mean(), v, 1)
        rest = v - level - slope * (t - t.mean())
        power = max(rest @ rest / len(t) - 0.3, 0.03)
        f = lambda x: power * np.exp(-((np.subtract.outer(x, t) / 4.0) ** 2) / 2)
        inverse = np.linalg.inv(f(t) + 0.3 * np.eye(len(t)))
        for k, x in enumerate(t):
            r, e = got[flight, round(x, 6)], 1e-3
            mean = lambda at: level + slope * (at - t.mean()) + (f(np.array([at])) @ inverse @ rest)[0]
            loose = {"rel": 2e-2, "abs": 2e-2} if stretch == 9 else {"rel": 1e-4, "abs": 1e-5}
            if stretch == 200:
                assert r.value == pytest.approx(mean(x)) and r.value_var == pytest.approx(power - (f(t[k : k + 1]) @ inverse @ f(t[k : k + 1]).T)[0, 0], abs=1e-9)
                assert r.decel == pytest.approx((mean(x + e) - mean(x - e)) / (2 * e), **loose) and r.jerk == pytest.approx((mean(x + e) - 2 * mean(x) + mean(x - e)) / e**2, rel=1e-2, abs=1e-3)
                d1 = (f(np.array([x + e])) - f(np.array([x - e])))[0] / (2 * e)
                assert r.decel_var == pytest.approx(power / 16 - d1 @ inverse @ d1, rel=1e-3, abs=1e-6)
            assert r.decel_var >= 0 and r.jerk_var >= 0 and r.n <= len(t)


def test_reliability(spark, rows):
    got = {r.flight_id: (r.min_in_window, r.reliable) for r in smoothing.reliability(smoothing.smoothed_derivatives(rows, window=7)).collect()}
    assert got == {"A": (7, True), "B": (4, False), "C": (2, False), "D": (1, False), "E": (7, True)}
    with pytest.raises(ValueError):
        smoothing.local(rows, "spline")
