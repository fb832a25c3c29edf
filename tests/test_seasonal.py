"""Seasonal autoregressions: recovered coefficients, least AICc, intervals that cover, rows of the queries."""

import math

import numpy as np
import pytest

from kestrel.operators import seasonal as S
from kestrel.plans.catalog import QUERIES as Q
from tests.conftest import SF_SMALL


def simulate(rng, n, phi=(), big=(), mean=0.0, d=0, period=12, sigma=1.0, burn=200):
    a = S.lag_polynomial(np.array(phi, float), np.array(big, float), period)
    z = np.zeros(n + burn)
    e = rng.standard_normal(n + burn) * sigma
    for t in range(n + burn):
        z[t] = sum(c * z[t - j] for j, c in enumerate(a, start=1) if t - j >= 0) + e[t]
    w = z[burn:] + mean
    if not d:
        return w
    x = list(10 * np.sin(np.arange(period)) * 5)
    for v in w:
        x.append(x[-period] + v)
    return np.array(x)


@pytest.mark.parametrize("phi,big,mean,d", [((0.6,), (), 5.0, 0), ((0.5, -0.3), (0.5,), 0.0, 0), ((0.4,), (-0.55,), 6.0, 1),
                                            ((), (-0.5,), 3.0, 1), ((0.3, 0.2, 0.2), (), 0.0, 0)])
def test_recovers_coefficients(phi, big, mean, d):
    rng = np.random.default_rng(len(phi) * 7 + len(big))
    x = simulate(rng, 3000, phi, big, mean, d)
    w = x[12:] - x[:-12] if d else x
    p, s, m, sse = S.fit_seasonal_ar(w, len(phi), len(big), True, 12)
    assert list(p) == pytest.approx(list(phi), abs=0.06) and list(s) == pytest.approx(list(big), abs=0.06)
    assert m == pytest.approx(mean, abs=0.25)
    assert sse / len(w) == pytest.approx(1, abs=0.08)


def test_product_polynomial_and_psi_weights():
    a = S.lag_polynomial(np.array([0.5]), np.array([0.4]), 4)
    assert list(a) == pytest.approx([0.5, 0, 0, 0.4, -0.2])
    m = S.SeasonalAR(1, np.array([0.5]), np.array([0.4]), None, 1.0, 1.0, 0.0, 4)
    full = np.convolve(np.concatenate(([1.0], -a)), [1, 0, 0, 0, -1])
    psi = S.psi_weights(m, 30)
    assert np.convolve(full, psi)[:30] == pytest.approx([1.0] + [0.0] * 29, abs=1e-12)


@pytest.mark.parametrize("seed", range(4))
def test_gauss_newton_finds_the_least_error(seed):
    rng = np.random.default_rng(seed)
    w = simulate(rng, 60, (0.5,), (0.3,), 2.0)
    phi, big, m, sse = S.fit_seasonal_ar(w, 2, 1, True, 12)
    best = np.array([*phi, *big, m])
    for scale in (1e-4, 1e-2, 0.1, 0.5):
        for _ in range(300):
            th = best + scale * rng.standard_normal(4)
            e = S.residuals(w, th[:2], th[2:3], th[3], 12)
            assert float(e @ e) >= sse * (1 - 1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_selects_the_least_aicc(seed):
    rng = np.random.default_rng(10 + seed)
    x = simulate(rng, 78, (0.7,), (), 3.0) if seed else simulate(rng, 66, (), (-0.5,), 8.0, 1)
    fits, chosen = S.grid(x), S.select(x)
    assert chosen.aicc == min(f.aicc for f in fits)
    assert {(len(f.phi), len(f.seasonal), f.mean is None) for f in fits} <= {
        (p, b, c) for p in range(4) for b in range(2) for c in (True, False)}
    n = len(x) - 12 * chosen.d
    for f in fits:
        k = len(f.phi) + len(f.seasonal) + (f.mean is not None) + 1
        w = x[12:] - x[:-12] if f.d else x
        e = S.residuals(w, f.phi, f.seasonal, f.mean or 0.0, 12)
        ll = -n / 2 * (math.log(2 * math.pi * float(e @ e) / n) + 1)
        assert f.aicc == pytest.approx(-2 * ll + 2 * k + 2 * k * (k + 1) / (n - k - 1))
    assert chosen.d == (0 if seed else 1)


def test_intervals_cover():
    rng = np.random.default_rng(3)
    hit = {0: [], 5: []}
    for i in range(400):
        x = simulate(rng, 96 + 6, (0.6,), (), 20.0) if i % 2 else simulate(rng, 90 + 6, (), (-0.4,), 5.0, 1)
        n = len(x) - 6
        model = S.select(x[:n])
        _, f, se = S.fitted_and_forecast(x[:n], model, 6)
        for h in hit:
            hit[h].append(abs(x[n + h] - f[h]) <= 1.96 * se[h])
    assert all(0.88 <= np.mean(v) <= 0.98 for v in hit.values())


def test_fitted_values_leave_the_residuals():
    rng = np.random.default_rng(4)
    x = simulate(rng, 60, (0.4,), (0.2,), 3.0, 1)
    phi, big, m, sse = S.fit_seasonal_ar(x[12:] - x[:-12], 1, 1, True, 12)
    fitted, _, _ = S.fitted_and_forecast(x, S.SeasonalAR(1, phi, big, m, 1.0, sse, 0.0, 12), 0)
    assert np.isnan(fitted[:12]).all()
    assert float(np.nansum((x - fitted) ** 2)) == pytest.approx(sse)


def test_odd_series():
    for x in (np.zeros(40), np.full(50, 3.0), np.arange(8.0), np.array([1.0, 2.0]), np.tile(np.arange(12.0), 5)):
        m = S.select(x)
        fitted, f, se = S.fitted_and_forecast(x, m, 6)
        assert len(f) == 6 and np.isfinite(f).all() and len(fitted) == len(x)
    assert S.t_quantile(1) == 12.706 and S.t_quantile(30) == pytest.approx(2.0423, abs=1e-3)


def test_trend_interval_of_a_line():
    t = np.arange(20.0)
    rng = np.random.default_rng(1)
    y = 2 + 3 * t + rng.standard_normal(20)
    f, half = S.trend_and_intervals(t, y, np.array([9.5, 30.0]), lambda v: np.column_stack([np.ones_like(v), v]))
    s = math.sqrt(((y - np.polyval(np.polyfit(t, y, 1), t)) ** 2).sum() / 18)
    assert half[0] == pytest.approx(2.1009 * s * math.sqrt(1 + 1 / 20), rel=1e-3) and half[1] > half[0]
    assert f[1] == pytest.approx(np.polyval(np.polyfit(t, y, 1), 30.0))


def test_queries(spark):
    m = Q["monthly_series"](spark, SF_SMALL).toPandas().sort_values("t")
    last = m.t.max()
    models = {(r["market"], r["segment"], r["measure"]): r for r in Q["ts_seasonal_ar"](spark, SF_SMALL).collect()}
    assert len(models) == 3 * len(m[["market", "segment"]].drop_duplicates())
    rows = Q["ts_fitted_forecast"](spark, SF_SMALL).toPandas()
    for key, r in list(models.items())[::7]:
        x = m[(m.market == key[0]) & (m.segment == key[1])][key[2]].to_numpy(float)
        best = S.select(x[:-6])
        assert r["aicc"] == pytest.approx(best.aicc) and (r["p"], r["seasonal_p"]) == (len(best.phi), len(best.seasonal))
        _, f, se = S.fitted_and_forecast(x[:-6], best, 6)
        part = rows[(rows.market == key[0]) & (rows.segment == key[1]) & (rows.measure == key[2])]
        ahead = part[(part.method == "sar") & (part.kind == "forecast")].sort_values("t")
        assert ahead.t.tolist() == list(range(last - 5, last + 1))
        assert ahead.value.tolist() == pytest.approx(list(f)) and ahead.hi.tolist() == pytest.approx(list(f + S._Z95 * se))
        assert (part[(part.method == "trend")].t.tolist()) and len(part[part.method == "trend"]) == len(x)
    j = rows[rows.kind == "forecast"]
    assert (j.lo.isna() | (j.lo <= j.value)).all()
    for r in Q["ts_measure_compare"](spark, SF_SMALL).collect():
        assert 0 <= r["covered"] <= 6
