"""Seasonal autoregressions of many short series, with fitted values and intervals.

x is differenced at the season s if its seasonal strength is high (D = 1);
w, the result, follows phi(B) Phi(B^s) (w_t - m) = e_t with phi of order p <= 3,
Phi of order P <= 1, and m a mean (D = 0) or s times the monthly drift (D = 1),
or 0.  Every model of the grid is fitted by conditional least squares, with
deviations before the first value taken as 0, so all models explain the same
values and their AICc compare.  Series are a key's few hundred periods at most; each is
one group of `applyInPandas`, and groups are fitted in parallel.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_Z95 = 1.959963984540054
_T975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228]  # fixed values: Student's t, 1 to 10 degrees


@dataclass(frozen=True)
class SeasonalAR:
    d: int
    phi: np.ndarray
    seasonal: np.ndarray
    mean: float | None
    sigma2: float
    sse: float
    aicc: float
    period: int

    @property
    def drift(self) -> float | None:
        return None if self.mean is None or not self.d else self.mean / self.period


def seasonal_strength(x: np.ndarray, period: int) -> float:
    """1 - Var(remainder) / Var(seasonal + remainder) of a classical decomposition (0 to 1); 0 below two seasons."""
    n = len(x)
    if n < 2 * period + 1:
        return 0.0
    weight = np.ones(period + 1 - period % 2)
    if period % 2 == 0:
        weight[[0, -1]] = 0.5
    half = len(weight) // 2
    inner = np.arange(half, n - half)
    detrended = x[inner] - np.convolve(x, weight / weight.sum(), "valid")
    months = inner % period
    season = np.array([detrended[months == k].mean() if (months == k).any() else 0.0 for k in range(period)])
    rest = detrended - (season - season.mean())[months]
    whole = float(np.var(detrended))
    return max(0.0, 1 - float(np.var(rest)) / whole) if whole > 0 else 0.0


def lag_polynomial(phi: np.ndarray, seasonal: np.ndarray, period: int) -> np.ndarray:
    """Coefficients a of w_t - m = sum a_j (w_{t-j} - m) + e_t of the product polynomial (a[0] is lag 1)."""
    one = np.concatenate(([1.0], -phi))
    two = np.zeros(1 + period * len(seasonal))
    two[0] = 1.0
    two[period::period] = -seasonal
    return -np.convolve(one, two)[1:]


def _lagged(z: np.ndarray, k: int) -> np.ndarray:
    return z if k == 0 else np.concatenate((np.zeros(min(k, len(z))), z[:-k] if k < len(z) else z[:0]))


def residuals(w: np.ndarray, phi, seasonal, mean: float, period: int) -> np.ndarray:
    z = w - mean
    return z - sum((a * _lagged(z, j) for j, a in enumerate(lag_polynomial(phi, seasonal, period), start=1) if a), np.zeros(len(z)))


def fit_seasonal_ar(w: np.ndarray, p: int, seasonal: int, with_mean: bool, period: int, rounds: int = 60):
    """Conditional least squares by Gauss-Newton with step halving: (phi, Phi, mean or None, SSE)."""
    n = len(w)
    theta = np.concatenate((np.zeros(p + seasonal), [w.mean()] if with_mean else []))

    def parts(th):
        return th[:p], th[p:p + seasonal], th[-1] if with_mean else 0.0

    def errors(th):
        return residuals(w, *parts(th), period)
    e = errors(theta)
    sse = float(e @ e)
    for _ in range(rounds if len(theta) else 0):
        phi, big, m = parts(theta)
        z = w - m
        cols = []
        sz = z - sum((b * _lagged(z, period * (j + 1)) for j, b in enumerate(big)), np.zeros(n))      # Phi(B^s) z
        pz = z - sum((a * _lagged(z, i + 1) for i, a in enumerate(phi)), np.zeros(n))                 # phi(B) z
        cols += [-_lagged(sz, i + 1) for i in range(p)]
        cols += [-_lagged(pz, period * (j + 1)) for j in range(seasonal)]
        if with_mean:
            one = np.ones(n)
            cols.append(-(one - sum((a * _lagged(one, j) for j, a in enumerate(lag_polynomial(phi, big, period), start=1)), np.zeros(n))))
        step = np.linalg.lstsq(np.column_stack(cols), -e, rcond=None)[0]
        scale = 1.0
        while scale > 1e-6:
            new = theta + scale * step
            ne = errors(new)
            if float(ne @ ne) < sse:
                break
            scale /= 2
        else:
            break
        gain = sse - float(ne @ ne)
        theta, e, sse = new, ne, float(ne @ ne)
        if gain <= 1e-12 * sse:
            break
    phi, big, m = parts(theta)
    return phi, big, (float(m) if with_mean else None), sse


def _stationary(phi: np.ndarray, seasonal: np.ndarray) -> bool:
    for c in (phi, seasonal):
        if len(c) and np.abs(np.roots(np.concatenate(([1.0], -c)))).max() > 1 / 1.01:
            return False
    return True


def aicc(sse: float, n: int, k: int) -> float:
    """Of a Gaussian model with k coefficients and a variance; infinite where n leaves no room."""
    if n - k - 2 <= 0 or sse <= 0:
        return math.inf if n - k - 2 <= 0 else -math.inf
    q = k + 1
    return n * (math.log(2 * math.pi * sse / n) + 1) + 2 * q + 2 * q * (q + 1) / (n - q - 1)


def grid(x: np.ndarray, period: int = 12, max_p: int = 3, max_seasonal: int = 1, strength: float = 0.64) -> list[SeasonalAR]:
    """Every stationary model of the grid, fitted: the seasonal difference by rule, then p, P and the mean."""
    n = len(x)
    d = int(n >= 3 * period and seasonal_strength(x, period) > strength)
    w = x[period:] - x[:-period] if d else x
    out = []
    for p in range(max_p + 1):
        for big in range(max_seasonal + 1 if len(w) > period + 1 else 1):
            for with_mean in (True, False):
                phi, sea, m, sse = fit_seasonal_ar(w, p, big, with_mean, period)
                k = p + big + with_mean
                if _stationary(phi, sea):
                    out.append(SeasonalAR(d, phi, sea, m, sse / max(len(w) - k, 1), sse, aicc(sse, len(w), k), period))
    return out


def select(x: np.ndarray, period: int = 12, **options) -> SeasonalAR:
    """The model of least AICc (ties: fewer coefficients)."""
    return min(grid(x, period, **options), key=lambda f: (f.aicc, len(f.phi) + len(f.seasonal)))


def psi_weights(model: SeasonalAR, h: int) -> np.ndarray:
    """psi_0 .. psi_{h-1} of x = psi(B) e: the recursion of the product polynomial times the seasonal difference."""
    full = np.concatenate(([1.0], -lag_polynomial(model.phi, model.seasonal, model.period)))
    if model.d:
        diff = np.zeros(model.period + 1)
        diff[0], diff[-1] = 1.0, -1.0
        full = np.convolve(full, diff)
    psi = np.zeros(h)
    psi[0] = 1.0
    for j in range(1, h):
        m = min(j, len(full) - 1)
        psi[j] = -full[1:m + 1] @ psi[j - 1::-1][:m]
    return psi


def fitted_and_forecast(x: np.ndarray, model: SeasonalAR, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step fitted values (nan where the difference leaves none), h forecasts, and their standard errors."""
    s, mean = model.period, model.mean or 0.0
    w = x[s:] - x[:-s] if model.d else x
    e = residuals(w, model.phi, model.seasonal, mean, s)
    fitted = x.astype(float).copy()
    fitted[len(x) - len(w):] -= e
    fitted[:len(x) - len(w)] = np.nan
    a = lag_polynomial(model.phi, model.seasonal, s)
    z, xs = list(w - mean), list(x)
    for _ in range(h):
        z.append(sum(c * z[-j] for j, c in enumerate(a, start=1) if c and j <= len(z)))
        xs.append(z[-1] + mean + (xs[-s] if model.d else 0.0))
    se = np.sqrt(model.sigma2 * np.cumsum(psi_weights(model, h) ** 2)) if h else np.zeros(0)
    return fitted, np.array(xs[len(x):]), se


def t_quantile(dof: int) -> float:
    """97.5 % point of Student's t: the table up to 10, then an expansion in 1 / dof."""
    if dof <= len(_T975):
        return _T975[max(dof, 1) - 1]
    z = _Z95
    return z + (z ** 3 + z) / (4 * dof) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * dof ** 2)


def trend_and_intervals(t: np.ndarray, y: np.ndarray, at: np.ndarray, design) -> tuple[np.ndarray, np.ndarray]:
    """Least squares of y on design(t): predictions at `at` and half widths of their 95 % prediction intervals."""
    a = design(t)
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    dof = len(y) - a.shape[1]
    if dof <= 0:
        return design(at) @ beta, np.full(len(at), np.nan)
    s2 = float(((y - a @ beta) ** 2).sum()) / dof
    b = design(at)
    lever = np.einsum("ij,jk,ik->i", b, np.linalg.pinv(a.T @ a), b)
    return b @ beta, t_quantile(dof) * np.sqrt(s2 * (1 + lever))


MODEL = ("seasonal_difference int, p int, seasonal_p int, ar1 double, ar2 double, ar3 double, sar1 double, mean double, drift double, "
         "sigma2 double, aicc double, n int")


def _each(series: DataFrame, keys: list[str], t: str, y: str, schema: str, run) -> DataFrame:
    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(t)
        out = run(g[t].to_numpy(), g[y].to_numpy(dtype=float))
        for k in reversed(keys):
            out.insert(0, k, str(g[k].iloc[0]))
        return out
    src = series.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(t).cast("int").alias(t), F.col(y).cast("double").alias(y))
    return src.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} string" for k in keys) + ", " + schema)


def seasonal_ar_models(series: DataFrame, keys: list[str], t: str, y: str, horizon: int = 0, period: int = 12) -> DataFrame:
    """keys..., MODEL: the selected model of every series, on all but the last `horizon` periods."""
    def run(_, x):
        m = select(x[:len(x) - horizon], period)
        c = [*m.phi, None, None, None][:3]
        return pd.DataFrame([dict(seasonal_difference=m.d, p=len(m.phi), seasonal_p=len(m.seasonal), ar1=c[0], ar2=c[1], ar3=c[2],
                                  sar1=m.seasonal[0] if len(m.seasonal) else None, mean=m.mean, drift=m.drift, sigma2=m.sigma2,
                                  aicc=m.aicc, n=len(x) - horizon)])
    return _each(series, keys, t, y, MODEL, run)


def fitted_rows(series: DataFrame, keys: list[str], t: str, y: str, horizon: int, design, period: int = 12) -> DataFrame:
    """keys..., method, t, kind, value, lo, hi: of every series the fitted values of the training periods and the
    forecasts of the last `horizon` periods with 95 % intervals, by the selected seasonal autoregression (`sar`) and by
    least squares on `design` of the period (`trend`).  Fitted rows of sar have the one-step interval."""
    def run(ts, x):
        n = len(x) - horizon
        m = select(x[:n], period)
        fitted, ahead, se = fitted_and_forecast(x[:n], m, horizon)
        half = _Z95 * np.concatenate((np.full(n, math.sqrt(m.sigma2)), se))
        sar = np.concatenate((fitted, ahead))
        trend, width = trend_and_intervals(ts[:n].astype(float), x[:n], ts.astype(float), design)
        kind = np.where(np.arange(len(x)) < n, "fitted", "forecast")
        both = [pd.DataFrame({"method": name, t: ts, "kind": kind, "value": v, "lo": v - h, "hi": v + h})
                for name, v, h in (("sar", sar, half), ("trend", trend, width))]
        out = pd.concat(both, ignore_index=True)
        return out[out["value"].notna()].reset_index(drop=True)
    return _each(series, keys, t, y, f"method string, {t} int, kind string, value double, lo double, hi double", run)
