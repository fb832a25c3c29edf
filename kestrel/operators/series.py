"""Keyed time series (N1-N8), many series at once.

The heavy part — turning detail rows into one value per (key, period) — is a
distributed grouped aggregate.  Everything after that works on the
aggregated series, whose length is the number of periods (months/weeks), not
the data size: window expressions per key, and per-series numpy fits through
`applyInPandas` (one series per group, fitted in parallel across keys).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.columns import exact_sum
from kestrel.session import ensure_checkpoint_dir


def month_index(d: Column, first: Column) -> Column:
    """1-based month number counted from the first month."""
    return (F.floor(F.months_between(F.trunc(d, "MM"), F.trunc(first, "MM"))) + 1).cast("int")


def dense_monthly(df: DataFrame, keys: list[str], date: Column, measures: list[str]) -> DataFrame:
    """One row per (key, month index) with the summed measures,
    densified over 1..last month of the data (missing months = 0) so lags
    and windows never skip a gap.  The detail rows are read once, into a
    (key, month) aggregate that is checkpointed; the month range, the dense
    grid and all that follows are derived from that small table (explode of a
    sequence per key, no cartesian join)."""
    m = df.select(*keys, F.trunc(date, "MM").alias("__m"), *measures)
    ensure_checkpoint_dir(df.sparkSession)
    agg = m.groupBy(*keys, "__m").agg(*[exact_sum(c).alias(c) for c in measures]).checkpoint(eager=True)
    rng = agg.agg(F.struct(F.min("__m").alias("a"), F.max("__m").alias("b"))).scalar()
    agg = agg.withColumn("t", month_index(F.col("__m"), rng["a"])).drop("__m")
    last = month_index(rng["b"], rng["a"])
    grid = agg.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(1), last)))
    return grid.join(agg, [*keys, "t"], "left").fillna(0.0, subset=measures).select(*keys, "t", *measures)


def centered_smooth(df: DataFrame, keys: list[str], t: str, col: str, w: int, out: str = "smoothed") -> DataFrame:
    """centred moving average over 2w+1 periods; the w undefined
    values at each end are extrapolated linearly from the first/last two
    smoothed values (left: s[w+1] - (w+1-i) * (s[w+2] - s[w+1]); right:
    s[n-w] + (i-n+w) * (s[n-w] - s[n-w-1])).  Assumes t = 1..n per key."""
    wk = Window.partitionBy(*keys).orderBy(t)
    frame = wk.rowsBetween(-w, w)
    s = F.when(F.count(F.lit(1)).over(frame) == 2 * w + 1, F.avg(col).over(frame))
    x = df.withColumn("__s", s).withColumn("__n", F.max(t).over(Window.partitionBy(*keys)))
    ends = x.groupBy(*keys).agg(
        F.max(F.when(F.col(t) == w + 1, F.col("__s"))).alias("__l1"),
        F.max(F.when(F.col(t) == w + 2, F.col("__s"))).alias("__l2"),
        F.max(F.when(F.col(t) == F.col("__n") - w, F.col("__s"))).alias("__r1"),
        F.max(F.when(F.col(t) == F.col("__n") - w - 1, F.col("__s"))).alias("__r0"))
    y = x.join(ends, keys)
    left = F.col("__l1") - (w + 1 - F.col(t)) * (F.col("__l2") - F.col("__l1"))
    right = F.col("__r1") + (F.col(t) - F.col("__n") + w) * (F.col("__r1") - F.col("__r0"))
    val = F.when(F.col(t) <= w, left).when(F.col(t) > F.col("__n") - w, right).otherwise(F.col("__s"))
    return y.withColumn(out, val).drop("__s", "__n", "__l1", "__l2", "__r1", "__r0")


def acf(df: DataFrame, keys: list[str], t: str, col: str, max_lag: int) -> DataFrame:
    """Sample autocorrelation per key and lag 1..max_lag:
    sum_t (x_t - m)(x_{t+k} - m) / sum_t (x_t - m)^2 (a self-join on t + k
    within each key's series)."""
    m = df.groupBy(*keys).agg(F.avg(col).alias("__m"))
    c = df.join(m, keys).select(*keys, t, (F.col(col) - F.col("__m")).alias("__d"))
    den = c.groupBy(*keys).agg(F.sum(F.col("__d") * F.col("__d")).alias("__den"))
    lags = c.select(*keys, F.col(t).alias("__t0"), "__d").withColumn(
        "lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
    nxt = c.select(*keys, (F.col(t)).alias("__t1"), F.col("__d").alias("__d1"))
    j = lags.join(nxt, [*[lags[k] == nxt[k] for k in keys], nxt["__t1"] == lags["__t0"] + lags["lag"]])
    num = j.groupBy(*[lags[k] for k in keys], "lag").agg(F.sum(F.col("__d") * F.col("__d1")).alias("__num"))
    return num.join(den, keys).select(*keys, "lag", (F.col("__num") / F.col("__den")).alias("acf"))


def pacf_from_acf(acf_df: DataFrame, keys: list[str]) -> DataFrame:
    """N4 (partial): Durbin-Levinson on each key's ACF values (a dozen
    numbers per key)."""
    schema = ", ".join(f"{k} string" for k in keys) + ", lag int, pacf double"

    def dl(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("lag")
        r = p["acf"].to_numpy(dtype=float)
        out, phi = [], np.zeros(0)
        for k in range(1, len(r) + 1):
            if k == 1:
                a = r[0]
                phi = np.array([a])
            else:
                num = r[k - 1] - np.dot(phi, r[k - 2::-1][: k - 1])
                den = 1 - np.dot(phi, r[: k - 1])
                a = num / den if den != 0 else np.nan
                phi = np.append(phi - a * phi[::-1], a)
            out.append(a)
        res = pd.DataFrame({"lag": p["lag"].to_numpy(), "pacf": out})
        for k in keys:
            res.insert(0, k, str(p[k].iloc[0]))
        return res[[*keys, "lag", "pacf"]]

    src = acf_df.select(*[F.col(k).cast("string").alias(k) for k in keys], "lag", "acf")
    return src.groupBy(*keys).applyInPandas(dl, schema)


# ------------------------------------------------- per-series model fitting
def _design(t: np.ndarray, freq: float = 0.5) -> np.ndarray:
    """Trend + sinusoid basis: 1, sin(ft), cos(ft), t, t sin(ft), t cos(ft)."""
    return np.column_stack([np.ones_like(t), np.sin(freq * t), np.cos(freq * t), t, t * np.sin(freq * t),
                            t * np.cos(freq * t)])


def fit_sinusoid_trend(series: DataFrame, keys: list[str], t: str, y: str,
                       horizon: int = 6) -> DataFrame:
    """Per series, least squares of y on the trend+sinusoid basis
    over the training periods (all but the last `horizon`), then the global
    prediction for every period.  Output: keys..., t, fitted."""
    schema = ", ".join(f"{k} string" for k in keys) + f", {t} int, fitted double"

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(t)
        tt = p[t].to_numpy(dtype=float)
        yy = p[y].to_numpy(dtype=float)
        n_train = len(tt) - horizon
        beta = np.linalg.lstsq(_design(tt[:n_train]), yy[:n_train], rcond=None)[0]
        res = pd.DataFrame({t: p[t].astype("int32").to_numpy(), "fitted": _design(tt) @ beta})
        for k in reversed(keys):
            res.insert(0, k, str(p[k].iloc[0]))
        return res

    src = series.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(t).cast("int").alias(t), y)
    return src.groupBy(*keys).applyInPandas(fit, schema)


def _ar_fit(x: np.ndarray, p: int):
    """AR(p) with intercept by least squares; returns (coef, sigma2, aicc)."""
    n = len(x)
    if n - p < p + 3:
        return None
    yv = x[p:]
    cols = [np.ones(n - p)] + [x[p - i: n - i] for i in range(1, p + 1)]
    xm = np.column_stack(cols)
    beta, *_ = np.linalg.lstsq(xm, yv, rcond=None)
    resid = yv - xm @ beta
    m = len(yv)
    sigma2 = float(resid @ resid) / m
    k = p + 2
    if sigma2 <= 0:
        return None
    ll = -0.5 * m * (math.log(2 * math.pi * sigma2) + 1)
    aic = -2 * ll + 2 * k
    aicc = aic + 2 * k * (k + 1) / max(m - k - 1, 1)
    return beta, sigma2, aicc


def ar_select_forecast(series: DataFrame, keys: list[str], t: str, y: str, horizon: int = 6,
                       max_p: int = 3) -> DataFrame:
    """N5/N6 (re-aimed auto.arima): per series, AR(p) p = 0..max_p with
    intercept fitted by least squares on the training periods, the lowest
    AICc wins; recursive forecasts for the last `horizon` periods.
    Output: keys..., p, aicc, t, forecast (test periods only)."""
    schema = ", ".join(f"{k} string" for k in keys) + f", p int, aicc double, {t} int, forecast double"

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(t)
        x = g[y].to_numpy(dtype=float)
        ts = g[t].to_numpy()
        train = x[:-horizon]
        best = None
        for p in range(0, max_p + 1):
            r = _ar_fit(train, p)
            if r is not None and (best is None or r[2] < best[2]):
                best = (p, r[0], r[2])
        p, beta, aicc = best
        hist = list(train)
        fc = []
        for _ in range(horizon):
            v = beta[0] + sum(beta[i] * hist[-i] for i in range(1, p + 1))
            fc.append(v)
            hist.append(v)
        res = pd.DataFrame({"p": p, "aicc": aicc, t: ts[-horizon:].astype("int32"), "forecast": fc})
        for k in reversed(keys):
            res.insert(0, k, str(g[k].iloc[0]))
        return res

    src = series.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(t).cast("int").alias(t), y)
    return src.groupBy(*keys).applyInPandas(fit, schema)


# KPSS level-stationarity critical values (10%, 5%, 2.5%, 1%).
KPSS_LEVEL = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
# Dickey-Fuller quantiles with constant and trend, by sample
# size 25, 50, 100, 250, 500, inf, at the eight tabulated probabilities.
DF_SIZES = [25, 50, 100, 250, 500, 100000]
DF_TREND = {
    0.01: [-4.38, -4.15, -4.04, -3.99, -3.98, -3.96],
    0.025: [-3.95, -3.80, -3.73, -3.69, -3.68, -3.66],
    0.05: [-3.60, -3.50, -3.45, -3.43, -3.42, -3.41],
    0.10: [-3.24, -3.18, -3.15, -3.13, -3.13, -3.12],
    0.90: [-1.14, -1.19, -1.22, -1.23, -1.24, -1.25],
    0.95: [-0.80, -0.87, -0.90, -0.92, -0.93, -0.94],
    0.975: [-0.50, -0.58, -0.62, -0.64, -0.65, -0.66],
    0.99: [-0.15, -0.24, -0.28, -0.31, -0.32, -0.33],
}


def kpss_stat(x: np.ndarray) -> tuple[float, float]:
    """Level KPSS with Bartlett long-run variance, lag trunc(4 (n/100)^(1/4));
    p-value interpolated in the critical-value table, clipped to [0.01, 0.1]."""
    n = len(x)
    e = x - x.mean()
    s = np.cumsum(e)
    lag = int(4 * (n / 100) ** 0.25)
    lrv = float(e @ e) / n
    for j in range(1, lag + 1):
        lrv += 2 * (1 - j / (lag + 1)) * float(e[j:] @ e[:-j]) / n
    stat = float((s @ s) / (n * n) / lrv)
    cv = [c for c, _ in KPSS_LEVEL]
    ps = [p for _, p in KPSS_LEVEL]
    return stat, float(np.interp(stat, cv, ps, left=0.10, right=0.01))


def adf_stat(x: np.ndarray) -> tuple[float, float]:
    """ADF with constant and trend, k = trunc((n-1)^(1/3)) lagged
    differences; statistic = gamma / se(gamma); p-value interpolated in the
    Dickey-Fuller table (clipped to [0.01, 0.99]).  A series too short to
    leave a degree of freedom gives NaN for both."""
    n = len(x)
    k = int((n - 1) ** (1 / 3))
    dx = np.diff(x)
    rows = []
    ys = []
    for i in range(k, len(dx)):
        rows.append([1.0, float(i + 1), x[i]] + [dx[i - j] for j in range(1, k + 1)])
        ys.append(dx[i])
    if len(ys) - 3 - k <= 0:
        return float("nan"), float("nan")
    a = np.array(rows)
    b = np.array(ys)
    beta, *_ = np.linalg.lstsq(a, b, rcond=None)
    resid = b - a @ beta
    dof = len(b) - a.shape[1]
    s2 = float(resid @ resid) / dof
    cov = s2 * np.linalg.pinv(a.T @ a)
    stat = float(beta[2] / math.sqrt(cov[2, 2]))
    m = len(b)
    probs = sorted(DF_TREND)
    crit = [float(np.interp(m, DF_SIZES, DF_TREND[p])) for p in probs]
    p = float(np.interp(stat, crit, probs))
    return stat, p


def stationarity_tests(series: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """ADF and KPSS statistic and p-value for every series."""
    schema = ", ".join(f"{k} string" for k in keys) + ", n int, adf double, adf_p double, kpss double, kpss_p double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values(t)[y].to_numpy(dtype=float)
        a, ap = adf_stat(x)
        kp, kpp = kpss_stat(x)
        res = pd.DataFrame({"n": [len(x)], "adf": [a], "adf_p": [ap], "kpss": [kp], "kpss_p": [kpp]})
        for k in reversed(keys):
            res.insert(0, k, str(g[k].iloc[0]))
        return res

    src = series.select(*[F.col(k).cast("string").alias(k) for k in keys], t, y)
    return src.groupBy(*keys).applyInPandas(run, schema)
