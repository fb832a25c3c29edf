"""Sales forecasting over many (market, segment) series at once: monthly
aggregation, stability ranking, smoothing, trend+seasonality regression,
AR selection, stationarity tests, MAPE.  Stand-in: `sales`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.columns import exact_sum, parse_date
from kestrel.operators.evaluate import mape
from kestrel.operators.ordered import global_rank
from kestrel.operators.relational import transpose_small
from kestrel.operators.seasonal import fitted_rows, seasonal_ar_models
from kestrel.operators.series import (_design, acf, ar_select_forecast, centered_smooth, dense_monthly, fit_sinusoid_trend,
                                      month_index, pacf_from_acf, stationarity_tests)
from kestrel.plans import standins as S
from kestrel.plans.registry import query
from kestrel.plans.sqlfit import residual_ctes, significant, significant_sql

KEYS = ["market", "segment"]
MEASURES = ["sales", "quantity", "profit"]
HORIZON = 6
W = 1
MAX_LAG = 12


def parsed(spark: SparkSession, d: str) -> DataFrame:
    s = S.sales(spark, d)
    return s.withColumn("d", parse_date(F.col("order_date"), "dd-MM-yyyy"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return dense_monthly(parsed(spark, d), KEYS, F.col("d"), MEASURES)


S_SQL = """s AS (SELECT market, segment, CAST(try_strptime(order_date, '%d-%m-%Y') AS DATE) AS d, sales, quantity, profit
      FROM sales),
m AS (SELECT market, segment,
        CAST(date_diff('month', date_trunc('month', (SELECT min(d) FROM s)), date_trunc('month', d)) + 1 AS INTEGER) AS t,
        sales, quantity, profit FROM s),
agg AS (SELECT market, segment, t, CAST(sum(CAST(sales AS DECIMAL(38,10))) AS DOUBLE) AS sales,
          CAST(sum(CAST(quantity AS DECIMAL(38,10))) AS DOUBLE) AS quantity,
          CAST(sum(CAST(profit AS DECIMAL(38,10))) AS DOUBLE) AS profit FROM m GROUP BY ALL),
dense AS (SELECT k.market, k.segment, g.t, coalesce(a.sales, 0.0) AS sales, coalesce(a.quantity, 0.0) AS quantity,
            coalesce(a.profit, 0.0) AS profit
          FROM (SELECT DISTINCT market, segment FROM agg) k
          CROSS JOIN (SELECT CAST(unnest(range(1, (SELECT max(t) FROM m) + 1)) AS INTEGER) AS t) g
          LEFT JOIN agg a ON a.market = k.market AND a.segment = k.segment AND a.t = g.t)"""


@query("monthly_series", ["sales"], S_SQL + "\nSELECT * FROM dense")
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    """Monthly sales, quantity and profit of every market x
    segment in one grouped pass, densified over all months."""
    return monthly(spark, d)


@query("month_index", ["sales"], S_SQL + """
SELECT DISTINCT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
       CAST(date_diff('month', date_trunc('month', (SELECT min(d) FROM s)), date_trunc('month', d)) + 1 AS INTEGER) AS t
FROM s""")
def month_index_q(spark: SparkSession, d: str) -> DataFrame:
    """Month number counted from the first order month."""
    p = parsed(spark, d)
    first = p.agg(F.min("d")).scalar()
    return p.select(F.year("d").alias("year"), F.month("d").alias("month"), month_index(F.col("d"), first).alias("t")).distinct()


def _stats(spark, d):
    """CoV of monthly profit per series (monthly sums first), and series
    totals summed straight from the detail rows (exact decimal sums)."""
    p = parsed(spark, d)
    first = p.agg(F.min("d")).scalar()
    agg = (p.groupBy(*KEYS, month_index(F.col("d"), first).alias("t"))
           .agg(exact_sum("profit").alias("profit")))
    cov = agg.groupBy(*KEYS).agg(F.round(F.stddev_samp("profit") / F.avg("profit"), 6).alias("cov_profit"),
                                 F.count(F.lit(1)).alias("n_months"))
    tot = p.groupBy(*KEYS).agg(exact_sum("profit").alias("total_profit"), exact_sum("sales").alias("total_sales"))
    return cov.join(tot, KEYS).select(*KEYS, "cov_profit", "total_profit", "total_sales", "n_months")


STATS_SQL = S_SQL + """,
st AS (SELECT market, segment, round(stddev_samp(profit) / avg(profit), 6) AS cov_profit,
         (SELECT CAST(sum(CAST(profit AS DECIMAL(38,10))) AS DOUBLE) FROM s
          WHERE s.market = agg.market AND s.segment = agg.segment) AS total_profit,
         (SELECT CAST(sum(CAST(sales AS DECIMAL(38,10))) AS DOUBLE) FROM s
          WHERE s.market = agg.market AND s.segment = agg.segment) AS total_sales, count(*) AS n_months
       FROM agg GROUP BY market, segment)"""


@query("cov_by_segment", ["sales"], STATS_SQL + "\nSELECT market, segment, cov_profit FROM st")
def cov_by_segment(spark: SparkSession, d: str) -> DataFrame:
    """Coefficient of variation of monthly profit per series."""
    return _stats(spark, d).select(*KEYS, "cov_profit")


@query("segment_stability_rank", ["sales"], STATS_SQL + """
SELECT *, CAST(row_number() OVER (ORDER BY cov_profit, market, segment) AS INTEGER) AS stability_rank FROM st""")
def segment_stability_rank(spark: SparkSession, d: str) -> DataFrame:
    """Per-series stability table (CoV, totals) ranked most stable
    first, by a distributed rank (one row per series)."""
    r = global_rank(_stats(spark, d), ["cov_profit", *KEYS], name="stability_rank")
    return r.withColumn("stability_rank", F.col("stability_rank").cast("int"))


# The five markets (levels of the transposed table).
MARKETS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("transpose_small", ["sales"], """
t AS (SELECT market, CAST(sum(CAST(sales AS DECIMAL(38,10))) AS DOUBLE) AS total_sales,
             CAST(sum(CAST(profit AS DECIMAL(38,10))) AS DOUBLE) AS total_profit,
             CAST(count(*) AS DOUBLE) AS n_lines FROM sales GROUP BY 1),
u AS (UNPIVOT t ON total_sales, total_profit, n_lines INTO NAME variable VALUE value)
SELECT variable, """ + ", ".join(f"max(value) FILTER (WHERE market = '{m}') AS \"{m}\"" for m in MARKETS) + """
FROM u GROUP BY variable""")
def transpose_small_q(spark: SparkSession, d: str) -> DataFrame:
    """H5: a per-market summary turned sideways (metrics as rows, one
    column per market of the list)."""
    t = S.sales(spark, d).groupBy("market").agg(
        exact_sum("sales").alias("total_sales"), exact_sum("profit").alias("total_profit"),
        F.count(F.lit(1)).cast("double").alias("n_lines"))
    return transpose_small(t, "market", ["total_sales", "total_profit", "n_lines"], MARKETS)


def _with_last(m: DataFrame) -> DataFrame:
    """Adds n = last month of each (dense) series; every series spans the
    same 1..n calendar, so this is the split point for all of them.  A window
    over one series' months, not a separate job."""
    return m.withColumn("n", F.max("t").over(Window.partitionBy(*KEYS)))


def train_smoothed(m: DataFrame) -> DataFrame:
    """Smoothed training months of the monthly table (with its last month n)."""
    train = m.filter(F.col("t") <= F.col("n") - HORIZON).drop("n")
    return centered_smooth(train, KEYS, "t", "sales", W)


SMOOTH_SQL = S_SQL + f""",
tr AS (SELECT * FROM dense WHERE t <= (SELECT max(t) FROM dense) - {HORIZON}),
sm AS (SELECT *, CASE WHEN count(*) OVER w = {2 * W + 1} THEN avg(sales) OVER w END AS s,
              max(t) OVER (PARTITION BY market, segment) AS n
       FROM tr WINDOW w AS (PARTITION BY market, segment ORDER BY t ROWS BETWEEN {W} PRECEDING AND {W} FOLLOWING)),
e AS (SELECT market, segment, max(CASE WHEN t = {W + 1} THEN s END) AS l1, max(CASE WHEN t = {W + 2} THEN s END) AS l2,
             max(CASE WHEN t = n - {W} THEN s END) AS r1, max(CASE WHEN t = n - {W} - 1 THEN s END) AS r0
      FROM sm GROUP BY ALL),
smooth AS (
  SELECT market, segment, t, CASE WHEN t <= {W} THEN l1 - ({W} + 1 - t) * (l2 - l1)
                                  WHEN t > n - {W} THEN r1 + (t - n + {W}) * (r1 - r0) ELSE s END AS y
  FROM sm JOIN e USING (market, segment))"""


@query("centered_smooth", ["sales"], SMOOTH_SQL + "\nSELECT market, segment, t, round(y, 6) AS smoothed FROM smooth")
def centered_smooth_q(spark: SparkSession, d: str) -> DataFrame:
    """3-month centred moving average of the training months, ends
    extrapolated linearly."""
    s = train_smoothed(_with_last(monthly(spark, d)))
    return s.select(*KEYS, "t", F.round("smoothed", 6).alias("smoothed"))


@query("ts_holdout_split", ["sales"], S_SQL + f"""
SELECT market, segment, CASE WHEN t <= (SELECT max(t) FROM dense) - {HORIZON} THEN 'train' ELSE 'test' END AS split,
       count(*) AS n_months, min(t) AS first_t, max(t) AS last_t FROM dense GROUP BY ALL""")
def ts_holdout_split(spark: SparkSession, d: str) -> DataFrame:
    """all but the last six months train, the last six test."""
    m = _with_last(monthly(spark, d))
    s = m.withColumn("split", F.when(F.col("t") <= F.col("n") - HORIZON, "train").otherwise("test"))
    return s.groupBy(*KEYS, "split").agg(F.count(F.lit(1)).alias("n_months"), F.min("t").alias("first_t"),
                                         F.max("t").alias("last_t"))


ACF_SQL = S_SQL + f""",
c AS (SELECT market, segment, t, sales - avg(sales) OVER (PARTITION BY market, segment) AS dv FROM dense),
den AS (SELECT market, segment, sum(dv * dv) AS den FROM c GROUP BY ALL),
l AS (SELECT CAST(unnest(range(1, {MAX_LAG + 1})) AS INTEGER) AS lag),
acf AS (SELECT a.market, a.segment, l.lag, sum(a.dv * b.dv) / den AS acf
        FROM c a, l, c b, den WHERE b.market = a.market AND b.segment = a.segment AND b.t = a.t + l.lag
          AND den.market = a.market AND den.segment = a.segment
        GROUP BY a.market, a.segment, l.lag, den)"""


@query("acf_by_lag", ["sales"], ACF_SQL + "\nSELECT market, segment, lag, round(acf, 6) AS acf FROM acf")
def acf_by_lag(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation of monthly sales per series, lags 1..12."""
    a = acf(monthly(spark, d), KEYS, "t", "sales", MAX_LAG)
    return a.select(*KEYS, F.col("lag").cast("int").alias("lag"), F.round("acf", 6).alias("acf"))


def _durbin_levinson_sql() -> str:
    """CTEs dl1 .. dlK over w(r1 .. rK): one step of the recursion each (phi_kj as p<k>_<j>)."""
    out = ["dl1 AS MATERIALIZED (SELECT *, r1 AS p1_1 FROM w)"]
    for k in range(2, MAX_LAG + 1):
        num = f"r{k}" + "".join(f" - p{k - 1}_{j} * r{k - j}" for j in range(1, k))
        den = "1" + "".join(f" - p{k - 1}_{j} * r{j}" for j in range(1, k))
        out.append(f"q{k} AS MATERIALIZED (SELECT *, ({num}) / ({den}) AS p{k}_{k} FROM dl{k - 1})")
        rest = ", ".join(f"p{k - 1}_{j} - p{k}_{k} * p{k - 1}_{k - j} AS p{k}_{j}" for j in range(1, k))
        out.append(f"dl{k} AS MATERIALIZED (SELECT *, {rest} FROM q{k})")
    return ",\n".join(out)


@query("pacf_by_lag", ["sales"], ACF_SQL + """,
w AS (SELECT market, segment, """ + ", ".join(f"max(acf) FILTER (WHERE lag = {k}) AS r{k}" for k in range(1, MAX_LAG + 1))
       + " FROM acf GROUP BY ALL),\n" + _durbin_levinson_sql() + "\n"
       + "\nUNION ALL\n".join(f"SELECT market, segment, {k} AS lag, round(p{k}_{k}, 6) AS pacf FROM dl{MAX_LAG}"
                              for k in range(1, MAX_LAG + 1)))
def pacf_by_lag(spark: SparkSession, d: str) -> DataFrame:
    """Partial autocorrelation per series (Durbin-Levinson on the ACF)."""
    p = pacf_from_acf(acf(monthly(spark, d), KEYS, "t", "sales", MAX_LAG), KEYS)
    return p.withColumn("pacf", F.round("pacf", 6))


def _model_input(spark, d):
    """Smoothed training months + raw test months, one series per key."""
    m = _with_last(monthly(spark, d))
    sm = train_smoothed(m).select(*KEYS, "t", F.col("smoothed").alias("y"))
    test = m.filter(F.col("t") > F.col("n") - HORIZON).select(*KEYS, "t", F.col("sales").alias("y"))
    return sm.unionByName(test), m


_TREND_X = ["sin(0.5 * t)", "cos(0.5 * t)", "t", "t * sin(0.5 * t)", "t * cos(0.5 * t)"]
TREND_SQL = SMOOTH_SQL + f""",
input AS (SELECT market, segment, t, y, TRUE AS is_train FROM smooth
          UNION ALL SELECT market, segment, t, sales, FALSE FROM dense WHERE t > (SELECT max(t) FROM dense) - {HORIZON}),
""" + residual_ctes("o", "input", KEYS, "y", _TREND_X, "is_train")


@query("ts_sinusoid_trend", ["sales"], TREND_SQL + f"""
SELECT market, segment, CAST(t AS INTEGER) AS t, {significant_sql('y - __y', 5)} AS fitted FROM o_res""")
def ts_sinusoid_trend(spark: SparkSession, d: str) -> DataFrame:
    """Per series, y ~ 1 + sin(.5t) + cos(.5t) + t + t sin(.5t) + t cos(.5t)
    on the smoothed training months; fitted value for every month."""
    series, _ = _model_input(spark, d)
    return fit_sinusoid_trend(series, KEYS, "t", "y", horizon=HORIZON).withColumn("fitted", significant(F.col("fitted"), 5))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    series, m = _model_input(spark, d)
    fit = fit_sinusoid_trend(series, KEYS, "t", "y", horizon=HORIZON)
    sm = train_smoothed(m)
    return sm.join(fit, [*KEYS, "t"]).select(*KEYS, F.col("t").cast("int").alias("t"),
                                             (F.col("smoothed") - F.col("fitted")).alias("residual"))


@query("ts_residuals", ["sales"], TREND_SQL + """
SELECT market, segment, CAST(t AS INTEGER) AS t, round(__y, 3) AS residual FROM o_res WHERE is_train""")
def ts_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Local series = smoothed - global (trend) prediction, training months."""
    return _residuals(spark, d).withColumn("residual", F.round("residual", 3))


@query("ts_ar_select")
def ts_ar_select(spark: SparkSession, d: str) -> DataFrame:
    """In part: AR order (0-3) chosen by AICc per series on the training months."""
    _, m = _model_input(spark, d)
    f = ar_select_forecast(m.select(*KEYS, "t", "sales"), KEYS, "t", "sales", HORIZON)
    return f.select(*KEYS, "p", "aicc").distinct()


def _forecasts(spark, d):
    series, m = _model_input(spark, d)
    trend = fit_sinusoid_trend(series, KEYS, "t", "y", horizon=HORIZON)
    trend = trend.withColumn("n", F.max("t").over(Window.partitionBy(*KEYS)))
    trend_fc = trend.filter(F.col("t") > F.col("n") - HORIZON).select(*KEYS, "t", F.lit("trend").alias("method"),
                                                                F.col("fitted").alias("forecast"))
    ar = ar_select_forecast(m.select(*KEYS, "t", "sales"), KEYS, "t", "sales", HORIZON)
    ar_fc = ar.select(*KEYS, "t", F.lit("ar").alias("method"), "forecast")
    return trend_fc.unionByName(ar_fc), m


@query("ts_forecast")
def ts_forecast(spark: SparkSession, d: str) -> DataFrame:
    """In part: six-month forecasts of both methods as long rows."""
    f, _ = _forecasts(spark, d)
    return f


@query("ts_stationarity")
def ts_stationarity(spark: SparkSession, d: str) -> DataFrame:
    """ADF and KPSS of each series' residual (smoothed - trend)."""
    r = _residuals(spark, d)
    return stationarity_tests(r, KEYS, "t", "residual")


@query("ts_model_compare")
def ts_model_compare(spark: SparkSession, d: str) -> DataFrame:
    """MAPE of each method on the last six months, per series."""
    f, m = _forecasts(spark, d)
    j = f.join(m.select(*KEYS, F.col("t").cast("int").alias("t"), "sales"), [*KEYS, "t"])
    return j.groupBy(*KEYS, "method").agg(mape(F.col("sales"), F.col("forecast")).alias("mape"))


def measures_long(spark: SparkSession, d: str) -> DataFrame:
    """market, segment, measure, t, y: every measure a series of its own."""
    return monthly(spark, d).unpivot([*KEYS, "t"], MEASURES, "measure", "y")


@query("ts_seasonal_ar")
def ts_seasonal_ar(spark: SparkSession, d: str) -> DataFrame:
    """The seasonal autoregression (seasonal difference, AR(p <= 3) x SAR(1), mean or drift) of least AICc of every
    market, segment and measure, on the training months."""
    return seasonal_ar_models(measures_long(spark, d), [*KEYS, "measure"], "t", "y", HORIZON)


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    return fitted_rows(measures_long(spark, d), [*KEYS, "measure"], "t", "y", HORIZON, _design)


@query("ts_fitted_forecast")
def ts_fitted_forecast(spark: SparkSession, d: str) -> DataFrame:
    """Fitted values of the training months and six forecasts with 95 % intervals, as rows, for the trend
    regression and the seasonal autoregression of every market, segment and measure."""
    return _fitted(spark, d)


@query("ts_measure_compare")
def ts_measure_compare(spark: SparkSession, d: str) -> DataFrame:
    """MAPE of both methods on the last six months for sales, quantity and profit, and how many of the six
    lie in their interval."""
    f = _fitted(spark, d).filter(F.col("kind") == "forecast").join(measures_long(spark, d), [*KEYS, "measure", "t"])
    return f.groupBy(*KEYS, "measure", "method").agg(
        mape(F.col("y"), F.col("value")).alias("mape"), F.count_if(F.col("y").between(F.col("lo"), F.col("hi"))).alias("covered"))


@query("residual_acf", ["sales"], TREND_SQL + f""",
x AS (SELECT market, segment, CAST(t AS INTEGER) AS t, __y - avg(__y) OVER (PARTITION BY market, segment) AS dv FROM o_res WHERE is_train),
den AS (SELECT market, segment, sum(dv * dv) AS den FROM x GROUP BY ALL),
l AS (SELECT CAST(unnest(range(1, {MAX_LAG + 1})) AS INTEGER) AS lag),
acf AS (SELECT a.market, a.segment, l.lag, sum(a.dv * b.dv) / den AS acf FROM x a, l, x b, den
        WHERE b.market = a.market AND b.segment = a.segment AND b.t = a.t + l.lag AND den.market = a.market AND den.segment = a.segment
        GROUP BY a.market, a.segment, l.lag, den),
w AS (SELECT market, segment, """ + ", ".join(f"max(acf) FILTER (WHERE lag = {k}) AS r{k}" for k in range(1, MAX_LAG + 1))
       + " FROM acf GROUP BY ALL),\n" + _durbin_levinson_sql() + ",\npa AS (" + "\nUNION ALL\n".join(
           f"SELECT market, segment, {k} AS lag, p{k}_{k} AS pacf FROM dl{MAX_LAG}" for k in range(1, MAX_LAG + 1)) + """)
SELECT market, segment, lag, round(acf, 5) AS acf, round(pacf, 5) AS pacf FROM acf JOIN pa USING (market, segment, lag)""")
def residual_acf(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelation and partial autocorrelation of every series' residual (smoothed - trend), lags 1 to 12."""
    a = acf(_residuals(spark, d), KEYS, "t", "residual", MAX_LAG).select(*KEYS, F.col("lag").cast("int").alias("lag"), "acf")
    return a.join(pacf_from_acf(a, KEYS), [*KEYS, "lag"]).select(*KEYS, "lag", F.round("acf", 5).alias("acf"), F.round("pacf", 5).alias("pacf"))


@query("mape", ["sales"], S_SQL + f""",
lt AS (SELECT market, segment, sales AS last_train FROM dense WHERE t = (SELECT max(t) FROM dense) - {HORIZON})
SELECT market, segment, round(avg(abs((sales - last_train) / NULLIF(sales, 0))) * 100, 6) AS mape
FROM dense JOIN lt USING (market, segment) WHERE t > (SELECT max(t) FROM dense) - {HORIZON} GROUP BY ALL""")
def mape_q(spark: SparkSession, d: str) -> DataFrame:
    """MAPE of the naive (last training month) forecast on the test months."""
    m = _with_last(monthly(spark, d))
    last = m.filter(F.col("t") == F.col("n") - HORIZON).select(*KEYS, F.col("sales").alias("last_train"))
    test = m.filter(F.col("t") > F.col("n") - HORIZON).join(last, KEYS)
    return test.groupBy(*KEYS).agg(F.round(mape(F.col("sales"), F.col("last_train")), 6).alias("mape"))
