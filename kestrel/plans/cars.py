"""Car-price regression: name repair, derived features, OLS with summary,
stepwise AIC, backward elimination, scoring and hold-out R^2, k-fold CV.
Stand-in: `cars` (lineitem x part).  Also the logistic model on `churn`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.columns import recode_values, safe_log
from kestrel.operators.models import (backward_eliminate, cv_linear, fitted_coefficients, linear_score,
                                      logistic_score, logit_stepwise_aic, logit_fit, ols_fit, stepwise_aic)
from kestrel.operators.stats import dummy_encode, split_random
from kestrel.plans import standins as S
from kestrel.plans.registry import query
from kestrel.plans.sqlfit import coefficient_ctes, residual_ctes, significant, significant_sql, t_two_sided_sql

X_NUM = ["quantity", "retailprice", "size", "discount", "tax"]
# Levels of the body dummies; the first is the baseline.
BODIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
X_ALL = X_NUM + [f"carbody_{b}" for b in BODIES[1:]]
TRAIN_RATIO, FOLDS, CV_SEED = 0.7, 5, 29


def design(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """model.matrix(price ~ .): numeric columns plus drop-first dummies of
    the listed body levels; returns the frame and its predictors."""
    return dummy_encode(S.cars(spark, d), "carbody", BODIES), list(X_ALL)


DESIGN_SQL = "design AS (SELECT car_id, price, " + ", ".join(X_NUM) + ", " + ", ".join(
    f"CAST(carbody = '{b}' AS INTEGER) AS carbody_{b}" for b in BODIES[1:]) + " FROM cars)"


def _md5_number(seed: int, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def model_frame(spark: SparkSession, d: str) -> DataFrame:
    return design(spark, d)[0]


@query("recode_values", ["cars"], """
SELECT make, count(*) AS n_cars FROM (
  SELECT CASE string_split(carname, ' ')[1] """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.CAR_FIXES)
       + """ ELSE string_split(carname, ' ')[1] END AS make FROM cars) GROUP BY 1""")
def recode_values_q(spark: SparkSession, d: str) -> DataFrame:
    """company = first word of the car name, misspellings mapped to
    the right make (lookup map evaluated in the projection)."""
    c = S.cars(spark, d).withColumn("make", F.split("carname", " ").getItem(0))
    c = c.withColumn("make", recode_values(F.col("make"), dict(S.CAR_FIXES)))
    return c.groupBy("make").agg(F.count(F.lit(1)).alias("n_cars"))


@query("derive_global_mean", ["cars"], """
SELECT quantity, size, round((SELECT avg(quantity + size) FROM cars), 2) AS total_mean FROM cars""")
def derive_global_mean(spark: SparkSession, d: str) -> DataFrame:
    """A whole-table scalar (mean of a derived sum) on every row, as a
    scalar subquery rather than a window over all rows."""
    c = S.cars(spark, d)
    m = c.agg(F.round(F.avg(F.col("quantity") + F.col("size")), 2)).scalar()
    return c.select("quantity", "size", m.alias("total_mean"))


@query("math_features", ["cars"], """
SELECT quantity, round(ln(price), 6) AS log_price, round(sin(size), 6) AS sin_size, round(cos(size), 6) AS cos_size,
       round(abs(discount - 0.05), 6) AS abs_dev, price / quantity AS unit_price FROM cars""")
def math_features(spark: SparkSession, d: str) -> DataFrame:
    """Round, log, sin, cos, abs."""
    c = S.cars(spark, d)
    return c.select("quantity", F.round(safe_log(F.col("price")), 6).alias("log_price"),
                    F.round(F.sin("size"), 6).alias("sin_size"), F.round(F.cos("size"), 6).alias("cos_size"),
                    F.round(F.abs(F.col("discount") - 0.05), 6).alias("abs_dev"),
                    (F.col("price") / F.col("quantity")).alias("unit_price"))


@query("regr_simple", ["cars"], """
SELECT carbody, round(regr_slope(price, quantity), 6) AS slope, round(regr_intercept(price, quantity), 4) AS intercept,
       round(regr_r2(price, quantity), 6) AS r2, CAST(regr_count(price, quantity) AS BIGINT) AS n FROM cars GROUP BY 1""")
def regr_simple(spark: SparkSession, d: str) -> DataFrame:
    """K2: simple regression per car body in one grouped pass."""
    c = S.cars(spark, d)
    return c.groupBy("carbody").agg(
        F.round(F.regr_slope("price", "quantity"), 6).alias("slope"),
        F.round(F.regr_intercept("price", "quantity"), 4).alias("intercept"),
        F.round(F.regr_r2("price", "quantity"), 6).alias("r2"),
        F.regr_count("price", "quantity").alias("n"))


@query("ols_fit", ["cars"], DESIGN_SQL + ",\n" + residual_ctes("o", "design", [], "price", X_ALL) + ",\n"
       + coefficient_ctes("o", [], X_ALL) + """,
l AS (""" + "\nUNION ALL\n".join(f"SELECT '{t}' AS term, b{i} AS b, v{i} AS v, n, rss FROM o_coef"
                              for i, t in enumerate(["(Intercept)", *X_ALL])) + f"""),
tss AS (SELECT var_pop(price) * count(*) AS tss FROM design),
t AS (SELECT *, sqrt(v * rss / (n - {len(X_ALL) + 1})) AS se, b / sqrt(v * rss / (n - {len(X_ALL) + 1})) AS t, n - {len(X_ALL) + 1} AS dof
      FROM l, tss)
SELECT term, {significant_sql('b', 5)} AS estimate, {significant_sql('se', 5)} AS std_error, {significant_sql('t', 5)} AS t_value,
       round({t_two_sided_sql('t', 'dof')}, 5) AS p_value, {significant_sql('1 - rss / tss', 5)} AS r2, n FROM t""")
def ols_fit_q(spark: SparkSession, d: str) -> DataFrame:
    """K1: price ~ numeric predictors + body dummies, with the lm summary."""
    m, xs = design(spark, d)
    t = ols_fit(m, "price", xs)
    return t.select("term", *[significant(F.col(c), 5).alias(c) for c in ("estimate", "std_error", "t_value")],
                    F.round("p_value", 5).alias("p_value"), significant(F.col("r2"), 5).alias("r2"), F.col("n").cast("long"))


@query("stepwise_aic")
def stepwise_aic_q(spark: SparkSession, d: str) -> DataFrame:
    """K5: stepAIC(both) from the full model, on one pass of cross products."""
    m, xs = design(spark, d)
    return stepwise_aic(m, "price", xs)


@query("backward_eliminate")
def backward_eliminate_q(spark: SparkSession, d: str) -> DataFrame:
    """K3: drop insignificant terms by VIF then p-value until all p <= 0.05."""
    m, xs = design(spark, d)
    return backward_eliminate(m, "price", xs)


def _train_test(spark, d):
    m, xs = design(spark, d)
    m = split_random(m, ["car_id"], TRAIN_RATIO)
    return m.filter("is_train"), m.filter(~F.col("is_train")), xs


_SPLIT_SQL = DESIGN_SQL + f""",
split AS (SELECT *, {_md5_number(9999, 'car_id')} % 10000 < {int(TRAIN_RATIO * 10000)} AS is_train FROM design),
""" + residual_ctes("o", "split", [], "price", X_ALL, "is_train")


@query("score_linear", ["cars"], _SPLIT_SQL + f"""
SELECT car_id, price, {significant_sql('price - __y', 5)} AS predicted_price FROM o_res WHERE NOT is_train""")
def score_linear(spark: SparkSession, d: str) -> DataFrame:
    """K6: fit on the 70% split, predict the hold-out rows."""
    s = _scored(spark, d)
    return s.withColumn("predicted_price", significant(F.col("predicted_price"), 5))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    train, test, xs = _train_test(spark, d)
    coefs, inter = fitted_coefficients(ols_fit(train, "price", xs))
    return test.select("car_id", "price", linear_score(coefs, inter).alias("predicted_price"))


@query("holdout_r2", ["cars"], _SPLIT_SQL + f"""
SELECT {significant_sql('pow(corr(price, price - __y), 2)')} AS r2, count(*) AS n_test FROM o_res WHERE NOT is_train""")
def holdout_r2(spark: SparkSession, d: str) -> DataFrame:
    """K7: squared correlation of actual and predicted price on the hold-out."""
    s = _scored(spark, d)
    return s.agg(significant(F.pow(F.corr("price", "predicted_price"), 2)).alias("r2"), F.count(F.lit(1)).alias("n_test"))


@query("cv_linear", ["cars"], DESIGN_SQL + f""",
folded AS (SELECT *, CAST({_md5_number(CV_SEED, 'car_id')} % {FOLDS} AS INTEGER) AS own FROM design),
every AS (SELECT f.*, g.fold FROM folded f, (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold) g),
""" + residual_ctes("o", "every", ["fold"], "price", X_ALL, "own <> fold") + f""",
e AS (SELECT fold, __y FROM o_res WHERE own = fold)
SELECT fold, count(*) AS n, {significant_sql('avg(__y * __y)')} AS ms FROM e GROUP BY fold
UNION ALL SELECT -1, count(*), {significant_sql('avg(__y * __y)')} FROM e""")
def cv_linear_q(spark: SparkSession, d: str) -> DataFrame:
    """K8: 5-fold CV mean squared prediction error."""
    m, xs = design(spark, d)
    return cv_linear(m, "price", xs, FOLDS, CV_SEED, key="car_id").withColumn("ms", significant(F.col("ms")))


# ------------------------------------------------------------- logistic
LOGIT_NUM = ["n_chars", "n_words", "quality"]


def churn_frame(spark, d) -> tuple[DataFrame, list[str]]:
    """Label 0/1 plus drop-first language dummies (levels from the data)."""
    from kestrel.functions.columns import flag_binary
    c = S.churn(spark, d).withColumn("y", flag_binary(F.col("churn"), "Yes").cast("double"))
    m = dummy_encode(c, "lang")
    return m, LOGIT_NUM + [x for x in m.columns if x.startswith("lang_")]


@query("logit_fit")
def logit_fit_q(spark: SparkSession, d: str) -> DataFrame:
    """K4: glm(churn ~ ., binomial) summary with AIC and deviances."""
    c, xs = churn_frame(spark, d)
    return logit_fit(c, "y", xs)


@query("logit_stepwise")
def logit_stepwise(spark: SparkSession, d: str) -> DataFrame:
    """K5 (logistic): AIC search in both directions."""
    c, xs = churn_frame(spark, d)
    return logit_stepwise_aic(c, "y", xs)


@query("score_logistic")
def score_logistic(spark: SparkSession, d: str) -> DataFrame:
    """K6 (response scale): fitted churn probability for every customer."""
    c, xs = churn_frame(spark, d)
    coefs, inter = fitted_coefficients(logit_fit(c, "y", xs))
    return c.select("customer_id", "y", logistic_score(coefs, inter).alias("p_churn"))
