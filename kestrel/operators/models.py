"""Regression and classification.

Fits are Spark ML estimators (distributed aggregation of the normal
equations / IRLS / gradient steps).  Model selection that only needs
sums of squares (stepwise AIC, k-fold CV of a linear model) uses ONE
distributed pass for the cross-product matrix X'X, X'y, y'y and then works on
the small k x k matrices on the driver — no refit per candidate model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.stats import correlation_from_moments, moments
from kestrel.session import ensure_checkpoint_dir


def _assemble(df: DataFrame, xs: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol=out, handleInvalid="skip").transform(df)


# ------------------------------------------------------------------ OLS
def ols_fit(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """K1: lm(y ~ xs) with the summary table: term, estimate, std_error,
    t_value, p_value, plus r2 / adj_r2 / n on every row."""
    data = _assemble(df.select(y, *xs).dropna(), xs)
    m = LinearRegression(featuresCol="features", labelCol=y, solver="normal", regParam=0.0,
                         standardization=False, fitIntercept=True).fit(data)
    s = m.summary
    terms = list(xs) + ["(Intercept)"]
    est = list(m.coefficients.toArray()) + [m.intercept]
    rows = [(t, float(e), float(se), float(tv), float(pv))
            for t, e, se, tv, pv in zip(terms, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")
    return (out.withColumn("r2", F.lit(float(s.r2))).withColumn("adj_r2", F.lit(float(s.r2adj)))
            .withColumn("n", F.lit(int(s.numInstances))))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        for num in (m * (b - m) * x / ((a - 1.0 + m2) * (a + m2)),
                    -(a + m) * (a + b + m) * x / ((a + m2) * (a + 1.0 + m2))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def betainc_regularized(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, dof: float) -> float:
    """P(|T| > |t|) for Student's t with `dof` degrees of freedom."""
    if not math.isfinite(t):
        return 0.0 if abs(t) == math.inf else float("nan")
    return betainc_regularized(dof / 2.0, 0.5, dof / (dof + t * t))


def ols_numpy(x: np.ndarray, y: np.ndarray, names: list[str]):
    """lm summary for one small design (used per group inside applyInPandas
    on aggregated tables): term, estimate, std_error, t_value, p_value, r2,
    adj_r2, n."""
    import pandas as pd
    n = len(y)
    xm = np.column_stack([np.ones(n), x])
    scale = np.sqrt((xm * xm).sum(axis=0))               # columns of any unit weigh alike
    scale = np.where(scale > 0, scale, 1.0)
    inv = np.linalg.pinv(xm / scale)
    beta = inv @ y / scale
    xtx_inv = inv @ inv.T / np.outer(scale, scale)
    resid = y - xm @ beta
    p = xm.shape[1]
    dof = max(n - p, 1)
    rss = float(resid @ resid)
    tss = float(((y - y.mean()) ** 2).sum())
    se = np.sqrt(np.maximum(np.diag(xtx_inv) * rss / dof, 0.0))
    tv = np.divide(beta, se, out=np.full_like(beta, np.nan), where=se > 0)
    pv = [t_two_sided_p(float(t), dof) if math.isfinite(t) else float("nan") for t in tv]
    r2 = 1 - rss / tss if tss > 0 else float("nan")
    adj = 1 - (1 - r2) * (n - 1) / dof
    terms = ["(Intercept)", *names]
    return pd.DataFrame({"term": terms, "estimate": beta, "std_error": se, "t_value": tv, "p_value": pv,
                         "r2": r2, "adj_r2": adj, "n": n})


def normal_equations(df: DataFrame, y: str, xs: list[str]):
    """n, X'X, X'y, y'y over complete rows with all columns centred (intercept
    first, which centring makes independent of the rest): residual sums of
    squares and slopes are those of the uncentred system."""
    n, _, c = moments(df, [*xs, y])
    k = len(xs)
    xtx = np.zeros((k + 1, k + 1))
    xtx[0, 0] = n
    xtx[1:, 1:] = c[:k, :k]
    return n, xtx, np.concatenate([[0.0], c[:k, k]]), c[k, k]


def _rss(xtx, xty, yty, idx):
    b = xty[idx]
    beta = scaled_inverse(xtx[np.ix_(idx, idx)]) @ b
    return float(yty - beta @ b), beta


def scaled_inverse(a: np.ndarray) -> np.ndarray:
    """(Pseudo-)inverse of a cross-product matrix whose columns may differ in unit by many powers of ten."""
    d = np.sqrt(np.diag(a))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.pinv(a / np.outer(d, d), rcond=1e-12) / np.outer(d, d)


def lm_aic(n: int, rss: float, p: int) -> float:
    """extractAIC for lm: n log(RSS / n) + 2 p."""
    return n * math.log(rss / n) + 2 * p


def stepwise_aic(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """K5: stepAIC(direction = "both") from the full model, AIC = n log(RSS/n)
    + 2p, every candidate evaluated from the one-pass cross products.
    Output: step, action, term, aic (step 0 is the full model)."""
    n, xtx, xty, yty = normal_equations(df, y, xs)
    current = list(range(1, len(xs) + 1))
    rss, _ = _rss(xtx, xty, yty, [0] + current)
    aic = lm_aic(n, rss, len(current) + 1)
    hist = [(0, "start", None, aic)]
    step = 0
    while True:
        best = None
        for j in current:  # drop
            c = [t for t in current if t != j]
            a = lm_aic(n, _rss(xtx, xty, yty, [0] + c)[0], len(c) + 1)
            if best is None or a < best[0] - 1e-12:
                best = (a, "drop", j, c)
        for j in range(1, len(xs) + 1):  # add back
            if j in current:
                continue
            c = sorted(current + [j])
            a = lm_aic(n, _rss(xtx, xty, yty, [0] + c)[0], len(c) + 1)
            if best is None or a < best[0] - 1e-12:
                best = (a, "add", j, c)
        if best is None or best[0] >= aic - 1e-12:
            break
        step += 1
        aic, current = best[0], best[3]
        hist.append((step, best[1], xs[best[2] - 1], aic))
    return df.sparkSession.createDataFrame(hist, "step int, action string, term string, aic double")


def stepwise_terms(df: DataFrame, y: str, xs: list[str]) -> list[str]:
    """The terms left after `stepwise_aic` (driver-side list of names)."""
    kept = list(xs)
    for r in stepwise_aic(df, y, xs).collect():
        if r["action"] == "drop":
            kept.remove(r["term"])
        elif r["action"] == "add":
            kept.append(r["term"])
    return [x for x in xs if x in kept]


def _term_tests(n: int, mean: np.ndarray, c: np.ndarray, idx: list[int]) -> tuple[list[float], list[float], float]:
    """p-value and VIF of each predictor of the model on `idx`, and the intercept's p-value,
    all from the means and centred cross-products (the response last)."""
    a, b = c[np.ix_(idx, idx)], c[idx, -1]
    inv = scaled_inverse(a)
    beta = inv @ b
    dof = max(n - len(idx) - 1, 1)
    s2 = max(float(c[-1, -1] - beta @ b), 0.0) / dof
    m = mean[idx]
    est = np.append(beta, mean[-1] - m @ beta)
    var = np.append(np.diag(inv), 1 / n + m @ inv @ m) * s2
    p = [t_two_sided_p(float(e / math.sqrt(v)), dof) if v > 0 else float("nan") for e, v in zip(est, var)]
    vif = np.diag(np.linalg.pinv(correlation_from_moments(a)))
    return p[:-1], [float(v) for v in vif], p[-1]


def backward_eliminate(df: DataFrame, y: str, xs: list[str], alpha: float = 0.05, vif_cut: float = 2.0,
                       adj_r2_tol: float | None = 0.01) -> DataFrame:
    """K3: drop one term at a time: among the insignificant terms (p > alpha)
    the one with the highest VIF if that VIF exceeds `vif_cut`, otherwise the
    one with the highest p-value; stop when all terms are significant.  Then
    drop the term whose removal costs the least adjusted R^2 while that cost
    is below `adj_r2_tol`.  Every model on the way follows from one matrix of
    centred cross-products; the data are not read again.
    Output: the elimination log (step, dropped, p, vif) and the final model
    rows (step = -1)."""
    n, mean, c = moments(df, [*xs, y])
    left, gone = eliminate_terms(n, mean, c, list(range(len(xs))), alpha, vif_cut, adj_r2_tol)
    log = [(k, xs[j], p, v) for k, (j, p, v) in enumerate(gone, start=1)]
    if left:
        p, _, p0 = _term_tests(n, mean, c, left)
        log += [(-1, t, float(q), None) for t, q in zip(["(Intercept)", *[xs[j] for j in left]], [p0, *p])]
    return df.sparkSession.createDataFrame(log, "step int, term string, p_value double, vif double")


def eliminate_terms(n: int, mean: np.ndarray, c: np.ndarray, left: list[int], alpha: float = 0.05, vif_cut: float = 2.0,
                    adj_r2_tol: float | None = 0.01) -> tuple[list[int], list[tuple[int, float | None, float | None]]]:
    """The elimination of `backward_eliminate` on means and centred cross-products (the response last):
    the columns left of `left`, and the removals (column, p, VIF; both None in the last phase)."""
    left, log = list(left), []
    while left:
        p, v, _ = _term_tests(n, mean, c, left)
        bad = [k for k in range(len(left)) if p[k] > alpha]
        if not bad:
            break
        k = max(bad, key=lambda j: v[j])
        if v[k] <= vif_cut:
            k = max(bad, key=lambda j: p[j])
        log.append((left[k], float(p[k]), float(v[k])))
        del left[k]

    def adj_r2(idx):
        b = c[idx, -1]
        rss = c[-1, -1] - b @ scaled_inverse(c[np.ix_(idx, idx)]) @ b
        return 1 - rss / c[-1, -1] * (n - 1) / (n - len(idx) - 1)

    while adj_r2_tol is not None and len(left) > 1:
        cost, j = min((adj_r2(left) - adj_r2([i for i in left if i != j]), j) for j in left)
        if cost >= adj_r2_tol:
            break
        log.append((j, None, None))
        left.remove(j)
    return left, log


def term_estimates(n: int, mean: np.ndarray, c: np.ndarray, idx: list[int]):
    """The fit on columns `idx` from means and centred cross-products (the response last): estimates, standard
    errors and p-values (the intercept first), VIFs, R^2 and adjusted R^2."""
    a, b = c[np.ix_(idx, idx)], c[idx, -1]
    inv = scaled_inverse(a) if idx else np.zeros((0, 0))
    beta = inv @ b
    dof = max(n - len(idx) - 1, 1)
    rss = max(float(c[-1, -1] - beta @ b), 0.0)
    m = mean[idx]
    est = np.append(mean[-1] - m @ beta, beta)
    se = np.sqrt(np.maximum(np.append(1 / n + m @ inv @ m, np.diag(inv)) * rss / dof, 0.0))
    p = [t_two_sided_p(float(e / s), dof) if s > 0 else float("nan") for e, s in zip(est, se)]
    vif = np.diag(np.linalg.pinv(correlation_from_moments(a))) if idx else np.zeros(0)
    r2 = 1 - rss / c[-1, -1] if c[-1, -1] > 0 else float("nan")
    return est, se, p, vif, r2, 1 - (1 - r2) * (n - 1) / dof


def linear_score(coefs: dict[str, float], intercept: float) -> Column:
    """K6: prediction as a JVM expression (no model object on executors)."""
    e = F.lit(float(intercept))
    for c, b in coefs.items():
        e = e + F.lit(float(b)) * F.col(c)
    return e


def fitted_coefficients(table: DataFrame) -> tuple[dict[str, float], float]:
    rows = table.select("term", "estimate").collect()
    coefs = {r["term"]: r["estimate"] for r in rows if r["term"] != "(Intercept)"}
    inter = [r["estimate"] for r in rows if r["term"] == "(Intercept)"][0]
    return coefs, inter


def cv_linear(df: DataFrame, y: str, xs: list[str], folds: int = 5, seed: int = 29, key: str | None = None) -> DataFrame:
    """K8: m-fold CV of lm: rows dealt into folds by the md5 of seed|key; one pass gives per-fold
    cross products, each fold's training system is total minus that fold;
    a second pass scores every row with its fold's coefficients.
    Output: fold, n, ms (mean squared prediction error), plus overall row."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ([key] if key else [y, *xs]))))
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    d = df.select(*([key] if key else []), y, *xs).dropna().withColumn("fold", F.pmod(h, F.lit(folds)).cast("int"))
    cols = ["__one", *xs, y]
    k = len(xs) + 1
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    per = d.withColumn("__one", F.lit(1.0)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *aggs).collect()
    mats = {}
    for r in per:
        m = np.zeros((len(cols), len(cols)))
        for i in range(len(cols)):
            for j in range(i, len(cols)):
                m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        mats[r["fold"]] = m
    total = sum(mats.values())
    betas = {}
    for f, m in mats.items():
        tr = total - m
        betas[f] = np.linalg.lstsq(tr[:k, :k], tr[:k, k], rcond=None)[0]
    fs = sorted(betas)
    coef_arr = [F.array(*[F.lit(float(betas[f][j])) for f in fs]) for j in range(k)]
    idx = F.array_position(F.array(*[F.lit(f) for f in fs]), F.col("fold")).cast("int")
    pred = F.element_at(coef_arr[0], idx)
    for j, x in enumerate(xs, start=1):
        pred = pred + F.element_at(coef_arr[j], idx) * F.col(x)
    err = d.withColumn("se", F.pow(F.col(y) - pred, 2))
    by_fold = err.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("se").alias("ms"))
    overall = err.agg(F.lit(-1).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg("se").alias("ms"))
    return by_fold.unionByName(overall)


# ------------------------------------------------------------- logistic
def logit_fit(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """K4: glm(binomial) summary: term, estimate, std_error, z_value, p_value,
    with aic, null and residual deviance on every row."""
    data = _assemble(df.select(y, *xs).dropna(), xs).select(y, "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _logit_table(data, y, xs)
    finally:
        data.unpersist()


def _logit_table(data: DataFrame, y: str, xs: list[str]) -> DataFrame:
    m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=y,
                                    maxIter=50, regParam=0.0).fit(data)
    s = m.summary
    terms = list(xs) + ["(Intercept)"]
    est = list(m.coefficients.toArray()) + [m.intercept]
    rows = [(t, float(e), float(se), float(tv), float(pv))
            for t, e, se, tv, pv in zip(terms, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    out = data.sparkSession.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")
    return (out.withColumn("aic", F.lit(float(s.aic))).withColumn("null_deviance", F.lit(float(s.nullDeviance)))
            .withColumn("residual_deviance", F.lit(float(s.deviance))))


def irls_many(rows: DataFrame, masks: list[list[int]], k: int, max_iter: int = 50, tol: float = 1e-8) -> tuple[list[float], int]:
    """Deviances of the logistic fits on the columns of each mask, and the passes made.

    rows: y, x (array of k standardised columns).  Every pass adds up the gradients
    and Hessians of all fits that have not converged, per task; the sums meet per fit and are
    solved there, so the passes are those of the slowest fit, however many there are.
    A fit has converged if its deviance changes by less than `tol` relatively (as glm does).
    """
    beta = [np.zeros(len(m) + 1) for m in masks]
    dev, old = [math.inf] * len(masks), [b.copy() for b in beta]
    todo, passes = list(range(len(masks))), 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {i: np.zeros(1 + len(beta[i]) * (len(beta[i]) + 1)) for i in todo}
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), k)
            for i in todo:
                d = np.column_stack([np.ones(len(y)), x[:, masks[i]]])
                eta = d @ beta[i]
                mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                w = np.maximum(mu * (1 - mu), 1e-300)
                parts[i][0] += 2 * (np.logaddexp(0, eta) - y * eta).sum()
                parts[i][1:1 + len(beta[i])] += d.T @ (y - mu)
                parts[i][1 + len(beta[i]):] += ((d * w[:, None]).T @ d).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([v.tobytes() for v in parts.values()], pa.binary())],
                                         names=["i", "s"])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        i = int(g["i"].iloc[0])
        s, p = np.sum([np.frombuffer(v) for v in g["s"]], axis=0), len(masks[i]) + 1
        step = np.linalg.lstsq(s[1 + p:].reshape(p, p), s[1:1 + p], rcond=None)[0]
        return pd.DataFrame({"i": [i], "dev": [s[0]], "step": [step]})

    while todo and passes < max_iter:
        passes += 1
        found = rows.mapInArrow(sums, "i int, s binary").groupBy("i").applyInPandas(solve, "i int, dev double, step array<double>").collect()
        still = []
        for r in found:
            i = r["i"]
            if r["dev"] > dev[i] + tol * (abs(dev[i]) + 0.1):
                beta[i] = (beta[i] + old[i]) / 2              # a step too far is halved
                still.append(i)
                continue
            close = abs(dev[i] - r["dev"]) <= tol * (abs(r["dev"]) + 0.1)
            dev[i], old[i] = r["dev"], beta[i]
            if not close:
                beta[i] = beta[i] + np.array(r["step"])
                still.append(i)
        todo = sorted(still)
    return dev, passes


def logit_stepwise_aic(df: DataFrame, y: str, xs: list[str], passes: list[int] | None = None) -> DataFrame:
    """K5 (logistic): stepAIC(direction = "both") from the full model: each
    step drops or adds back the one term that lowers AIC most.  All candidates
    of a step are fitted in the same passes over the standardised design, which
    is written once to the checkpoint folder.  `passes`, if given, gets the number
    of passes of every step.  Output: step, action, term, aic (step 0: the full model)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n, mean, c = moments(df, [*xs, y])
    sd = np.sqrt(np.diag(c) / max(n - 1, 1))
    z = [(F.col(x).cast("double") - F.lit(float(m))) / F.lit(float(s) if s > 0 else 1.0) for x, m, s in zip(xs, mean, sd)]
    rows = df.select(y, *xs).dropna().select(F.col(y).cast("double").alias("y"), F.array(*z).alias("x")).checkpoint(eager=True)

    def aics(models):
        dev, n_passes = irls_many(rows, [[xs.index(t) for t in m] for m in models], len(xs))
        if passes is not None:
            passes.append(n_passes)
        return [d + 2 * (len(m) + 1) for d, m in zip(dev, models)]
    terms = list(xs)
    aic = aics([terms])[0]
    log = [(0, "start", None, aic)]
    seen: dict[frozenset, float] = {frozenset(terms): aic}
    while True:
        moves = [("drop", t, [x for x in terms if x != t]) for t in terms if len(terms) > 1] + \
            [("add", t, [x for x in xs if x in terms or x == t]) for t in xs if t not in terms]
        new = [m for m in moves if frozenset(m[2]) not in seen]
        if new:
            seen.update(zip([frozenset(m[2]) for m in new], aics([m[2] for m in new])))
        best = min(moves, key=lambda m: seen[frozenset(m[2])], default=None)
        if best is None or seen[frozenset(best[2])] >= aic - 1e-9:
            break
        aic, terms = seen[frozenset(best[2])], best[2]
        log.append((len(log), best[0], best[1], aic))
    return spark.createDataFrame(log, "step int, action string, term string, aic double")


def logistic_score(coefs: dict[str, float], intercept: float) -> Column:
    """K6 (response scale): 1 / (1 + exp(-eta))."""
    return 1.0 / (1.0 + F.exp(-linear_score(coefs, intercept)))


# ----------------------------------------------------------------- SVMs
def _fit_rows(train: DataFrame, label: str, features: str) -> DataFrame:
    """Label and features in at most two partitions per core: every pass of every fit sends the driver one result per
    task, so their number must not follow that of the shuffle partitions or grow with the rows."""
    most = max(16, 2 * train.sparkSession.sparkContext.defaultParallelism)
    return train.select(label, features).coalesce(most)


def svm_one_vs_rest(train: DataFrame, test: DataFrame, label: str, features: str, reg: float = 0.0,
                    max_iter: int = 20):
    """Multiclass linear SVM (one-vs-rest LinearSVC); returns the test
    predictions and the fitted model."""
    ovr = OneVsRest(classifier=LinearSVC(regParam=reg, maxIter=max_iter), featuresCol=features,
                    labelCol=label, predictionCol="prediction", parallelism=4)
    train = _fit_rows(train, label, features).persist(StorageLevel.MEMORY_AND_DISK)  # every iteration reads it
    try:
        m = ovr.fit(train)
    finally:
        train.unpersist()
    return m.transform(test), m


def random_fourier_features(df: DataFrame, col: str, dim_in: int, n_features: int = 256, gamma: float = 0.01,
                            seed: int = 7, out: str = "rff") -> DataFrame:
    """K12 (re-aimed): random Fourier features for the RBF kernel
    exp(-gamma |x - y|^2): z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma),
    b ~ U(0, 2 pi).  A batch matrix product per Arrow batch (pandas UDF);
    the fixed W, b (D x d numbers) ship with the function."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_features, dim_in))
    b = rng.uniform(0, 2 * math.pi, size=n_features)
    scale = math.sqrt(2.0 / n_features)

    @F.pandas_udf("array<double>")
    def rff(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        z = scale * np.cos(x @ w.T + b)
        return pd.Series(list(z))

    return df.withColumn(out, array_to_vector(rff(F.col(col))))


def grid_search_cv(train: DataFrame, label: str, features: str, regs=(0.0, 0.01, 0.1), folds: int = 3,
                   seed: int = 7, max_iter: int = 20):
    """K-fold CV over a parameter grid on accuracy (models fitted in
    parallel).  Returns (grid rows [(reg, mean accuracy)], best model)."""
    est = OneVsRest(classifier=LinearSVC(maxIter=max_iter), featuresCol=features, labelCol=label, parallelism=4)
    maps = [{est.classifier: LinearSVC(maxIter=max_iter, regParam=r)} for r in regs]
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, numFolds=folds, seed=seed,
                        parallelism=3)
    train = _fit_rows(train, label, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m = cv.fit(train)
    finally:
        train.unpersist()
    return [(float(r), float(a)) for r, a in zip(regs, m.avgMetrics)], m.bestModel
