"""Many least-squares model searches at once, from grouped Gram matrices.

Every (form, product, ...) group has a design: a response, a list of
predictors.  One aggregate gives the mean and spread of each column of each
group, a second one the cross-products of the standardised columns per
group and fold.  All that follows needs these k x k numbers only: aliased columns, the
search by AIC, elimination by VIF and p-value, the final fit and its
cross-validation run in one task per group that holds a few small matrices,
however many rows the group has.  Rows are not read again for any model.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.models import eliminate_terms, lm_aic, scaled_inverse, term_estimates
from kestrel.operators.stats import aliased_columns

RESULT = ("stage string, step int, term string, aic double, p_value double, vif double, estimate double, "
          "std_error double, t_value double, elasticity double, r2 double, adj_r2 double, cv_ms double, n long")
_FIELDS = [f.split()[0] for f in RESULT.split(", ")]


def column_stats(designs: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean and sample standard deviation of every element of `vector` per group: keys, i, mean, sd."""
    return designs.select(*keys, F.posexplode(vector).alias("i", "v")).groupBy(*keys, "i") \
        .agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))


def grouped_gram(rows: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """Cross-products of the elements of `vector` (at most `size`) per group: keys, i, products (row i of the matrix).

    A row of data gives one row per element, so each sum of an element's
    products is combined before the shuffle; the matrix never is one column per pair."""
    each = rows.select(*keys, F.col(vector).alias("__z"), F.posexplode(vector).alias("i", "__v"))
    return each.groupBy(*keys, "i").agg(F.array(*[F.sum(F.col("__v") * F.get("__z", F.lit(j)))
                                                  for j in range(size)]).alias("products"))


def stepwise_from_empty(n: int, c: np.ndarray, allowed: list[int]) -> tuple[list[int], list[tuple[str, int | None, float]]]:
    """step(lm(y ~ 1), scope = all, direction = "both") on centred cross-products (the
    response last): at each step the addition or removal with the least AIC, while it
    lowers AIC.  Returns the model and the moves (action, column, AIC)."""
    floor = 1e-12 * c[-1, -1]

    def aic(idx):
        b = c[idx, -1]
        rss = c[-1, -1] - (b @ scaled_inverse(c[np.ix_(idx, idx)]) @ b if idx else 0.0)
        return lm_aic(n, max(float(rss), floor), len(idx) + 1)
    model: list[int] = []
    now = aic(model)
    moves: list[tuple[str, int | None, float]] = [("start", None, now)]
    for _ in range(1000):
        tries = [(aic(model + [j]), "add", j, model + [j]) for j in allowed if j not in model] + \
            [(aic([i for i in model if i != j]), "drop", j, [i for i in model if i != j]) for j in model]
        best = min(tries, key=lambda t: t[0], default=None)
        if best is None or best[0] >= now - 1e-9:
            break
        now, model = best[0], best[3]
        moves.append((best[1], best[2], now))
    return sorted(model), moves


def cross_validated(folds: list[np.ndarray], idx: list[int]) -> float:
    """Mean squared prediction error of the model on columns `idx` (1-based, the constant is 0), each fold
    predicted by the fit to the others: the error of a fold is a quadratic form in its own products."""
    total, use, last = sum(folds), [0, *idx], folds[0].shape[0] - 1
    ss = 0.0
    for g in folds:
        t = total - g
        beta = scaled_inverse(t[np.ix_(use, use)]) @ t[use, last]
        w = np.append(beta, -1.0)
        at = [*use, last]
        ss += float(w @ g[np.ix_(at, at)] @ w)
    return max(ss, 0.0) / total[0, 0]


def model_chain(folds: list[np.ndarray], mean: np.ndarray, sd: np.ndarray, names: list[str], logged: bool, alpha: float = 0.05,
                vif_cut: float = 2.0, adj_r2_tol: float | None = 0.01) -> pd.DataFrame:
    """One group's search.  folds: cross-products of (1, standardised predictors, standardised
    response) per fold; mean, sd: of predictors and response.  Stages, in order:
    alias (columns that earlier ones determine), stepwise (moves by AIC), eliminate
    (removals by VIF, p-value, adjusted R^2), final (the terms left).

    Estimates are of the standardised response and predictors for a linear
    form, of the logarithms for a `logged` one; the elasticity is the relative
    change of the response at the means for the former, the estimate itself for the
    latter.  cv_ms is in squared units of the (logged) response."""
    total = sum(folds)
    n = int(round(total[0, 0]))
    s = total[0, 1:]
    c = total[1:, 1:] - np.outer(s, s) / n
    rows: list[dict] = []
    gone = aliased_columns(c[:-1, :-1])
    rows += [dict(stage="alias", step=k, term=names[j]) for k, j in enumerate(gone)]
    model, moves = stepwise_from_empty(n, c, [j for j in range(len(names)) if j not in gone])
    rows += [dict(stage=f"stepwise_{a}", step=k, term=None if j is None else names[j], aic=v) for k, (a, j, v) in enumerate(moves)]
    left, log = eliminate_terms(n, s / n, c, model, alpha, vif_cut, adj_r2_tol)
    rows += [dict(stage="eliminate", step=k, term=names[j], p_value=p, vif=v) for k, (j, p, v) in enumerate(log)]
    est, se, p, vif, r2, adj = term_estimates(n, s / n, c, left)
    cv = cross_validated(folds, [j + 1 for j in left]) * float(sd[-1]) ** 2
    for k, j in enumerate([None, *left]):
        raw = None if j is None else est[k] * sd[-1] / sd[j]
        if not logged or j is None:
            e, u = est[k], se[k]
            share = None if j is None or mean[-1] == 0 else raw * mean[j] / mean[-1]
        else:
            e, u, share = raw, se[k] * sd[-1] / sd[j], raw
        if j is None and logged:                          # the constant of the logged model itself
            e = mean[-1] + sd[-1] * est[0] - sum(est[q + 1] * sd[-1] / sd[i] * mean[i] for q, i in enumerate(left))
            u = None
        rows.append(dict(stage="final", step=k, term="(Intercept)" if j is None else names[j], estimate=e, std_error=u,
                         t_value=est[k] / se[k] if u is not None and se[k] > 0 else None, p_value=p[k] if u is not None else None,
                         vif=None if j is None else vif[k - 1], elasticity=share, r2=r2, adj_r2=adj, cv_ms=cv, n=n))
    return pd.DataFrame([{f: None if (v := r.get(f)) is None or (isinstance(v, float) and math.isnan(v)) else v for f in _FIELDS}
                         for r in rows], columns=_FIELDS, dtype=object)


def model_sweep(designs: DataFrame, keys: list[str], terms: dict[str, list[str]], logged: set[str] = frozenset(), folds: int = 5,
                alpha: float = 0.05, vif_cut: float = 2.0, adj_r2_tol: float | None = 0.01) -> DataFrame:
    """The whole search for every group of `designs` (keys..., fold, v), as rows of RESULT.

    keys[0] names the form: terms[form] are its predictors, v holds them in this
    order and then the response (of the logarithms already if the form is in
    `logged`).  fold is 0 .. folds - 1.  Rows with a null or non-finite element are left out.
    Keys are strings; group sizes differ freely."""
    size = max(map(len, terms.values())) + 2
    ok = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    designs = designs.filter(ok)
    stats = column_stats(designs, keys, "v")
    wide = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "mean", "sd"))).alias("s"))
    z = F.concat(F.array(F.lit(1.0)), F.zip_with("v", "s", lambda x, s: F.coalesce(F.try_divide(x - s["mean"], s["sd"]), F.lit(0.0))))
    rows = designs.join(wide, keys).select(*keys, "fold", z.alias("z"))
    gram = grouped_gram(rows, [*keys, "fold"], "z", size)
    gram = gram.join(stats.withColumn("i", F.col("i") + 1), [*keys, "i"], "left")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        key = [g[k].iloc[0] for k in keys]
        names = terms[key[0]]
        m = len(names) + 2
        mats = []
        for f in range(folds):
            part = g[g["fold"] == f].sort_values("i")
            mats.append(np.stack([np.asarray(r, float)[:m] for r in part["products"]]) if len(part) else np.zeros((m, m)))
        one = g.drop_duplicates("i").sort_values("i")
        out = model_chain(mats, one["mean"].to_numpy(float)[1:], one["sd"].to_numpy(float)[1:], names, key[0] in logged,
                          alpha, vif_cut, adj_r2_tol)
        for k, v in reversed(list(zip(keys, key))):
            out.insert(0, k, v)
        return out
    return gram.groupBy(*keys).applyInPandas(search, ", ".join(f"{k} string" for k in keys) + ", " + RESULT)
