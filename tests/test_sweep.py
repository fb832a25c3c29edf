"""The model sweep works on Gram matrices; here every step is done again by fits to the rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators.models import t_two_sided_p
from kestrel.operators.sweep import cross_validated, model_sweep
from kestrel.plans import mmm
from kestrel.plans.catalog import QUERIES as Q
from tests.conftest import SF_SMALL


def fit(x, y):
    """Coefficients (intercept first), RSS, standard errors, p-values by least squares on rows."""
    a = np.column_stack([np.ones(len(y)), x]) if x.shape[1] else np.ones((len(y), 1))
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rss = float(((y - a @ beta) ** 2).sum())
    dof = max(len(y) - a.shape[1], 1)
    se = np.sqrt(np.diag(np.linalg.pinv(a.T @ a)) * rss / dof)
    return beta, rss, se, [t_two_sided_p(b / s, dof) if s > 0 else math.nan for b, s in zip(beta, se)]


def vifs(x):
    out = []
    for j in range(x.shape[1]):
        others = np.delete(x, j, 1)
        rss = fit(others, x[:, j])[1]
        out.append(((x[:, j] - x[:, j].mean()) ** 2).sum() / rss)
    return out


def brute(x, y, fold, alpha=0.05, vif_cut=2.0, tol=0.01):
    """The chain on standardised rows: aliased columns, moves, eliminations, final columns, fit, CV error."""
    n = len(y)
    alias, kept = [], []
    for j in range(x.shape[1]):
        left = fit(x[:, kept], x[:, j])[1] if kept else ((x[:, j] - x[:, j].mean()) ** 2).sum()
        (alias if left <= 1e-9 * max(((x[:, j] - x[:, j].mean()) ** 2).sum(), 1e-300) else kept).append(j)

    def aic(idx):
        return n * math.log(fit(x[:, idx], y)[1] / n) + 2 * (len(idx) + 1)
    model, now, moves = [], aic([]), [("start", None)]
    values = [now]
    while True:
        tries = [(aic(model + [j]), "add", j, model + [j]) for j in kept if j not in model]
        tries += [(aic([i for i in model if i != j]), "drop", j, [i for i in model if i != j]) for j in model]
        best = min(tries, key=lambda t: t[0])
        if best[0] >= now - 1e-9:
            break
        now, model = best[0], best[3]
        moves.append((best[1], best[2]))
        values.append(now)
    model, gone = sorted(model), []
    while model:
        p, v = fit(x[:, model], y)[3][1:], vifs(x[:, model])
        bad = [k for k in range(len(model)) if p[k] > alpha]
        if not bad:
            break
        k = max(bad, key=lambda q: v[q])
        if v[k] <= vif_cut:
            k = max(bad, key=lambda q: p[q])
        gone.append(model.pop(k))

    def adj(idx):
        tss = ((y - y.mean()) ** 2).sum()
        return 1 - fit(x[:, idx], y)[1] / tss * (n - 1) / (n - len(idx) - 1)
    while len(model) > 1:
        cost, j = min((adj(model) - adj([i for i in model if i != j]), j) for j in model)
        if cost >= tol:
            break
        gone.append(j)
        model.remove(j)
    err = np.empty(n)
    for f in np.unique(fold):
        t = fold != f
        beta = fit(x[t][:, model], y[t])[0]
        err[~t] = y[~t] - np.column_stack([np.ones((~t).sum()), x[~t][:, model]]) @ beta
    return alias, moves, values, gone, model, fit(x[:, model], y), float((err ** 2).mean())


def check(got, names, x, y, fold, logged):
    """Rows of one group against the chain on its rows."""
    mean, sd = np.append(x.mean(0), y.mean()), np.append(x.std(0, ddof=1), y.std(ddof=1))
    z = np.where(sd[:-1] > 0, (x - mean[:-1]) / np.where(sd[:-1] > 0, sd[:-1], 1), 0)
    alias, moves, values, gone, model, (beta, rss, se, p), cv = brute(z, (y - mean[-1]) / sd[-1], fold)
    by = {}
    for r in sorted(got, key=lambda r: r["step"]):
        by.setdefault(r["stage"].split("_")[0], []).append(r)
    assert [r["term"] for r in by.get("alias", [])] == [names[j] for j in alias]
    assert [(r["stage"][9:], r["term"]) for r in by["stepwise"]] == [(a, None if j is None else names[j]) for a, j in moves]
    assert [r["aic"] for r in by["stepwise"]] == pytest.approx(values, rel=1e-7, abs=1e-6)
    assert [r["term"] for r in by.get("eliminate", [])] == [names[j] for j in gone]
    final = by["final"]
    assert [r["term"] for r in final] == ["(Intercept)", *[names[j] for j in model]]
    for k, (r, j) in enumerate(zip(final[1:], model), start=1):
        raw = beta[k] * sd[-1] / sd[j]
        assert r["estimate"] == pytest.approx(raw if logged else beta[k], rel=1e-6)
        assert r["t_value"] == pytest.approx(beta[k] / se[k], rel=1e-6)
        assert r["p_value"] == pytest.approx(p[k], rel=1e-4, abs=1e-12)
        assert r["elasticity"] == pytest.approx(raw if logged else raw * mean[j] / mean[-1], rel=1e-6)
    if logged:
        own = fit(x[:, model], y)[0]
        assert [r["estimate"] for r in final] == pytest.approx(list(own), rel=1e-6, abs=1e-8)
    assert final[0]["n"] == len(y) and final[0]["cv_ms"] == pytest.approx(cv * sd[-1] ** 2, rel=1e-6)
    assert final[0]["r2"] == pytest.approx(1 - rss / (len(y) - 1), rel=1e-9)


def test_sweep_of_random_designs(spark):
    rng = np.random.default_rng(5)
    terms = {"a": [f"x{i}" for i in range(9)], "b": [f"x{i}" for i in range(6)]}
    rows, data = [], {}
    for form, names in terms.items():
        for group, n in (("g1", 60), ("g2", 140), ("g3", 35)):
            x = rng.standard_normal((n, len(names))) * rng.uniform(0.01, 1e4, len(names)) + rng.uniform(-50, 50, len(names))
            x[:, 3] = 2 * x[:, 0] - x[:, 1]                       # determined by earlier ones
            x[:, 5] = 7.0                                         # constant
            if len(names) > 7:
                x[:, 7] = x[:, 2] + 0.3 * x[:, 7] / x[:, 7].std() * x[:, 2].std()
            z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
            y = 5 + 3 * z[:, 0] - 2 * z[:, 2] + 0.4 * z[:, 4] + rng.standard_normal(n)
            fold = rng.integers(0, 4, n)
            data[form, group] = x, y, fold
            rows += [(form, group, int(f), [*map(float, v), float(t)]) for v, t, f in zip(x, y, fold)]
    rows += [("a", "g1", 0, [float("nan")] * 10), ("a", "g1", 0, [1.0] * 9 + [None])]
    d = spark.createDataFrame(rows, "form string, grp string, fold int, v array<double>").repartition(5)
    out = model_sweep(d, ["form", "grp"], terms, {"b"}, 4).collect()
    assert {(r["form"], r["grp"]) for r in out} == data.keys()
    for (form, group), (x, y, fold) in data.items():
        check([r for r in out if (r["form"], r["grp"]) == (form, group)], terms[form], x, y, fold, form == "b")


def test_fold_errors_are_quadratic_forms():
    rng = np.random.default_rng(8)
    x, fold = rng.standard_normal((50, 3)), rng.integers(0, 5, 50)
    y = x @ [1, -1, 0.5] + rng.standard_normal(50)
    v = np.column_stack([np.ones(50), x, y])
    want = 0.0
    for f in range(5):
        t = fold != f
        want += ((y[~t] - v[~t][:, [0, 1, 3]] @ np.linalg.lstsq(v[t][:, [0, 1, 3]], y[t], rcond=None)[0]) ** 2).sum()
    got = cross_validated([v[fold == f].T @ v[fold == f] for f in range(5)], [1, 3])
    assert got == pytest.approx(want / 50, rel=1e-9)


def test_marketing_sweep_against_refits(spark):
    table = mmm.sweep_table(spark, SF_SMALL)
    rows = mmm.sweep_designs(table).collect()
    final, log = Q["mmm_model_sweep"](spark, SF_SMALL).collect(), Q["mmm_sweep_log"](spark, SF_SMALL).collect()
    groups = {(r["form"], r["sub_category"]) for r in rows}
    assert len(groups) == len(mmm.SWEEP_FORMS) * table.select("sub_category").distinct().count()
    assert {(r["form"], r["sub_category"]) for r in final} == groups
    for form, cat in sorted(groups)[::4]:
        part = [r for r in rows if (r["form"], r["sub_category"]) == (form, cat)]
        v, fold = np.array([r["v"] for r in part]), np.array([r["fold"] for r in part])
        mine = [r for r in final if (r["form"], r["sub_category"]) == (form, cat)]
        names = mmm.SWEEP_FORMS[form]
        kept = [names.index(r["term"]) for r in sorted(mine, key=lambda r: r["step"])[1:]]
        x, y = v[:, kept], v[:, -1]
        beta = fit(x, y)[0][1:]
        got = [r for r in sorted(mine, key=lambda r: r["step"])[1:]]
        for k, r in enumerate(got):
            scale = 1 if form in mmm.LOGGED else x[:, k].std(ddof=1) / y.std(ddof=1)
            assert r["estimate"] == pytest.approx(beta[k] * scale, rel=1e-5)
            assert r["elasticity"] == pytest.approx(beta[k] if form in mmm.LOGGED else beta[k] * x[:, k].mean() / y.mean(), rel=1e-5)
            assert r["direction"] == ("Positive" if r["elasticity"] > 0 else "Negative")
        steps = sorted((r for r in log if (r["form"], r["sub_category"]) == (form, cat) and r["stage"].startswith("step")),
                       key=lambda r: r["step"])
        assert all(a["aic"] > b["aic"] for a, b in zip(steps, steps[1:]))
        if steps[1:]:                                           # the first addition is the best single predictor
            first = names.index(steps[1]["term"])
            r2 = [np.corrcoef(v[:, j], y)[0, 1] ** 2 if v[:, j].std() > 0 else 0 for j in range(len(names))]
            assert r2[first] == pytest.approx(max(r2), rel=1e-9)
        assert len(fold) == got[0]["n"] if got else True


def test_designs_take_logarithms_of_shifted_columns(spark):
    table = mmm.sweep_table(spark, SF_SMALL)
    rows = mmm.sweep_designs(table).filter(F.col("form") == "multiplicative_lag").collect()
    raw = table.select("sub_category", *mmm.SWEEP_FORMS["multiplicative_lag"], "gmv").collect()
    least = {}
    for r in raw:
        for c, x in r.asDict().items():
            if c != "sub_category":
                least[r["sub_category"], c] = min(least.get((r["sub_category"], c), math.inf), float(x))
    want = sorted(tuple(round(math.log((1 + x - m if (m := least[r["sub_category"], c]) < 0 else x) or 1e-5), 6)
                        for c, x in ((c, float(r[c])) for c in [*mmm.SWEEP_FORMS["multiplicative_lag"], "gmv"])) for r in raw)
    assert sorted(tuple(round(x, 6) for x in r["v"]) for r in rows) == want


def test_the_sweep_cleans_the_order_lines_once(spark, monkeypatch):
    clean, calls = mmm.clean, []
    monkeypatch.setattr(mmm, "clean", lambda *a: calls.append(a) or clean(*a))
    assert mmm.sweep_table(spark, SF_SMALL).count() > 0
    assert len(calls) == 1


def test_cells_of_lines_give_the_means_of_the_lines(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"c{i % 3}", f"v{i % 4}" if i % 11 else None, 1995 + i % 2, 1 + i % 12, 199500 + i % 7, *map(float, rng.uniform(1, 50, 2)), *map(int, rng.integers(0, 9, 2)),
             None if i % 5 == 0 else int(i % 9), int(i % 3), None if i % 4 == 0 else int(i % 2), *map(float, rng.uniform(1, 90, 3).round(6)))
            for i in range(300)]
    names = ["sub_category", "vertical", "Year", "Month", "week", "gmv", "units", "deliverybdays", "deliverycdays", "sla", "procurement_sla",
             "payment_ind", "product_mrp", "list_price", "promotional_offer"]
    lines = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(
        names, ["string"] * 2 + ["int"] * 3 + ["double"] * 2 + ["int"] * 5 + ["double"] * 3))).repartition(3)
    monkeypatch.setattr(mmm, "clean", lambda *a: lines)
    cells, means = mmm.cells_and_verticals(spark, SF_SMALL)
    assert sorted(map(repr, cells.collect())) == sorted(map(repr, mmm.line_cells(spark, SF_SMALL).select(*cells.columns).collect()))
    got = {(r["sub_category"], r["vertical"]): r for r in means.collect()}
    for r in lines.groupBy("sub_category", "vertical").agg(F.avg("units").alias("u"), F.avg("list_price").alias("l"),
                                                           F.avg("product_mrp").alias("m"), F.count("*").alias("n")).collect():
        g = got[r["sub_category"], r["vertical"]]
        assert [g["units"], g["list_price"], g["product_mrp"], g["n_orders"]] == pytest.approx([r["u"], r["l"], r["m"], r["n"]], rel=1e-12)
    week = {(r["sub_category"], r["week"]): r for r in mmm.weekly(spark, SF_SMALL, cells).collect()}
    cols = ["sla", "deliverybdays", "promotional_offer", "payment_ind"]
    for r in lines.groupBy("sub_category", "week").agg(F.sum("gmv").alias("g"), F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols]).collect():
        w = week[r["sub_category"], r["week"]]
        assert [w["gmv"], w["n_orders"], w["sla"], w["deliverybdays"], w["promotional_offer"], w["per_order"]] == \
            pytest.approx([r["g"], r["n"], *[r[c] for c in cols]], rel=1e-9)
