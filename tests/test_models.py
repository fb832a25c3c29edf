"""Property tests for the operators that SQL cannot express (fits, splits,
recommenders, series models), on the small driver tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL

Q = E.queries()


def test_ols_residuals_orthogonal(spark):
    from kestrel.operators.models import fitted_coefficients, linear_score, ols_fit
    from kestrel.plans.cars import design
    m, X_ALL = design(spark, SF_SMALL)
    t = ols_fit(m, "price", X_ALL)
    coefs, inter = fitted_coefficients(t)
    r = m.withColumn("e", F.col("price") - linear_score(coefs, inter))
    sums = r.agg(*[F.sum(F.col("e") * F.col(x)).alias(x) for x in X_ALL], F.sum("e").alias("one")).first()
    scale = r.agg(F.sum(F.abs("price"))).first()[0]
    assert all(abs(v) / scale < 1e-6 for v in sums.asDict().values())


def test_ols_summary_matches_numpy(spark):
    from kestrel.operators.models import ols_fit, ols_numpy
    from kestrel.plans.cars import model_frame
    xs = ["quantity", "retailprice", "discount"]
    m = model_frame(spark, SF_SMALL)
    sp = {r["term"]: r for r in ols_fit(m, "price", xs).collect()}
    pdf = m.select("price", *xs).toPandas()
    npd = ols_numpy(pdf[xs].to_numpy(float), pdf["price"].to_numpy(float), xs).set_index("term")
    for x in xs:
        assert sp[x]["estimate"] == pytest.approx(npd.loc[x, "estimate"], rel=1e-6)
        assert sp[x]["p_value"] == pytest.approx(npd.loc[x, "p_value"], abs=1e-6)


def test_vif_at_least_one(spark):
    v = [r["vif"] for r in Q["vif"](spark, SF_SMALL).collect()]
    assert all(x >= 1 - 1e-9 for x in v)


def test_stepwise_aic_decreases(spark):
    a = [r["aic"] for r in Q["stepwise_aic"](spark, SF_SMALL).orderBy("step").collect()]
    assert all(b < c for c, b in zip(a, a[1:]))


def test_cv_folds_cover_rows(spark):
    rows = Q["cv_linear"](spark, SF_SMALL).collect()
    overall = [r for r in rows if r["fold"] == -1][0]
    assert sum(r["n"] for r in rows if r["fold"] >= 0) == overall["n"]
    assert overall["ms"] > 0


def test_split_random_disjoint_and_complete(spark):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    s = Q["split_random"](spark, SF_SMALL)
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(*keys)
    assert s.select(*keys).exceptAll(li).count() == 0 and li.exceptAll(s.select(*keys)).count() == 0
    assert s.filter("is_train").select(*keys).intersect(s.filter("not is_train").select(*keys)).count() == 0
    assert 0.6 < s.filter("is_train").count() / s.count() < 0.8


def test_stratified_split_keeps_ratio(spark):
    from kestrel.operators.stats import split_stratified
    from kestrel.plans import standins as S
    s = split_stratified(S.churn(spark, SF_SMALL), "churn", "customer_id", 0.7)
    for r in s.groupBy("churn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect():
        assert r["t"] == round(r["n"] * 0.7)


def test_ubcf_excludes_rated_items(spark):
    from kestrel.plans import standins as S
    out = Q["ubcf_topn"](spark, SF_SMALL)
    rated = S.ratings(spark, SF_SMALL).select("user_id", "beer_beerid")
    assert out.join(rated, ["user_id", "beer_beerid"]).count() == 0
    assert out.groupBy("user_id").count().filter("count > 5").count() == 0


def test_cosine_in_range(spark):
    for k in ("user_cosine", "item_cosine"):
        s = [r["sim"] for r in Q[k](spark, SF_SMALL).collect() if r["sim"] is not None]
        assert all(-1 - 1e-9 <= x <= 1 + 1e-9 for x in s)


def test_ar_forecasts_and_stationarity(spark):
    f = Q["ts_forecast"](spark, SF_SMALL)
    assert f.groupBy("market", "segment", "method").count().filter("count != 6").count() == 0
    st = Q["ts_stationarity"](spark, SF_SMALL).collect()
    assert all(r["kpss"] >= 0 for r in st)


def test_adf_detects_random_walk():
    from kestrel.operators.series import adf_stat, kpss_stat
    rng = np.random.default_rng(0)
    noise = rng.normal(size=200)
    walk = np.cumsum(rng.normal(size=200))
    assert adf_stat(noise)[1] <= 0.05 < adf_stat(walk)[1]
    assert kpss_stat(walk)[0] > kpss_stat(noise)[0]


def test_collinear_total_is_aliased(spark):
    rows = {r["variable"]: r["aliased"] for r in Q["collinear_columns"](spark, SF_SMALL).collect()}
    assert rows["Total_Investment"] is True and rows["TV"] is False


def test_price_tiers_named_by_orders(spark):
    from kestrel.plans import mmm
    p = Q["price_tier_clusters"](spark, SF_SMALL)
    n = mmm.clean(spark, SF_SMALL).groupBy("sub_category", "vertical").count()
    assert p.count() == n.count()
    per = p.join(n, ["sub_category", "vertical"]).groupBy("sub_category", "price_tag").agg(F.sum("count").alias("n")).collect()
    by = {}
    for r in per:
        by.setdefault(r["sub_category"], {})[r["price_tag"]] = r["n"]
    for t in by.values():
        assert t["Mass_Product"] == max(t.values())
        assert "Premium_Product" not in t or t["Premium_Product"] == min(t.values())


def test_price_tiers_of_two_verticals(spark):
    from kestrel.operators.cluster import price_tiers
    d = spark.createDataFrame([("c", "a", 1.0, 5.0, 9), ("c", "b", 2.0, 7.0, 1), ("d", "x", 1.0, 1.0, 1)],
                              "g string, v string, u double, p double, n long")
    got = {(r["g"], r["v"]): r["price_tag"] for r in price_tiers(d, "g", "v", ["u", "p"], "p", "n").collect()}
    assert got == {("c", "a"): "Mass_Product", ("c", "b"): "Aspiring_Product", ("d", "x"): "Aspiring_Product"}


def test_kmeans_is_no_worse_than_many_runs():
    from kestrel.operators.cluster import kmeans_numpy
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.6, (12, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    lab, cost = kmeans_numpy(x, 3)
    assert cost == pytest.approx(sum(((x[lab == j] - x[lab == j].mean(0)) ** 2).sum() for j in range(3)))
    assert all(cost <= kmeans_numpy(x, 3, starts=1, seed=s)[1] + 1e-9 for s in range(2, 60))


def test_impute_widens_until_two_values(spark):
    from kestrel.operators.quality import impute_moving_average
    vals = {1: 10.0, 40: 30.0}
    d = spark.createDataFrame([("a", t, vals.get(t)) for t in range(1, 61)] + [("b", 1, None), ("b", 2, 4.0), ("c", 1, None)],
                              "k string, t int, x double")
    got = {(r["k"], r["t"]): r["x"] for r in impute_moving_average(d, ["k"], "t", "x", 2).collect()}
    assert all(got["a", t] == (vals.get(t) or 20.0) for t in range(1, 61))
    assert got["b", 1] == 4.0 and got["c", 1] is None


def test_impute_against_brute_force(spark):
    import random
    from kestrel.operators.quality import impute_moving_average
    rng = random.Random(2)
    xs = [float(rng.randint(1, 50)) if rng.random() < 0.3 else None for _ in range(120)]
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "k string, t int, x double")
    got = {r["t"]: r["x"] for r in impute_moving_average(d, ["k"], "t", "x", 3).collect()}
    for i, x in enumerate(xs):
        w = 3
        while x is None and sum(v is not None for v in xs[max(0, i - w):i + w + 1]) < 2:
            w += 1
        near = [v for v in xs[max(0, i - w):i + w + 1] if v is not None]
        assert got[i] == pytest.approx(x if x is not None else sum(near) / len(near))


def test_vif_of_columns_with_large_means(spark):
    from kestrel.operators.stats import vif
    rng = np.random.default_rng(1)
    a, b = rng.random(500), rng.random(500)
    r = np.corrcoef(a, b)[0, 1]
    for mean in (0.0, 1e6, 1e9):
        d = spark.createDataFrame([(float(mean + x), float(mean + y)) for x, y in zip(a, b)], "a double, b double")
        assert all(v["vif"] == pytest.approx(1 / (1 - r * r), rel=1e-6) for v in vif(d, ["a", "b"]).collect())


def test_dickey_fuller_table_covers_its_upper_half():
    from kestrel.operators.series import adf_stat
    rng = np.random.default_rng(3)
    ps = [adf_stat(np.cumsum(rng.normal(size=80))) for _ in range(200)]
    assert np.mean([p > 0.5 for _, p in ps]) > 0.3           # under the null p is roughly uniform
    assert max(p for _, p in ps) <= 0.99 and min(p for _, p in ps) >= 0.01
    assert all(np.isnan(v) for v in adf_stat(np.arange(6.0) ** 2))


def test_backward_elimination_agrees_with_refits(spark):
    from kestrel.operators.models import backward_eliminate, ols_numpy
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) + 1000
    x[:, 3] = x[:, 0] + rng.normal(size=300) * 0.1
    y = 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(size=300)
    names = list("abcde")
    d = spark.createDataFrame([tuple(map(float, [*r, t])) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in "abcdey"))
    out = backward_eliminate(d, "y", names, adj_r2_tol=None).collect()
    left = [r["term"] for r in out if r["step"] == -1 and r["term"] != "(Intercept)"]
    assert set(names) - set(left) == {r["term"] for r in out if r["step"] > 0} and "a" in left and "b" in left
    want = ols_numpy(x[:, [names.index(t) for t in left]], y, left).set_index("term")
    for r in out:
        if r["step"] == -1:
            assert r["p_value"] == pytest.approx(want.loc[r["term"], "p_value"], abs=1e-6)


def test_logistic_scores_satisfy_the_score_equations(spark):
    from kestrel.operators.models import fitted_coefficients, logistic_score, logit_fit, logit_stepwise_aic
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = rng.random(400) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0])))
    d = spark.createDataFrame([tuple(map(float, [*r, t])) for r, t in zip(x, y)], "a double, b double, c double, y double")
    coefs, inter = fitted_coefficients(logit_fit(d, "y", ["a", "b", "c"]))
    e = d.withColumn("e", F.col("y") - logistic_score(coefs, inter))
    s = e.agg(F.sum("e"), *[F.sum(F.col("e") * F.col(c)) for c in "abc"]).first()
    assert all(abs(v) < 1e-4 for v in s)
    steps = logit_stepwise_aic(d, "y", ["a", "b", "c"]).orderBy("step").collect()
    assert all(b["aic"] < a["aic"] for a, b in zip(steps, steps[1:])) and "a" not in [r["term"] for r in steps]


def test_svm_separates_what_is_separable(spark):
    from pyspark.ml.functions import array_to_vector
    from kestrel.operators.models import random_fourier_features, svm_one_vs_rest
    rng = np.random.default_rng(8)
    r = np.repeat([1.0, 3.0], 150) + rng.normal(0, 0.1, 300)
    t = rng.random(300) * 6.3
    d = spark.createDataFrame([(float(k >= 150), [float(a * np.cos(b)), float(a * np.sin(b))])
                               for k, (a, b) in enumerate(zip(r, t))], "y double, v array<double>")
    flat = d.withColumn("f", array_to_vector("v"))
    rbf = random_fourier_features(d, "v", 2, 200, 0.5, out="f")

    def accuracy(df):
        p, _ = svm_one_vs_rest(df, df, "y", "f")
        return p.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert accuracy(rbf) > 0.97 > 0.8 > accuracy(flat)


def test_constant_columns_are_dropped(spark):
    from kestrel.functions.columns import drop_constant_columns
    d = spark.createDataFrame([(1, "x", None, 1), (2, "x", None, None), (3, "x", None, 1)], "a int, b string, c string, e int")
    assert drop_constant_columns(d).columns == ["a", "e"]


def test_checkpoint_folder_is_required_on_clusters():
    from types import SimpleNamespace
    from kestrel.session import ensure_checkpoint_dir
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(fake)


def test_ibcf_excludes_rated_items(spark):
    from kestrel.plans import standins as S
    out = Q["ibcf_topn"](spark, SF_SMALL)
    rated = S.ratings(spark, SF_SMALL).select("user_id", "beer_beerid")
    assert out.join(rated, ["user_id", "beer_beerid"]).count() == 0
    assert out.groupBy("user_id").count().filter("count > 5").count() == 0


def test_split_random_matches_python_md5(spark):
    import hashlib
    from kestrel.operators.stats import split_random
    rows = [(i, i * 7 % 13) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = {(r["a"], r["b"]): r["is_train"] for r in split_random(df, ["a", "b"], 0.7, seed=9999).collect()}
    for a, b in rows:
        bucket = int(hashlib.md5(f"9999|{a}|{b}".encode()).hexdigest()[:8], 16) % 10000
        assert got[(a, b)] == (bucket < 7000)


def test_mmm_cleaning_keeps_all_years_or_the_period_asked_for(spark):
    from kestrel.plans import mmm
    years = lambda df, c: {r[0] for r in df.select(F.year(c)).distinct().collect()}
    c = mmm.clean(spark, SF_SMALL)
    assert years(c, "order_date") == years(spark.read.parquet(f"{SF_SMALL}/orders.parquet"), "o_orderdate")
    assert years(mmm.clean(spark, SF_SMALL, ("1998-01-01", "1998-12-31")), "order_date") == {1998}
    assert c.filter(F.col("gmv") == 0).count() == 0
    assert c.filter(F.col("sla") > mmm.SLA_CAP).count() == 0
    assert c.filter((F.col("deliverybdays") < 0) | (F.col("deliverycdays") < 0)).count() == 0


def test_score_logistic_keeps_the_mean(spark):
    r = Q["score_logistic"](spark, SF_SMALL).agg(F.avg("y"), F.avg("p_churn"), F.min("p_churn"), F.max("p_churn")).first()
    assert r[0] == pytest.approx(r[1], abs=1e-4) and 0 < r[2] and r[3] < 1


def test_logit_summary_and_search_agree(spark):
    full = Q["logit_fit"](spark, SF_SMALL).first()
    steps = Q["logit_stepwise"](spark, SF_SMALL).orderBy("step").collect()
    assert steps[0]["aic"] == pytest.approx(full["aic"], abs=1e-3)
    assert full["residual_deviance"] <= full["null_deviance"]


def test_svm_queries_on_the_test_rows(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    lin, rbf = Q["svm_linear"](spark, SF_SMALL).first(), Q["svm_rbf_rff"](spark, SF_SMALL).first()
    m = Q["confusion_matrix_multi"](spark, SF_SMALL).collect()
    assert lin["n_test"] == rbf["n_test"] == sum(r["n"] for r in m) < emb.count()
    assert lin["accuracy"] == pytest.approx(sum(r["n"] for r in m if r["actual"] == r["predicted"]) / lin["n_test"])
    by = {}
    for r in m:
        by[r["actual"]] = by.get(r["actual"], 0) + r["share_of_actual"]
    assert all(v == pytest.approx(1) for v in by.values())


def test_marketing_forms_are_least_squares(spark):
    from kestrel.plans import mmm
    got = Q["mmm_model_forms"](spark, SF_SMALL).collect()
    cats = mmm.weekly(spark, SF_SMALL).select("sub_category").distinct().count()
    assert len({(r["form"], r["sub_category"]) for r in got}) == len(mmm.FORMS) * cats
    r2 = {(r["form"], r["sub_category"]): r["r2"] for r in got}
    assert all(-1e-9 <= v <= 1 + 1e-9 for v in r2.values())
    for (form, c), v in r2.items():                          # more predictors never fit worse
        if form == "koyck":
            assert v >= r2["linear", c] - 1e-9 and r2["distributed_lag", c] >= v - 1e-9


def test_ar_orders_have_the_least_aicc(spark):
    from kestrel.operators.series import _ar_fit
    m = Q["monthly_series"](spark, SF_SMALL).toPandas().sort_values("t")
    for r in Q["ts_ar_select"](spark, SF_SMALL).collect():
        x = m[(m.market == r["market"]) & (m.segment == r["segment"])]["sales"].to_numpy(float)[:-6]
        fits = {p: _ar_fit(x, p)[2] for p in range(4)}
        assert r["p"] == min(fits, key=fits.get) and r["aicc"] == pytest.approx(min(fits.values()))


def test_compared_methods_have_the_mape_of_their_forecasts(spark):
    f = Q["ts_forecast"](spark, SF_SMALL).toPandas()
    m = Q["monthly_series"](spark, SF_SMALL).toPandas()
    j = f.merge(m, on=["market", "segment", "t"])
    j = j[j.sales != 0]
    want = ((j.sales - j.forecast) / j.sales).abs().groupby([j.market, j.segment, j.method]).mean() * 100
    got = [r for r in Q["ts_model_compare"](spark, SF_SMALL).collect() if r["mape"] is not None]
    assert len(got) == len(want)
    for r in got:
        assert r["mape"] == pytest.approx(want[r["market"], r["segment"], r["method"]], rel=1e-6)


def test_grid_has_a_row_per_point(spark):
    g = Q["grid_search_cv"](spark, SF_SMALL).collect()
    assert len(g) == 3 and all(0 <= r["cv_accuracy"] <= 1 for r in g)


def test_backward_elimination_of_the_cars_leaves_significant_terms(spark):
    out = Q["backward_eliminate"](spark, SF_SMALL).collect()
    final = [r for r in out if r["step"] == -1 and r["term"] != "(Intercept)"]
    assert all(r["p_value"] <= 0.05 for r in final)
    assert [r["step"] for r in out if r["step"] > 0] == list(range(1, len([r for r in out if r["step"] > 0]) + 1))


def test_logistic_search_fits_all_candidates_in_the_same_passes(spark):
    """The path of separate fits, in as many passes a step as one fit takes."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from kestrel.operators.models import logit_stepwise_aic
    rng = np.random.default_rng(4)
    xs = [f"x{i}" for i in range(7)]
    x = rng.standard_normal((600, 7)) * [1, 100, 1e4, 1, 1, 0.01, 1] + [0, 5e3, -1e5, 0, 2, 1, 0]
    z = (x - x.mean(0)) / x.std(0)
    y = (rng.uniform(size=600) < 1 / (1 + np.exp(-(0.3 + 1.2 * z[:, 0] - 0.8 * z[:, 1] + 0.4 * z[:, 2])))).astype(float)
    d = spark.createDataFrame([(float(t), *map(float, v)) for t, v in zip(y, x)] + [(None, *[1.0] * 7)],
                              "y double, " + ", ".join(f"{c} double" for c in xs)).repartition(3)

    def aic(terms):
        v = VectorAssembler(inputCols=terms, outputCol="f").transform(d.dropna())
        return GeneralizedLinearRegression(family="binomial", featuresCol="f", labelCol="y", maxIter=50, tol=1e-10).fit(v).summary.aic
    passes = []
    got = logit_stepwise_aic(d, "y", xs, passes).orderBy("step").collect()
    terms, best, want = list(xs), aic(xs), []
    want.append(("start", None, best))
    while True:
        moves = [("drop", t, [q for q in terms if q != t]) for t in terms] + \
            [("add", t, [q for q in xs if q in terms or q == t]) for t in xs if t not in terms]
        scored = sorted((aic(m), a, t, m) for a, t, m in moves)
        if scored[0][0] >= best - 1e-9:
            break
        best, terms = scored[0][0], scored[0][3]
        want.append((scored[0][1], scored[0][2], best))
    assert [(r["action"], r["term"]) for r in got] == [w[:2] for w in want]
    assert [r["aic"] for r in got] == pytest.approx([w[2] for w in want], abs=1e-5)
    assert len(want) > 2 and all(p <= 9 for p in passes)


@pytest.mark.parametrize("fit", ["svm", "grid"])
def test_passes_of_svm_fits_have_few_tasks(spark, fit, monkeypatch):
    """The rows of 150 partitions are fitted in a bounded number, none is lost."""
    from pyspark.ml.functions import array_to_vector

    from kestrel.operators import models
    rows = spark.createDataFrame([(float(i % 2), [float(i % 2) + 0.01 * i, 1.0]) for i in range(300)], "label double, v array<double>")
    rows = rows.select("label", array_to_vector("v").alias("features")).repartition(150)
    seen = []
    fit_of = {"svm": models.OneVsRest, "grid": models.CrossValidator}[fit]
    real = fit_of.fit

    def counted(self, dataset, params=None):
        seen.append((dataset.rdd.getNumPartitions(), dataset.count()))
        return real(self, dataset, params)
    monkeypatch.setattr(fit_of, "fit", counted)
    if fit == "svm":
        models.svm_one_vs_rest(rows, rows, "label", "features", max_iter=2)
    else:
        models.grid_search_cv(rows, "label", "features", (0.1,), 2, max_iter=2)
    assert seen == [(max(16, 2 * spark.sparkContext.defaultParallelism), 300)]
