"""Hand-sized fixtures for the R-semantics rules and operator identities."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrel.functions.columns import (compact_time_to_timestamp, floor_invalid_to_zero, repair_corrupt_text,
                                       week_of_year_simple, week_start_sunday)
from kestrel.operators.evaluate import confusion_counts, cutoff_sweep, ks_from_scores, mape
from kestrel.operators.ordered import (adstock, exact_percentiles, global_rank, ntile_by_rank, prefix_sums,
                                       trailing_mean, tukey_hinges)
from kestrel.operators.quality import impute_mode, impute_moving_average
from kestrel.operators.relational import dedup_key, top_k_per_group
from kestrel.operators.series import centered_smooth


def test_type7_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    q = {r["p"]: r["value"] for r in exact_percentiles(df, "x", [0.25, 0.5, 1.0]).collect()}
    assert q[0.25] == pytest.approx(1.75)
    assert q[0.5] == pytest.approx(3.0)
    assert q[1.0] == pytest.approx(10.0)


@pytest.mark.parametrize("xs,lh,uh", [([1, 2, 3, 4, 5], 2, 4), ([1, 2, 3, 4, 5, 6], 2, 5),
                                      ([2, 10, 3, 7, 1], 2, 7)])
def test_tukey_hinges(spark, xs, lh, uh):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    h = tukey_hinges(df, "x").first()
    assert h["lower_hinge"] == lh and h["upper_hinge"] == uh


def test_global_rank_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 1013).alias("v"), F.col("id"))
    r = global_rank(df, ["v", "id"], None, "rk")
    want = df.withColumn("rk2", F.row_number().over(Window.orderBy("v", "id")))
    bad = r.join(want, ["v", "id"]).filter(F.col("rk") != F.col("rk2")).count()
    assert bad == 0 and r.count() == 5000


def test_grouped_rank_and_prefix_sums(spark):
    df = spark.range(0, 300).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"), F.lit(1).alias("one"))
    r = global_rank(df, ["v"], ["g"], "rk")
    assert r.groupBy("g").agg(F.max("rk").alias("m")).filter("m != 100").count() == 0
    p = prefix_sums(df, ["v"], ["one"])
    assert p.filter(F.col("cum_one") != F.col("v") + 1).count() == 0


def test_ntile_sizes(spark):
    n = 23
    df = spark.range(1, n + 1).withColumn("b", ntile_by_rank(F.col("id"), F.lit(n), 10))
    sizes = sorted(r["count"] for r in df.groupBy("b").count().collect())
    assert sizes == [2] * 7 + [3] * 3
    want = spark.range(1, n + 1).withColumn("b2", F.ntile(10).over(Window.orderBy("id")))
    assert df.join(want, "id").filter("b != b2").count() == 0


def test_adstock_recursion(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 0.0), (3, 4.0)], "t int, x double").withColumn("k", F.lit(1))
    got = [r["a"] for r in adstock(df, ["k"], "t", "x", 0.5, "a").orderBy("t").collect()]
    assert got == [10.0, 5.0, 6.5]


def test_trailing_mean_and_imputation(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([2, 4, 6, 8, 10], 1)], "t int, x double") \
        .withColumn("k", F.lit(1))
    m = df.withColumn("ma", trailing_mean(["k"], "t", "x", 3))
    got = [r["ma"] for r in m.orderBy("t").collect()]
    assert got[:2] == [None, None] and got[2:] == [4.0, 6.0, 8.0]
    f = impute_moving_average(m, ["k"], "t", "ma", 2)
    got = [r["ma"] for r in f.orderBy("t").collect()]
    assert got[0] == pytest.approx(5.0) and got[1] == pytest.approx(5.0)


def test_centered_smooth_with_end_extrapolation(spark):
    xs = [1.0, 3.0, 2.0, 6.0, 4.0, 8.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(xs, 1)], "k string, t int, y double")
    s = [r["smoothed"] for r in centered_smooth(df, ["k"], "t", "y", 1).orderBy("t").collect()]
    inner = [(xs[i - 1] + xs[i] + xs[i + 1]) / 3 for i in range(1, 5)]
    assert s[1:5] == pytest.approx(inner)
    assert s[0] == pytest.approx(inner[0] - (inner[1] - inner[0]))
    assert s[5] == pytest.approx(inner[-1] + (inner[-1] - inner[-2]))


def test_compact_time_parsing(spark):
    rows = [("2017-01-05", "1205A"), ("2017-01-05", "0005A"), ("2017-01-05", "8700P"), ("2017-01-05", "0143P"),
            ("2017-01-05", "0.5na")]
    df = spark.createDataFrame(rows, "d string, vt string").withColumn("d", F.to_date("d"))
    got = [r[0] for r in df.select(compact_time_to_timestamp(F.col("d"), F.col("vt"))).collect()]
    assert got[0] == dt.datetime(2017, 1, 5, 0, 5)
    assert got[1] == dt.datetime(2017, 1, 5, 0, 5)  # '00' read as 12 -> 12:05 AM
    assert got[2] is None and got[4] is None
    assert got[3] == dt.datetime(2017, 1, 5, 13, 43)


def test_weeks(spark):
    df = spark.createDataFrame([("2016-01-01",), ("2016-01-07",), ("2016-01-08",), ("2017-06-14",)], "d string") \
        .select(F.to_date("d").alias("d"))
    r = df.select(F.weekofyear("d").alias("iso"), week_of_year_simple(F.col("d")).alias("w"),
                  week_start_sunday(F.col("d")).alias("sun")).collect()
    assert r[0]["iso"] == 53 and r[0]["w"] == 1 and r[1]["w"] == 1 and r[2]["w"] == 2
    assert r[3]["sun"] == dt.date(2017, 6, 11)


def test_dense_rank_ties(spark):
    df = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("a", "z", 4), ("a", "w", 3), ("a", "v", 1)],
                               "g string, c string, n int")
    got = top_k_per_group(df, ["g"], [F.desc("n")], 3).collect()
    assert sorted(r["c"] for r in got) == ["w", "x", "y", "z"]


def test_confusion_with_empty_predicted_class(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "a int, p int")
    r = confusion_counts(df, F.col("a"), F.col("p")).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (0, 0, 1, 2)
    assert r["sensitivity"] == 0.0 and r["specificity"] == 1.0


def test_cutoff_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)), float(round(rng.random(), 3))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    cs = [0.01 + i * (0.79 / 99) for i in range(100)]
    got = {round(r["cutoff"], 12): (r["tp"], r["fp"]) for r in cutoff_sweep(df, "y", "s", cs).collect()}
    for c in cs:
        tp = sum(1 for y, s in rows if y == 1 and s >= c)
        fp = sum(1 for y, s in rows if y == 0 and s >= c)
        assert got[round(c, 12)] == (tp, fp)


def test_ks_matches_brute_force(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (0, 0.4), (1, 0.4), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, s double")
    ks = ks_from_scores(df, "y", "s").first()["ks"]
    p, n = 4, 4
    best = max(sum(1 for y, s in rows if y == 1 and s >= t) / p - sum(1 for y, s in rows if y == 0 and s >= t) / n
               for t in {s for _, s in rows})
    assert ks == pytest.approx(best)


def test_mape_skips_zero_actual(spark):
    df = spark.createDataFrame([(100.0, 90.0), (0.0, 5.0), (50.0, 55.0)], "a double, f double")
    assert df.agg(mape(F.col("a"), F.col("f"))).first()[0] == pytest.approx(10.0)


def test_dedup_keeps_smallest_row(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, "c", 1)], "k int, s string, v int")
    got = sorted(tuple(r) for r in dedup_key(df, ["k"]).collect())
    assert got == [(1, "a", 9), (2, "c", 1)]


def test_impute_mode_tie_smallest(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, 5), (4, 3), (5, None)], "i int, x int")
    assert impute_mode(df, "x").filter("i = 5").first()["x"] == 3


def test_text_repair_and_sentinels(spark):
    df = spark.createDataFrame([("Alter0tive Medicine",), ("Enterprise 2.0",), ("\\N",), ("-3",), ("7",)], "s string")
    r = df.select(repair_corrupt_text(F.col("s")).alias("r"), floor_invalid_to_zero(F.col("s")).alias("z")).collect()
    assert r[0]["r"] == "Alternative Medicine" and r[1]["r"] == "Enterprise 2.0"
    assert [x["z"] for x in r[2:]] == [0, 0, 7]


def test_student_t_pvalue():
    from kestrel.operators.models import t_two_sided_p
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided_p(12.0, 3) == pytest.approx(0.001241, abs=1e-5)
    assert math.isclose(t_two_sided_p(-2.0, 10), t_two_sided_p(2.0, 10))


def test_percentiles_with_a_hot_value(spark):
    """A value repeated on 40% of rows (the skew case) still gives exact
    type-7 percentiles and hinges."""
    rng = np.random.default_rng(11)
    xs = [5.0] * 400 + [float(v) for v in rng.normal(0, 10, 600).round(3)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.6, 0.9, 1.0]
    got = {r["p"]: r["value"] for r in exact_percentiles(df, "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(xs, p)), abs=1e-9)
    h = tukey_hinges(df, "x").first()
    s = sorted(xs)
    n4 = math.floor((len(s) + 3) / 2) / 2
    lower = (s[math.floor(n4) - 1] + s[math.ceil(n4) - 1]) / 2
    assert h["lower_hinge"] == pytest.approx(lower)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_percentiles_random_against_numpy(spark, seed):
    """Randomised: grouped exact percentiles equal numpy's type-7 quantiles,
    including heavy ties (values drawn from a small set)."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(50, 400))
    vals = rng.choice(rng.normal(0, 5, 12).round(2), size=n)
    grp = rng.integers(0, 3, size=n)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = {(r["g"], r["p"]): r["value"] for r in exact_percentiles(df, "x", probs, ["g"]).collect()}
    for g in set(grp.tolist()):
        xs = vals[grp == g]
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.quantile(xs, p)), abs=1e-9)


def test_prefix_sums_grouped_random(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(v), int(w)) for g, v, w in zip(rng.integers(0, 4, 300), rng.permutation(300),
                                                        rng.integers(1, 9, 300))]
    df = spark.createDataFrame(rows, "g int, v int, w int")
    got = {(r["g"], r["v"]): r["cum_w"] for r in prefix_sums(df, ["v"], ["w"], group=["g"]).collect()}
    for g in range(4):
        acc = 0
        for _, v, w in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            acc += w
            assert got[(g, v)] == acc
