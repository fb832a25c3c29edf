"""Grouped k-means: passes over blocks against k-means of each group whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators.cluster import grouped_kmeans, kmeans_numpy, price_tiers

SCHEMA = "g string, i long, a double, b double"


def made(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in sizes.items():
        at = rng.permutation([(0, 0), (9, 1), (2, 8)]) + rng.normal(0, 1, 2)
        rows += [(g, len(rows) + j, *map(float, at[j % 3] + rng.normal(0, 0.8, 2))) for j in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def whole(rows, g):
    x = np.array([r[2:] for r in sorted(rows, key=lambda r: r[1]) if r[0] == g])
    return kmeans_numpy((x - x.mean(0)) / x.std(0, ddof=1), 3)


def classes(labels):
    out = {}
    for i, c in labels:
        out.setdefault(c, set()).add(i)
    return {frozenset(v) for v in out.values()}


def test_passes_find_what_the_whole_group_gives(spark):
    sizes = {"hot": 600, "mid": 200, "edge": 64, "low": 40, None: 150}
    rows, d = made(spark, sizes)
    got = grouped_kmeans(d, "g", "i", ["a", "b"], block=64).collect()
    assert len(got) == len(rows)
    for g in sizes:
        lab, cost = whole(rows, g)
        mine = [r for r in got if r["g"] == g]
        assert [r["cost"] for r in mine] == pytest.approx([cost] * sizes[g], rel=1e-9)
        ids = sorted(r[1] for r in rows if r[0] == g)
        assert classes((r["i"], r["cluster"]) for r in mine) == classes(zip(ids, lab))
    one = grouped_kmeans(d, "g", "i", ["a", "b"]).collect()
    assert {(r["g"], round(r["cost"], 6)) for r in one} == {(r["g"], round(r["cost"], 6)) for r in got}


def test_odd_rows(spark):
    few = [("same", j, 1.0, 2.0) for j in range(90)] + [("two", j, float(j % 2), 1.0) for j in range(90)]
    odd = [("two", 500, None, 1.0), ("two", 501, float("nan"), 1.0), ("none", 502, None, None), ("one", 503, 1.0, 1.0)]
    d = spark.createDataFrame(few + odd, SCHEMA)
    for block in (30, 4096):
        got = {r["i"]: r for r in grouped_kmeans(d.withColumn("x", F.lit("clash")), "g", "i", ["a", "b"], block=block)
               .filter("g != 'same'").collect()}
        assert {got[i]["cluster"] for i in (500, 501, 502)} == {None} and got[503]["cluster"] == 0
        assert len({(i % 2, got[i]["cluster"]) for i in range(90)}) == 2
        same = grouped_kmeans(d, "g", "i", ["a", "b"], block=block).filter("g = 'same'")
        assert {(r["cluster"], r["cost"]) for r in same.collect()} == {(0, 0.0)}
        assert grouped_kmeans(d.limit(0), "g", "i", ["a", "b"], block=block).count() == 0


def test_tiers_do_not_depend_on_the_block(spark):
    rows, d = made(spark, {"p": 300, "q": 90, "r": 2})
    d = d.withColumn("w", F.when(F.col("a") > 0, 5).otherwise(1))
    got = [{r["i"]: r["price_tag"] for r in price_tiers(d, "g", "i", ["a", "b"], "a", "w", starts=4, block=b).collect()} for b in (50, 4096)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert set(got[0].values()) == {"Mass_Product", "Aspiring_Product", "Premium_Product"}
