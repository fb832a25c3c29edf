"""Rounding to significant digits is the same in Spark and in DuckDB, decimal ties included."""

import math
import random

import duckdb
import pytest

from kestrel.plans.sqlfit import significant, significant_sql


@pytest.mark.parametrize("digits", [4, 9])
def test_ties_round_alike(spark, digits):
    rng = random.Random(1)
    xs = [float(f"{rng.randint(10 ** (digits - 1), 10 ** digits - 1)}5e{rng.randint(-14, 6)}") for _ in range(4000)]
    xs += [0.0, -0.0, 1.0, -1.5, 999.99999999, 0.1 + 0.2, 1e-30, 1e30, 1e25, math.inf, -math.inf, math.nan, 123456789.5, -2.5e-7]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(2000)] + [-x for x in xs[:500]]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(-1, None)], "i int, x double")
    got = {r[0]: r[1] for r in d.select("i", significant(d.x, digits)).collect()}
    con = duckdb.connect()
    con.register("d", d.toArrow())
    want = dict(con.execute(f"select i, {significant_sql('x', digits)} from d").fetchall())
    assert got.keys() == want.keys() and got[-1] is None and want[-1] is None
    for i, x in enumerate(xs):
        assert got[i] == want[i] or (math.isnan(got[i]) and math.isnan(want[i])), x
        if 1e-20 < abs(x) < 1e20:
            assert got[i] == pytest.approx(x, rel=0.51 * 10 ** (1 - digits))


def test_known_values(spark):
    d = spark.createDataFrame([(1018.372225, 1018.37223), (1234567.0, 1234567.0), (0.00012344999, 0.00012344999),
                               (-2.5, -2.5), (99999999.95, 100000000.0)], "x double, want double")
    for r in d.select("want", significant(d.x, 9).alias("got")).collect():
        assert r["got"] == r["want"]
