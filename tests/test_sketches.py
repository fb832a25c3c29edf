"""Merged sketches against exact ranks and counts; sparse encoding against one-hot by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators.encode import frequent_levels, level_index, sparse_encode
from kestrel.operators.sketches import merge_sketches, sketch, sketch_distinct, sketch_percentiles, sketch_rank
from kestrel.operators.stats import dummy_encode


@pytest.fixture(scope="module")
def days(spark):
    """200,000 rows over 40 days, a third of them on one day, with heavy ties and nulls."""
    d = spark.range(200_000).withColumn("u", F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003)
    d = d.withColumn("day", F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") % 40).cast("int"))) \
        .withColumn("x", F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("u") < 0.2, F.lit(0.5))
                    .otherwise(F.exp(F.col("u") * 5))) \
        .withColumn("c", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30_000)))
    return d.withColumn("x", F.when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("x")))


def test_merged_sketches_are_near_exact(spark, days):
    week = F.floor(F.col("day") / 8).cast("int")
    daily = sketch(days, ["day"], ["x"], ["c"]).checkpoint(eager=True)
    assert daily.count() == 40
    merged = merge_sketches(daily.withColumn("week", week), ["week"])
    pdf = days.withColumn("week", week).select("week", "x", "c").toPandas()
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    for r in sketch_percentiles(merged, ["week"], "x", probs).collect():
        x = pdf[(pdf.week == r["week"]) & pdf.x.notna()].x.to_numpy()
        assert r["n"] == len(x)
        assert np.mean(x < r["value"]) - 0.01 <= r["p"] <= np.mean(x <= r["value"]) + 0.01
    for r in sketch_distinct(merged, ["week"], ["c"]).collect():
        exact = pdf[pdf.week == r["week"]].c.nunique()
        assert abs(r["n_distinct"] - exact) <= 0.05 * exact
    got = {r[0]: r[1] for r in merged.select("week", sketch_rank("x", F.lit(0.5))).collect()}
    for w, rank in got.items():
        x = pdf[(pdf.week == w) & pdf.x.notna()].x.to_numpy()
        assert rank == pytest.approx(np.mean(x <= 0.5), abs=0.01)


def test_all_rows_of_a_key_null_and_empty_tables(spark):
    d = spark.createDataFrame([("a", None, None), ("a", float("nan"), None), ("b", 2.0, "v"), (None, 3.0, "w")],
                              "k string, x double, s string")
    m = merge_sketches(sketch(d, ["k"], ["x"], ["s"]), ["k"])
    got = {r["k"]: (r["n"], r["value"]) for r in sketch_percentiles(m, ["k"], "x", [0.5]).collect()}
    assert got == {"a": (0, None), "b": (1, 2.0), None: (1, 3.0)}
    assert {r["k"]: r["n_distinct"] for r in sketch_distinct(m, ["k"], ["s"]).collect()} == {"a": 0, "b": 1, None: 1}
    assert {r["k"]: r["n_rows"] for r in m.collect()} == {"a": 2, "b": 1, None: 1}
    none = merge_sketches(sketch(d.limit(0), ["k"], ["x"], ["s"]), ["k"])
    assert sketch_percentiles(none, ["k"], "x", [0.5]).count() == 0


def test_sparse_encode_by_hand(spark):
    d = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "a", None), (4, None, 6), (5, "c", 7), (6, "a", 6), (6, "a", 6)],
                              "id int, f string, g int").withColumn("slot", F.lit("clash"))
    idx = {(r["factor"], r["level"]): (r["n"], r["slot"]) for r in level_index(d, ["f", "g"], 2).collect()}
    assert idx == {("f", "a"): (4, 0), ("f", "b"): (1, 1), ("g", "6"): (3, 0), ("g", "5"): (2, 1)}
    out = sparse_encode(d, ["f", "g"], 2)
    assert out.columns == [*d.columns, "encoded"]
    got = sorted((r["id"], r["encoded"]["size"], r["encoded"]["indices"], r["encoded"]["values"]) for r in out.collect())
    assert got == [(1, 6, [0, 4], [1.0, 1.0]), (2, 6, [1, 4], [1.0, 1.0]), (3, 6, [0], [1.0]), (4, 6, [3], [1.0]),
                   (5, 6, [2, 5], [1.0, 1.0]), (6, 6, [0, 3], [1.0, 1.0]), (6, 6, [0, 3], [1.0, 1.0])]


def test_sparse_encode_with_an_index_of_other_rows(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "f string")
    new = spark.createDataFrame([("b",), ("z",), (None,)], "f string")
    got = [r["encoded"]["indices"] for r in sparse_encode(new, ["f"], index=level_index(train, ["f"])).collect()]
    assert sorted(got) == [[], [1], [2]]
    assert sparse_encode(new.limit(0), ["f"]).count() == 0


def test_dummies_beyond_the_slots_share_a_column(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",), (None,)], "f string")
    assert frequent_levels(d, "f", 2) == (["a", "b"], True)
    assert dummy_encode(d, "f").columns == ["f", "f_b", "f_c"]
    got = dummy_encode(d, "f", slots=2)
    assert got.columns == ["f", "f_b", "f_other"]
    assert sorted(map(str, (tuple(r) for r in got.distinct().collect()))) == sorted(map(str, [
        ("a", 0, 0), ("b", 1, 0), ("c", 0, 1), (None, None, None)]))
