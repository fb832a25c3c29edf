import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kestrel.llm import mixing
from tests.llm.helpers import SCHEMA, words


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(0, None, "a"), (1, "", "a"), (2, " \t", None), (3, words(rng, 4000), "tiny"), (4, "w", "only")]
    for i in range(5, n):
        s = rng.choice(["big"] * 8 + ["a", "b", "é", "Z", None])
        rows.append((i, words(rng, rng.randint(1, 60)), s))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)


def waterfill(sizes: dict, params) -> dict:
    """Targets by repeated resharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: params.weights[i % len(params.weights)] for i, s in enumerate(names)}
    cap = {s: params.repeats * sizes[s] for s in names}
    full, left = set(), min(params.budget * sum(sizes.values()), sum(cap.values()))
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(cap[s] for s in full)
        target = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > cap[s] + 1e-9}
        if not over:
            return {s: cap[s] if s in full else target[s] for s in names}
        full |= over


@pytest.mark.parametrize("params", [mixing.MixParams(), mixing.MixParams(weights=(1,)), mixing.MixParams(budget=0.4),
                                    mixing.MixParams(budget=5.0), mixing.MixParams(broadcast_sources=0)])
def test_targets_and_shares(spark, params):
    rows = [r for r in corpus() if r[0] != 3]            # without the document as long as many others
    got = mixing.mix(frame(spark, rows).withColumn("size", F.lit("x")).withColumn("target", F.lit(0)), params=params) \
        .join(frame(spark, rows).select("doc_id", "source"), "doc_id").collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = {}
    for i, _, s in rows:
        by[s] = by.get(s, 0) + size[i]
    want = waterfill(by, params)
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= params.repeats * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sum(r["taken"] for r in got) <= sum(want.values()) + 1e-6
    for s in by:
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - want[s]) <= 120


def test_a_long_document_moves_no_source_by_more_than_its_size(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows)).join(frame(spark, rows).select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in got:
        t = by.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(t - goal) <= 4000 for t, goal in by.values())


def test_equals_its_sql_and_itself(spark, tmp_path):
    rows = corpus(seed=4)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, mixing.mix(d).collect()))
    assert got == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(mixing.oracle_sql()).fetchall())


def test_empty_repeated_and_applied(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c d e", None), (3, None, "s")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 4 and all(r["taken"] <= 2 * r["size"] for r in got)
    out = mixing.apply_mix(frame(spark, corpus()).withColumn("round", F.lit("clash")))
    assert out.columns == [*SCHEMA_COLUMNS, "round", "round_1"]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(frame(spark, corpus())).collect() if r["taken"]}
    served = {}
    for r in out.collect():
        served[r["doc_id"]] = served.get(r["doc_id"], 0) + 1
    assert served == taken


SCHEMA_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
