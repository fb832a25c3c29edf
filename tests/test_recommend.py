"""Neighbours of all users or items, and the evaluation of recommenders, against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators.recommend import (
    cosine_neighbours, held_out_ranks, item_scores, topn_table, unit_vectors, user_scores,
)


def brute(left, right, k):
    """{(run, id): [(other, sim), ...]} of dictionaries (run, id) -> {key: value}."""
    out = {}
    for (run, i), a in left.items():
        na, best = np.sqrt(sum(x * x for x in a.values())), []
        for (other_run, j), b in right.items():
            nb = np.sqrt(sum(x * x for x in b.values()))
            if run != other_run or i == j or not na or not nb:
                continue
            sim = np.floor(sum(x / na * (b[key] / nb) for key, x in a.items() if key in b) * 1e9 + 0.5) / 1e9
            if sim > 0:
                best.append((-sim, j))
        if best:
            out[run, i] = [(j, -s) for s, j in sorted(best)[:k]]
    return out


def matrix(rng, ids, keys, skew, runs=2, value=lambda r: float(r.standard_normal())):
    """Vectors whose keys are drawn with frequencies that fall like a power of their number; key 0 is in all."""
    p = 1 / np.arange(1, keys + 1) ** skew
    out = {}
    for run in range(runs):
        for i in range(ids):
            n = int(rng.integers(1, keys // 2))
            chosen = {0, *map(int, rng.choice(keys, n, replace=False, p=p / p.sum()))}
            out[run, i] = {c: value(rng) for c in chosen}
    return out


def frame(spark, m):
    rows = [(run, i, key, float(x)) for (run, i), v in m.items() for key, x in v.items()]
    return spark.createDataFrame(rows, "run int, id long, key long, v double").repartition(5)


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["run"], r["id"]), []).append((r["other"], r["sim"]))
    return {k: sorted(v, key=lambda t: (-t[1], t[0])) for k, v in out.items()}


@pytest.mark.parametrize("skew,seed,k", [(0.0, 16, 5), (1.2, 2, 3), (1.2, 1000, 50), (2.0, 1, 1)])
def test_neighbours_are_those_of_brute_force(spark, skew, seed, k):
    rng = np.random.default_rng(int(10 * skew) + k)
    left, right = matrix(rng, 40, 30, skew), matrix(rng, 50, 30, skew)
    left[0, 3] = {1: 0.0}                                        # a zero vector
    left[1, 4] = dict(right[1, 7])                               # an equal one
    work = []
    v = [unit_vectors(frame(spark, m), ["run"], "id", "key", "v") for m in (left, right)]
    assert got(cosine_neighbours(*v, ["run"], k, seed, work)) == brute(left, right, k)
    n = dict(work)
    assert n["second_round"] <= n["co_occurrences"] and n["first_round"] <= n["co_occurrences"]


def test_a_frequent_key_is_left_out_where_it_cannot_matter(spark):
    """Pairs of copies on rare keys; one key that all vectors share adds a little: it makes no pairs."""
    m = {}
    for i in range(300):
        m[0, i] = {0: 0.05, 1 + i // 2: 1.0, 1000 + i: 0.1}
    work = []
    v = unit_vectors(frame(spark, m), ["run"], "id", "key", "v")
    out = got(cosine_neighbours(v, v, ["run"], 1, 2, work))
    assert out == brute(m, m, 1)
    assert all(o == i ^ 1 for (_, i), ((o, _),) in out.items())
    n = dict(work)
    assert n["co_occurrences"] > 300 * 300 and n["second_round"] < 2000 and n["in_full"] < 1000


@pytest.mark.parametrize("skew,seed,cheap,products,run,size", [(1.2, 2, 0, 2_000_000, 4096, 10**9), (1.2, 2, 3, 300, 4, 2000),
                                                               (0.0, 16, 9, 200, 7, 3000), (2.0, 4, 0, 1, 1, 500)])
def test_neighbours_do_not_depend_on_runs_passes_and_heavy_vectors(spark, skew, seed, cheap, products, run, size):
    rng = np.random.default_rng(int(10 * skew) + cheap)
    left, right = matrix(rng, 30, 30, skew), matrix(rng, 50, 30, skew)
    left[1, 4] = dict(right[1, 7])
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    v = [unit_vectors(frame(spark, m), ["run"], "id", "key", "v") for m in (left, right)]
    assert got(cosine_neighbours(*v, ["run"], 4, seed, None, cheap, products, run, size)) == brute(left, right, 4)
    assert spark.conf.get(name) == before


def files(spark):
    """Folders in the checkpoint folder that hold files."""
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {os.path.relpath(at, top).split(os.sep)[0] for at, _, names in os.walk(top) if names}


@pytest.mark.parametrize("skew,cheap", [(0.0, 9), (1.2, 0)])
def test_only_the_neighbours_stay_on_disk(spark, skew, cheap):
    """Before, every step's checkpoint stayed."""
    m = matrix(np.random.default_rng(3), 30, 30, skew)
    v, before = unit_vectors(frame(spark, m), ["run"], "id", "key", "v"), files(spark)
    out = cosine_neighbours(v, v, ["run"], 4, 2, None, cheap, 200, 7, 300)
    assert {f.split("-")[0] for f in files(spark) - before} == {"nearest"}
    assert got(out) == brute(m, m, 4)


def test_only_the_best_pairs_of_a_vector_go_on(spark):
    """Two hundred vectors on common keys: what failed was written as rows before, 199 pairs of each."""
    rng = np.random.default_rng(5)
    m = {(0, i): {int(c): float(rng.standard_normal()) for c in rng.choice(60, 12, replace=False)} for i in range(200)}
    v, work = unit_vectors(frame(spark, m), ["run"], "id", "key", "v"), []
    assert got(cosine_neighbours(v, v, ["run"], 3, work=work)) == brute(m, m, 3)
    assert dict(work)["in_full"] <= 200 * 3 and dict(work)["first_round"] == 0


def test_ids_may_be_texts(spark):
    rng = np.random.default_rng(9)
    m = matrix(rng, 25, 20, 1.2)
    v = unit_vectors(frame(spark, m).withColumn("id", F.lpad(F.col("id").cast("string"), 3, "0")), ["run"], "id", "key", "v")
    out = {(r, int(i)): [(int(o), s) for o, s in x] for (r, i), x in got(cosine_neighbours(v, v, ["run"], 4)).items()}
    assert out == brute(m, m, 4)


def test_empty(spark):
    e = spark.createDataFrame([], "run int, id long, key long, v double")
    v = unit_vectors(e, ["run"], "id", "key", "v")
    assert cosine_neighbours(v, v, ["run"], 3).count() == 0


def test_ranks_are_counted_as_lists_would_have_them(spark):
    rng = np.random.default_rng(6)
    scores, own, held = [], [], []
    want = {}
    for u in range(30):
        items = list(map(int, rng.choice(40, 25, replace=False)))
        mine, known = items[:8], items[5:20]                     # own ratings; scored items, some of them rated
        hidden = items[19] if u % 3 else items[24]               # the latter has no score
        s = {i: float(rng.integers(0, 6)) for i in known}        # many ties
        scores += [(u, i, x) for i, x in s.items()]
        own += [(u, i) for i in mine]
        held.append((u, hidden, bool(u % 2)))
        order = sorted((i for i in s if i not in mine), key=lambda i: (-s[i], i))
        want[u] = (len(order), order.index(hidden) + 1 if hidden in order else None)
    held.append((99, 1, True))                                   # a user without anything
    want[99] = (0, None)
    ranks = held_out_ranks(spark.createDataFrame(scores, "id int, item int, score double"), spark.createDataFrame(own, "id int, item int"),
                           spark.createDataFrame(held, "id int, item int, good boolean"), [])
    assert {r["id"]: (r["scored"], r["rank"]) for r in ranks.collect()} == want
    good = {u: g for u, _, g in held}
    for r in topn_table(ranks, 40, [1, 3, 10], []).collect():
        tp = sum(good[u] and k is not None and k <= r["n"] for u, (_, k) in want.items())
        fp = sum(min(r["n"], c) for c, _ in want.values()) - tp
        fn = sum(good.values()) - tp
        assert (r["users"], r["tp"], r["fp"], r["fn"]) == (31, tp, fp, fn)
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == 31 * 40 - 30 * 8
        assert r["tpr"] == tp / (tp + fn) and r["fpr"] == fp / (fp + r["tn"])


def test_scores(spark):
    n = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.25)], "id int, other int, sim double")
    z = spark.createDataFrame([(7, 100, 1.0), (8, 100, -2.0), (8, 101, 3.0)], "other int, item int, z double")
    assert {r["item"]: r["score"] for r in user_scores(n, z, []).collect()} == {100: 0.0, 101: 1.0}
    model = spark.createDataFrame([(100, 5, 0.5), (100, 6, 0.25), (101, 9, 0.1)], "id int, other int, sim double")
    own = spark.createDataFrame([(1, 5, 2.0), (1, 6, -1.0), (2, 6, 4.0)], "id int, item int, z double")
    assert {(r["id"], r["item"]): r["score"] for r in item_scores(model, own, []).collect()} == {(1, 100): 1.0, (2, 100): 4.0}
    assert item_scores(model, own.filter(F.lit(False)), []).count() == 0


def test_scores_of_a_long_list_and_of_unknown_ratings(spark):
    """A key with more elements than travel in one row; packed scores rank as plain ones."""
    n = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.25), (2, 8, 0.1)], "id int, other int, sim double")
    z = spark.createDataFrame([(7, i, float(i)) for i in range(6000)] + [(8, 3, None), (8, 6001, None)], "other int, item int, z double")
    plain = user_scores(n, z, [], 3)
    out = {(r["id"], r["item"]): r["score"] for r in plain.collect()}
    assert out == {(1, i): np.floor(0.5 * i / 0.75 * 1e9 + 0.5) / 1e9 for i in range(6000)} | {(1, 6001): None, (2, 3): None, (2, 6001): None}
    own, held = spark.createDataFrame([(1, 5999)], "id int, item int"), spark.createDataFrame([(1, 5990, True), (2, 3, False)], "id int, item int, good boolean")
    for scores in (plain, user_scores(n, z, [], 3, packed=True)):
        ranks = {r["id"]: (r["item"], r["good"], r["given"], r["scored"], r["rank"]) for r in held_out_ranks(scores, own, held, [], 2).collect()}
        assert ranks == {1: (5990, True, 1, 6000, 9), 2: (3, False, 0, 2, None)}


def test_folds_are_evaluated_one_after_the_other(spark):
    """What a fold writes goes before the next one; before, the rows of all folds stood side by side and stayed."""
    from kestrel.plans import beer
    rng = np.random.default_rng(8)
    rows = [(int(i), int(u), float(rng.integers(0, 11)) / 2) for u in range(60) for i in rng.choice(25, 9, replace=False)]
    fr = spark.createDataFrame(rows, "beer_beerid long, user_id long, review_overall double")
    before, seen, real = files(spark), [], beer.cosine_neighbours

    def watched(*a, **b):
        seen.append({f.split("-")[0] for f in files(spark) - before})
        return real(*a, **b)
    scratch = beer.Scratch(spark, "all")
    beer.cosine_neighbours = watched
    try:
        ranks = beer._evaluated(fr, F.col("fold"), [0, 1, 2], scratch)
    finally:
        beer.cosine_neighbours = real
    scratch.drop()
    assert seen[0::2] == [{"all", "run"}] + 2 * [{"all", "run", "passes"}] and len(seen) == 6
    assert {f.split("-")[0] for f in files(spark) - before} == {"passes"}
    tested = {r["user_id"]: r["fold"] for r in beer._scheme(fr).collect()}
    assert {(r["run"], r["id"]) for r in ranks.collect()} == {(f, u) for u, f in tested.items() if f < 3}
