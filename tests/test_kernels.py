"""RBF machines on landmarks against exact kernels and direct minimisation."""

import numpy as np
import pytest

from kestrel.operators import kernels as K
from kestrel.plans.catalog import QUERIES as Q
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"


def rings(n, seed=0):
    """Three classes that no plane separates: rings around the origin."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    a, r = rng.uniform(0, 2 * np.pi, n), 1.0 + 1.5 * y + 0.15 * rng.standard_normal(n)
    return np.column_stack([r * np.cos(a), r * np.sin(a)]), y


def frame(spark, x, y):
    return spark.createDataFrame([(i, list(map(float, v)), int(t)) for i, (v, t) in enumerate(zip(x, y))], SCHEMA).repartition(4)


@pytest.mark.parametrize("sigma", [0.05, 0.5])
def test_landmark_features_approximate_the_kernel(sigma):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    exact = np.exp(-sigma * K.squared_distances(x, x))
    errors = []
    for m in (10, 40, 160):
        phi = K.features(K.squared_distances(x, x[:m]), sigma, K.feature_map(x[:m], sigma))[:, :-1]
        errors.append(np.abs(phi @ phi.T - exact).mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.005
    all_ = K.features(K.squared_distances(x[:50], x[:50]), sigma, K.feature_map(x[:50], sigma, 1e-12))[:, :-1]
    assert np.abs(all_ @ all_.T - exact[:50, :50]).max() < 1e-4


def test_machines_are_at_the_minimum_of_their_objective(spark):
    x, y = rings(240)
    marks = np.unique(x[:20], axis=0)
    rows = K.landmark_distances(frame(spark, x, y), "embedding", "label", marks).checkpoint()
    machines = [K.Machine(s, -1, k, c) for s in (0.2, 1.0) for k in range(3) for c in (0.1, 10.0)]
    w, passes = K.train_machines(rows, marks, machines)
    assert passes <= 25
    rng = np.random.default_rng(3)
    d2 = K.squared_distances(x, marks).astype(np.float32).astype(float)
    for m, v in zip(machines, w):
        phi = K.features(d2, m.sigma, K.feature_map(marks, m.sigma))
        t = np.where(y == m.label, 1.0, -1.0)

        def value(u):
            return 0.5 * u[:-1] @ u[:-1] + m.c * (np.maximum(0, 1 - t * (phi @ u)) ** 2).sum()
        gap = np.maximum(0, 1 - t * (phi @ v))
        slope = np.append(v[:-1], 0) - 2 * m.c * phi.T @ (t * gap)
        assert np.abs(slope).max() < 1e-2 * max(1, np.abs(v).max())
        for scale in (1e-3, 0.1, 1.0):
            for _ in range(50):
                assert value(v + scale * rng.standard_normal(len(v))) >= value(v) - 1e-6 * max(1, value(v))


def test_folds_are_left_out_and_the_grid_is_counted(spark):
    x, y = rings(300, 2)
    d = frame(spark, x, y)
    grid, state = K.rbf_grid(d, "embedding", "label", "vec_id", [0.001, 0.5], [0.1, 5.0], 3, 40)
    got = {(r["sigma"], r["c"]): r for r in grid.collect()}
    assert len(got) == 4 and all(r["n"] == 300 for r in got.values())
    assert got[0.5, 5.0]["cv_accuracy"] > 0.95 > got[0.001, 0.1]["cv_accuracy"]
    # the same by hand: learn on two folds with numpy, test on the third
    data = state["rows"].collect()
    d2, lab, fold = np.array([r["d2"] for r in data], float), np.array([r["label"] for r in data]), np.array([r["fold"] for r in data])
    right = 0
    for f in range(3):
        machines = [K.Machine(0.5, -1, k, 5.0) for k in range(3)]
        part = spark.createDataFrame([(int(a), 0, list(map(float, b))) for a, b, c in zip(lab, d2, fold) if c != f],
                                     "label int, fold int, d2 array<float>")
        w, _ = K.train_machines(part, state["marks"], machines)
        right += (K.classify(d2[fold == f], machines, w, K.feature_map(state["marks"], 0.5)) == lab[fold == f]).sum()
    assert got[0.5, 5.0]["cv_accuracy"] == pytest.approx(right / 300)
    machines, w = K.rbf_model(state, 0.5, 5.0)
    new_x, new_y = rings(200, 9)
    out = K.grid_accuracy(K.landmark_distances(frame(spark, new_x, new_y), "embedding", "label", state["marks"]), state["marks"],
                          machines, w).first()
    assert out["n"] == 200 and out["right"] / out["n"] > 0.95


def test_odd_vectors_take_no_part(spark):
    x, y = rings(40)
    d = frame(spark, x, y).unionByName(spark.createDataFrame(
        [(900, None, 1), (901, [1.0], 1), (902, [float("nan"), 1.0], 1), (903, [1.0, 2.0], None)], SCHEMA))
    assert K.landmark_distances(d, "embedding", "label", x[:5]).count() == 40


def test_queries(spark):
    grid = Q["svm_rbf_grid"](spark, SF_SMALL).collect()
    assert len(grid) == 12 and all(0 <= r["cv_accuracy"] <= 1 for r in grid)
    best = Q["svm_rbf"](spark, SF_SMALL).collect()
    assert len(best) == 1 and best[0]["cv_accuracy"] == max(r["cv_accuracy"] for r in grid)
    assert 0 <= best[0]["accuracy"] <= 1 and best[0]["n_test"] > 0
