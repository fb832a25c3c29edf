"""RBF-kernel support vector machines on landmarks, a whole grid at once.

A bounded set of training rows, the landmarks, stands for the kernel's space
(Nystroem): with K the landmarks' kernel matrix and K = L L', a row x becomes
phi(x) = L^-1 k(x), and phi(x)'phi(y) approximates exp(-sigma |x - y|^2).  The squared
distances to the landmarks are computed once and serve every sigma.

One-vs-rest machines minimise |w|^2 / 2 + C sum max(0, 1 - y f(x))^2, the
weight of the hinge being C.  For given active rows (those with a positive
hinge) the minimum is a linear system in their cross-products, so a finite Newton
step needs one pass: every task adds up the products of the active rows of all machines
(sigma, fold, class, C), the sums meet per machine and are solved there.  A grid of
any size takes as many passes as its slowest machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Machine:
    """One two-class machine of the grid; fold -1 learns from all rows."""
    sigma: float
    fold: int
    label: int
    c: float


def squared_distances(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (marks * marks).sum(1) - 2 * x @ marks.T, 0)


def feature_map(marks: np.ndarray, sigma: float, jitter: float = 1e-8) -> np.ndarray:
    """L^-T for the landmarks' kernel matrix: phi = k L^-T for a row k of kernel values."""
    k = np.exp(-sigma * squared_distances(marks, marks))
    return np.linalg.inv(np.linalg.cholesky(k + jitter * len(marks) * np.eye(len(marks)))).T


def features(d2: np.ndarray, sigma: float, root: np.ndarray) -> np.ndarray:
    """phi of rows from their squared distances to the landmarks, and a constant."""
    return np.concatenate([np.exp(-sigma * d2) @ root, np.ones((len(d2), 1))], 1)


def landmarks(train: DataFrame, vector: str, key: str, count: int, seed: int = 3) -> np.ndarray:
    """`count` distinct rows by a hash of the key (a bounded sample, the only rows that reach the driver)."""
    rows = train.select(F.col(vector).cast("array<double>").alias("x"), F.xxhash64(F.lit(seed), key).alias("h")) \
        .orderBy("h").limit(count).collect()
    return np.unique(np.array([r["x"] for r in rows], float), axis=0)


def landmark_distances(df: DataFrame, vector: str, label: str, marks: np.ndarray, fold: str | None = None) -> DataFrame:
    """label, fold, d2 of every row whose vector has the landmarks' length and finite elements."""
    dim = marks.shape[1]

    @F.pandas_udf("array<float>")
    def distances(v: pd.Series) -> pd.Series:
        return pd.Series(list(squared_distances(np.stack(v.to_numpy()).astype(float), marks).astype(np.float32))) if len(v) \
            else pd.Series([], dtype=object)
    x = F.col(vector).cast("array<double>")
    ok = F.col(label).isNotNull() & (F.size(x) == dim) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return df.filter(ok).select(F.col(label).cast("int").alias("label"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                                distances(x).alias("d2"))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(float)


def _groups(machines: list[Machine]) -> dict[tuple[float, int], list[int]]:
    out: dict[tuple[float, int], list[int]] = {}
    for i, m in enumerate(machines):
        out.setdefault((m.sigma, m.fold), []).append(i)
    return out


def _products(machines: list[Machine], w: np.ndarray, roots: dict[float, np.ndarray], todo: list[int]):
    """Per task and machine: loss at w, and over its active rows the sums of phi y and phi phi'."""
    dim = w.shape[1]
    groups = {k: [i for i in v if i in set(todo)] for k, v in _groups(machines).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, right, gram = np.zeros(len(machines)), np.zeros((len(machines), dim)), np.zeros((len(machines), dim, dim))
        any_row = False
        for batch in batches:
            label, fold, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            any_row = any_row or len(label) > 0
            phi, at = None, None
            for (sigma, f), members in groups.items():
                if at != sigma:
                    phi, at = features(d2, sigma, roots[sigma]), sigma
                use = fold != f
                x, lab = phi[use], label[use]
                score = x @ w[members].T
                for col, i in enumerate(members):
                    y = np.where(lab == machines[i].label, 1.0, -1.0)
                    gap = 1 - y * score[:, col]
                    on = gap > 0
                    loss[i] += (gap[on] ** 2).sum()
                    right[i] += x[on].T @ y[on]
                    gram[i] += x[on].T @ x[on]
        if any_row:
            pack = [np.concatenate(([loss[i]], right[i], gram[i][np.triu_indices(dim)])).tobytes() for i in todo]
            yield pa.RecordBatch.from_arrays([pa.array(todo, pa.int32()), pa.array(pack, pa.binary())], names=["m", "sums"])
    return run


def _solve(machines: list[Machine], dim: int):
    """One machine's sums of all tasks -> loss, and the minimum for its active rows."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = int(g["m"].iloc[0])
        s = np.sum([np.frombuffer(b) for b in g["sums"]], axis=0)
        gram = np.zeros((dim, dim))
        gram[np.triu_indices(dim)] = s[1 + dim:]
        gram = gram + np.triu(gram, 1).T
        ridge = np.full(dim, 1 / (2 * machines[m].c))
        ridge[-1] = 1e-9                                  # the constant is free
        return pd.DataFrame({"m": [m], "loss": [s[0]], "w": [np.linalg.solve(gram + np.diag(ridge), s[1:1 + dim])]})
    return run


def train_machines(rows: DataFrame, marks: np.ndarray, machines: list[Machine], rounds: int = 40, tol: float = 1e-7) -> tuple[np.ndarray, int]:
    """Weights of every machine (last column: the constant) and the passes made.

    Finite Newton steps; a step that raises a machine's objective is halved.  Only weights
    and losses reach the driver: machines x (landmarks + 2) numbers a pass."""
    dim = len(marks) + 1
    roots = {s: feature_map(marks, s) for s in {m.sigma for m in machines}}
    best_w, best_f = np.zeros((len(machines), dim)), np.full(len(machines), np.inf)
    trial, target = best_w.copy(), best_w.copy()
    todo, done = list(range(len(machines))), 0
    while todo and done < rounds:
        done += 1
        out = rows.mapInArrow(_products(machines, trial, roots, todo), "m int, sums binary") \
            .groupBy("m").applyInPandas(_solve(machines, dim), "m int, loss double, w array<double>").collect()
        still = []
        for r in out:
            i = r["m"]
            f = 0.5 * float(trial[i, :-1] @ trial[i, :-1]) + machines[i].c * r["loss"]
            if f <= best_f[i]:
                small = np.isfinite(best_f[i]) and best_f[i] - f <= tol * max(1.0, f)
                best_w[i], best_f[i], target[i] = trial[i], f, r["w"]
                if small:
                    continue
                trial[i] = target[i]
            else:
                trial[i] = (best_w[i] + trial[i]) / 2
                if np.abs(trial[i] - best_w[i]).max() <= 1e-10:
                    continue
            still.append(i)
        todo = sorted(still)
    return best_w, done


def classify(d2: np.ndarray, machines: list[Machine], w: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Label of the largest score among machines of one (sigma, fold, C)."""
    x = features(d2, machines[0].sigma, root)
    return np.array([m.label for m in machines])[(x @ w.T).argmax(1)]


def grid_accuracy(rows: DataFrame, marks: np.ndarray, machines: list[Machine], w: np.ndarray) -> DataFrame:
    """sigma, c, fold, n, right: of every fold the rows that the machines learnt on the others classify correctly."""
    roots = {s: feature_map(marks, s) for s in {m.sigma for m in machines}}
    by: dict[tuple, list[int]] = {}
    for i, m in enumerate(machines):
        by.setdefault((m.sigma, m.c, m.fold), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {k: [0, 0] for k in by}
        for batch in batches:
            label, fold, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for (sigma, c, f), members in by.items():
                mine = np.ones(len(fold), bool) if f == -1 else fold == f
                if mine.any():
                    got = classify(d2[mine], [machines[i] for i in members], w[members], roots[sigma])
                    n[sigma, c, f][0] += int(mine.sum())
                    n[sigma, c, f][1] += int((got == label[mine]).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in n], pa.float64()), pa.array([k[1] for k in n], pa.float64()), pa.array([k[2] for k in n], pa.int32()),
             pa.array([v[0] for v in n.values()], pa.int64()), pa.array([v[1] for v in n.values()], pa.int64())],
            names=["sigma", "c", "fold", "n", "right"])
    each = rows.mapInArrow(run, "sigma double, c double, fold int, n long, right long")
    return each.groupBy("sigma", "c", "fold").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))


def rbf_grid(train: DataFrame, vector: str, label: str, key: str, sigmas: list[float], cs: list[float], folds: int = 3,
             count: int = 96, seed: int = 3) -> tuple[DataFrame, dict]:
    """K-fold accuracy of every (sigma, C), and what `rbf_model` needs to go on.

    Folds are by a hash of the key.  Output: sigma, c, n, cv_accuracy.  Labels are integers; their number times sigmas, Cs
    and folds bounds what a task adds up, (count + 1)^2 / 2 numbers for each."""
    ensure_checkpoint_dir(train.sparkSession)
    marks = landmarks(train, vector, key, count, seed)
    folded = train.withColumn("__fold", F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(folds)).cast("int"))
    rows = landmark_distances(folded, vector, label, marks, "__fold").checkpoint(eager=True)
    labels = sorted(r[0] for r in rows.select("label").distinct().limit(10_000).collect())
    machines = [Machine(s, f, k, c) for s in sigmas for f in range(folds) for c in cs for k in labels]
    w, passes = train_machines(rows, marks, machines)
    table = grid_accuracy(rows, marks, machines, w).groupBy("sigma", "c") \
        .agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("cv_accuracy"))
    return table, {"marks": marks, "rows": rows, "labels": labels, "passes": passes}


def rbf_model(state: dict, sigma: float, c: float) -> tuple[list[Machine], np.ndarray]:
    """The machines of one (sigma, C) on all training rows."""
    machines = [Machine(sigma, -1, k, c) for k in state["labels"]]
    return machines, train_machines(state["rows"], state["marks"], machines)[0]
