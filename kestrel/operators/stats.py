"""Statistics and feature engineering.

Anything that needs a k x k matrix (correlation, VIF, collinearity) is
computed from distributed aggregates of means and centred cross-products; only
the k x k numbers reach the driver, where numpy does the small linear algebra.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.encode import SLOTS, frequent_levels
from kestrel.operators.ordered import global_rank


def zscore_columns(df: DataFrame, cols: list[str], group: list[str] | None = None, suffix: str = "") -> DataFrame:
    """(x - mean) / sd (n-1 denominator) per column, optionally within
    groups.  Global statistics are scalar subqueries; grouped ones a grouped
    aggregate joined back (one row per group), never an all-rows window."""
    if group:
        stats = df.groupBy(*group).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols],
                                       *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
        out = df.join(stats, group)
        for c in cols:
            out = out.withColumn(c + suffix, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}"))
        return out.drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols])
    st = df.agg(F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols],
                         *[F.stddev_samp(c).alias(f"s_{c}") for c in cols])).scalar()
    out = df
    for c in cols:
        out = out.withColumn(c + suffix, (F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"])
    return out


def dummy_encode(df: DataFrame, col: str, levels: list | None = None, drop_first: bool = True,
                 prefix: str | None = None, slots: int = SLOTS) -> DataFrame:
    """One 0/1 column per level (sorted), first level dropped as in
    model.matrix(~x)[, -1].  Levels, if not given, are the `slots` most
    frequent ones; if there are more, the column `<prefix>_other` marks them.
    For very many levels see `sparse_encode`."""
    more = False
    if levels is None:
        levels, more = frequent_levels(df, col, slots)
    use = levels[1:] if drop_first else levels
    p = prefix or col
    out = [(F.col(col) == F.lit(v)).cast("int").alias(f"{p}_{v}") for v in use]
    if more:
        out.append((~F.col(col).isin(levels)).cast("int").alias(f"{p}_other"))
    return df.select("*", *out)


def split_stratified(df: DataFrame, label: str, key: str, ratio: float, seed: int = 100,
                     name: str = "is_train") -> DataFrame:
    """Within each label, the first round(ratio * n_label) rows by the md5
    of seed|key are training rows (md5, so the split can be reproduced outside
    Spark).  Ranks come from the exact distributed ranking, so a label holding
    most rows is not one task."""
    h = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    r = global_rank(h, ["__h", key], [label], "__r")
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    # one row per label; left to AQE's size-checked join choice (label
    # cardinality is not bounded in general)
    return (r.join(n, label)
            .withColumn(name, F.col("__r") <= F.round(F.col("__n") * ratio))
            .drop("__h", "__r", "__n"))


def split_random(df: DataFrame, keys: list[str] | str, ratio: float, seed: int = 9999,
                 name: str = "is_train") -> DataFrame:
    """Stable random split: bucket = first 32 bits of md5(seed|keys...)
    mod 10000, train when bucket < ratio * 10000.  No shuffle; the same row
    lands on the same side on every run, partitioning and engine (md5 is a
    standard function, so the split can be reproduced outside Spark)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10000
    return df.withColumn(name, bucket < int(round(ratio * 10000)))


# ------------------------------------------------------------ moment matrix
def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means (k), centred cross-products (k x k) of complete rows.

    Two passes, means first: products of deviations keep their digits where a
    column's mean is large against its spread (ids, years, epochs)."""
    k = len(cols)
    base = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).dropna()
    first = base.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in range(k)]).first()
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(k)], dtype=float)
    dev = [F.col(f"v{i}") - F.lit(float(mean[i])) for i in range(k)]
    row = base.agg(*[F.sum(dev[i] * dev[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    c = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            c[i, j] = c[j, i] = row[f"p{i}_{j}"] or 0.0
    return int(first["n"]), mean, c


def correlation_from_moments(c: np.ndarray) -> np.ndarray:
    """Correlations from centred cross-products; a constant column correlates with nothing."""
    sd = np.sqrt(np.diag(c))
    sd = np.where(sd > 0, sd, 1.0)
    r = c / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    return r


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long (x, y, r) Pearson matrix via Spark's `corr` aggregate (one
    pass, one aggregate per pair)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r"))
               for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.x", "s.y", "s.r")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation factors = diagonal of the inverse correlation
    matrix (equivalently 1 / (1 - R^2_j) of each predictor on the others)."""
    _, _, c = moments(df, cols)
    r = correlation_from_moments(c)
    inv = np.linalg.pinv(r)
    spark: SparkSession = df.sparkSession
    return spark.createDataFrame([(c, float(inv[i, i])) for i, c in enumerate(cols)], "variable string, vif double")


def collinear_columns(df: DataFrame, cols: list[str], tol: float = 1e-9) -> DataFrame:
    """Columns that are exact linear combinations of earlier ones
    (aliased terms).  Gram-Schmidt on the centred cross-product matrix, in the
    given column order: a column whose residual variance vanishes is aliased."""
    _, _, c = moments(df, cols)
    gone = aliased_columns(c, tol)
    return df.sparkSession.createDataFrame([(x, j in gone) for j, x in enumerate(cols)], "variable string, aliased boolean")


def aliased_columns(c: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns, in order, that earlier ones determine, from centred cross-products."""
    kept: list[int] = []
    gone = []
    for j in range(len(c)):
        resid = c[j, j]
        if kept:
            b = c[np.ix_(kept, [j])]
            resid = c[j, j] - float((b.T @ np.linalg.pinv(c[np.ix_(kept, kept)]) @ b)[0, 0])
        if resid <= tol * max(c[j, j], 1e-300):
            gone.append(j)
        else:
            kept.append(j)
    return gone
