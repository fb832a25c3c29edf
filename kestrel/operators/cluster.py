"""k-means of many groups at once.

Lloyd's passes of all groups and all their starts run together as Spark jobs:
items are packed in blocks of bounded size, a pass joins the blocks with a
small table of centres (one row a group: those of all starts), every task adds
up the sums of its blocks, and one row a group and task meet in the update.
A group of any size so spreads over all tasks.  Groups that fit one block need
no passes: the same algorithm runs on them whole, all such groups in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir

#: Groups whose sums a task holds before it hands them on.
_HELD = 512
#: Copies of a group's centres, so that blocks of one group meet them in many tasks.
_SALTS = 16


def kmeans_numpy(x: np.ndarray, k: int, starts: int = 50, seed: int = 1, max_iter: int = 100,
                 first: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Labels and cost of the best of `starts` k-means runs (distinct rows as first centres, or those of `first`)."""
    if first is None:
        rng = np.random.default_rng(seed)
        distinct = np.unique(x, axis=0)
        k = min(k, len(distinct))
        first = np.array([distinct[rng.choice(len(distinct), k, replace=False)] for _ in range(starts)])
    best, best_cost = np.zeros(len(x), int), math.inf
    for centre in first:
        for _ in range(max_iter):
            lab = ((x[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[lab == j].mean(0) if (lab == j).any() else centre[j] for j in range(len(centre))])
            if np.allclose(new, centre):
                break
            centre = new
        cost = float(((x - centre[lab]) ** 2).sum())
        if cost < best_cost - 1e-12:
            best, best_cost = lab, cost
    return best, best_cost


def _draw(points: np.ndarray, k: int, starts: int, seed: int) -> np.ndarray:
    """First centres (starts, k, dim) from a group's pool of distinct points."""
    if len(points) >= starts * k:
        return points[:starts * k].reshape(starts, k, -1)
    rng = np.random.default_rng(seed)
    return np.array([points[rng.choice(len(points), min(k, len(points)), replace=False)] for _ in range(starts)])


def grouped_kmeans(df: DataFrame, group: str, item: str, cols: list[str], k: int = 3, starts: int = 50, seed: int = 1,
                   max_iter: int = 100, block: int = 4096) -> DataFrame:
    """k-means of every group's items on `cols`, scaled within the group (n - 1
    denominator; a constant column counts nothing), best of `starts` runs.  The
    first centres are drawn from the starts x k distinct points of the group
    with the smallest hashes, so the result does not depend on `block`.

    Output: group, item, cluster (int, from 0), cost (double: the squared
    distances of the group's best run, in scaled units).  Items with a null or
    non-finite value in `cols` take no part: cluster and cost are null.  Null
    groups are one group; a group with fewer than k distinct items has as many
    clusters as those.  Rows of one item repeated are points of their own.
    """
    ensure_checkpoint_dir(df.sparkSession)
    v = F.array(*[F.col(c).cast("double") for c in cols])
    fine = F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < F.lit(math.inf)) & ~F.isnan(e))
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    stats = rows.filter("v is not null").groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("v")[j]).alias(f"m{j}") for j in range(len(cols))],
        *[F.stddev_samp(F.col("v")[j]).alias(f"s{j}") for j in range(len(cols))]).withColumnRenamed("g", "sg")
    joined = rows.join(stats, F.col("g").eqNullSafe(F.col("sg")), "left").drop("sg")
    scaled = [(F.col("v")[j] - F.col(f"m{j}")) / F.when(F.col(f"s{j}") > 0, F.col(f"s{j}")).otherwise(1.0)
              for j in range(len(cols))]
    # the hash is of the values as given: the scaled ones may differ in their last digit from run to run
    z = joined.select("g", "i", "n", F.xxhash64(F.lit(seed), "v").alias("h"),
                      F.when(F.col("v").isNotNull(), F.array(*scaled)).alias("x")).checkpoint(eager=True)
    without = z.filter("x is null").select("g", "i", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("cost"))
    small = _whole_groups(z.filter((F.col("n") <= block) & F.col("x").isNotNull()), k, starts, seed, max_iter)
    out = without.unionByName(small)
    big = z.filter((F.col("n") > block) & F.col("x").isNotNull())
    if not big.isEmpty():
        out = out.unionByName(_in_passes(big, len(cols), k, starts, seed, max_iter, block))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "cluster", "cost")


def _whole_groups(z: DataFrame, k: int, starts: int, seed: int, max_iter: int) -> DataFrame:
    """Groups of at most one block, each clustered in one go."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", kind="stable")
        x = np.array(pdf["x"].tolist())
        _, at = np.unique(pdf["h"].to_numpy(), return_index=True)
        lab, cost = kmeans_numpy(x, k, max_iter=max_iter, first=_draw(x[at[:starts * k]], k, starts, seed))
        return pd.DataFrame({"g": pdf["g"], "i": pdf["i"], "cluster": lab.astype("int32"), "cost": cost})
    types = {f.name: f.dataType.simpleString() for f in z.schema}
    return z.select("g", "i", "h", "x").groupBy("g").applyInPandas(fit, f"g {types['g']}, i {types['i']}, cluster int, cost double")


def _first_centres(z: DataFrame, k: int, starts: int, seed: int) -> DataFrame:
    """g, c: the first centres of all starts, flat."""
    w = Window.partitionBy("g").orderBy("h")
    pool = z.groupBy("g", "h").agg(F.min("x").alias("x")).withColumn("r", F.row_number().over(w)) \
        .filter(F.col("r") <= starts * k).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("r", "x")))["x"].alias("p"))

    @F.pandas_udf("array<double>")
    def draw(p: pd.Series) -> pd.Series:
        return pd.Series([_draw(np.array(points.tolist()), k, starts, seed).ravel() for points in p])
    return pool.select("g", draw("p").alias("c"))


def _in_passes(z: DataFrame, dim: int, k: int, starts: int, seed: int, max_iter: int, block: int) -> DataFrame:
    """Groups of more than one block, by passes over their blocks."""
    where = F.pmod(F.xxhash64("i", "x", F.monotonically_increasing_id()), F.ceil(F.col("n") / block))
    blocks = z.withColumn("b", where).groupBy("g", "b").agg(F.flatten(F.collect_list("x")).alias("x")) \
        .select("g", F.pmod("b", F.lit(_SALTS)).cast("int").alias("salt"), "x").checkpoint(eager=True)
    gtype = z.schema["g"].dataType.simpleString()
    sums_type = f"g {gtype}, s array<double>"
    state_type = f"g {gtype}, c array<double>, cost array<double>, done boolean"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per group: for every start and centre the coordinates' sums and the count, then the costs of the starts."""
        held: dict = {}

        def flush():
            out = pd.DataFrame({"g": pd.Series(list(held), dtype=object), "s": list(held.values())})
            held.clear()
            return out
        for pdf in batches:
            for g, flat, c in zip(pdf["g"], pdf["x"], pdf["c"]):
                x = np.asarray(flat, float).reshape(-1, dim)
                centre = np.asarray(c, float).reshape(starts, -1, dim)
                got = _block_sums(x, centre)
                g = None if g is pd.NA or g != g else g
                held[g] = held[g] + got if g in held else got
                if len(held) >= _HELD:
                    yield flush()
        if held:
            yield flush()

    def update(pdf: pd.DataFrame) -> pd.DataFrame:
        """New centres of a group; a centre without items stays.  One row a task, and the old centres."""
        centre = np.asarray(pdf["c"].iloc[0], float).reshape(starts, -1, dim)
        m = centre.shape[1]
        total = np.sum([np.asarray(s, float) for s in pdf["s"]], axis=0)
        part, cost = total[:-starts].reshape(starts, m, dim + 1), total[-starts:]
        n = part[:, :, dim:]
        new = np.where(n > 0, part[:, :, :dim] / np.maximum(n, 1), centre)
        still = np.isclose(new, centre).all(axis=(1, 2))
        new[still] = centre[still]                  # a run that has come to rest keeps its centres
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "c": [new.ravel()], "cost": [cost], "done": [bool(still.all())]})

    salts = F.explode(F.array(*[F.lit(i) for i in range(_SALTS)])).alias("salt")
    state = _first_centres(z, k, starts, seed).checkpoint(eager=True)
    done = None
    for step in range(max_iter + 1):
        spread = state.select(F.col("g").alias("cg"), "c", salts)
        met = blocks.join(spread, F.col("g").eqNullSafe(F.col("cg")) & (blocks["salt"] == spread["salt"])).select("g", "x", "c")
        got = met.mapInPandas(sums, sums_type)
        old = state.select(F.col("g").alias("cg"), "c")
        state = got.join(old, F.col("g").eqNullSafe(F.col("cg"))).select("g", "s", "c").groupBy("g") \
            .applyInPandas(update, state_type).checkpoint(eager=True)
        rest = state.filter("done") if step < max_iter else state
        done = rest if done is None else done.unionByName(rest)
        state = state.filter(~F.col("done"))
        if step == max_iter or state.isEmpty():
            break
    cost = F.array_min("cost")
    run = F.size("c") / F.lit(starts)
    best = done.select(F.col("g").alias("cg"), cost.alias("cost"),
                       F.slice("c", ((F.array_position("cost", cost) - 1) * run + 1).cast("int"), run.cast("int")).alias("c"))
    centres = F.transform(F.sequence(F.lit(0), (F.size("c") / dim - 1).cast("int")),
                          lambda j: F.slice("c", j * dim + 1, dim))
    best = best.select("cg", "cost", centres.alias("c")).checkpoint(eager=True)
    away = F.transform("c", lambda m: F.aggregate(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                                  lambda s, e: s + e))
    return z.join(best, F.col("g").eqNullSafe(F.col("cg"))).withColumn("a", away) \
        .select("g", "i", (F.array_position("a", F.array_min("a")) - 1).cast("int").alias("cluster"), "cost")


def _block_sums(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Sums and counts of a block's items by nearest centre, for all starts; the starts' costs at the end."""
    starts, m, dim = centre.shape
    part, cost = np.zeros((starts, m, dim + 1)), np.zeros(starts)
    for s in range(starts):
        away = ((x[:, None, :] - centre[s][None]) ** 2).sum(2)
        lab = away.argmin(1)
        part[s, :, dim] = np.bincount(lab, minlength=m)
        for j in range(dim):
            part[s, :, j] = np.bincount(lab, weights=x[:, j], minlength=m)
        cost[s] = away[np.arange(len(x)), lab].sum()
    return np.concatenate([part.ravel(), cost])


def price_tiers(df: DataFrame, group: str, item: str, cols: list[str], price: str, weight: str, starts: int = 50,
                block: int = 4096) -> DataFrame:
    """Per group, k-means (k = 3) of the items on scaled columns; the
    cluster with the most `weight` is mass, the one with the least premium,
    the third aspiring.  Two or fewer items: the higher-priced one is aspiring,
    the other mass.  One row per item in `df`.  Items with a null among `cols`
    in a larger group have null cluster and tag.  Output: group, item, cluster, price_tag."""
    ensure_checkpoint_dir(df.sparkSession)
    xs = [f"x{j}" for j in range(len(cols))]
    src = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(price).alias("price"), F.col(weight).alias("w"),
                    *[F.col(c).alias(x) for c, x in zip(cols, xs)]).checkpoint(eager=True)
    n = src.groupBy(F.col("g").alias("ng")).agg(F.count(F.lit(1)).alias("n"))
    src = src.join(n, F.col("g").eqNullSafe(F.col("ng"))).drop("ng")
    last = F.row_number().over(Window.partitionBy("g").orderBy("price", "i")) == F.col("n")
    pair = src.filter("n <= 2").select("g", "i", last.cast("int").alias("cluster"), last.alias("top")) \
        .select("g", "i", "cluster", F.when(F.col("top"), "Aspiring_Product").otherwise("Mass_Product").alias("price_tag"))
    many = src.filter("n > 2").select("g", "i", "w", *xs)
    fitted = grouped_kmeans(many, "g", "i", xs, 3, starts, block=block).select(F.col("g").alias("kg"), F.col("i").alias("ki"), "cluster")
    got = many.join(fitted, F.col("g").eqNullSafe(F.col("kg")) & F.col("i").eqNullSafe(F.col("ki"))) \
        .select("g", "i", "w", "cluster").checkpoint(eager=True)
    per = Window.partitionBy("g")
    size = got.filter("cluster is not null").groupBy("g", "cluster").agg(F.sum("w").alias("w")) \
        .withColumn("r", F.row_number().over(per.orderBy(F.desc("w"), "cluster"))) \
        .withColumn("k", F.count(F.lit(1)).over(per))                                   # three rows a group
    tag = F.when(F.col("r") == 1, "Mass_Product").when(F.col("r") == F.col("k"), "Premium_Product") \
        .otherwise("Aspiring_Product")
    size = size.select(F.col("g").alias("tg"), F.col("cluster").alias("tc"), tag.alias("price_tag"))
    named = got.join(size, F.col("g").eqNullSafe(F.col("tg")) & (F.col("cluster") == F.col("tc")), "left")
    out = pair.unionByName(named.select("g", "i", "cluster", "price_tag"))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "cluster", "price_tag")
