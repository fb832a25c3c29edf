"""Sparse encoding of factors.

The levels of all factors are counted by one map-side combined aggregate; the
most frequent ones of each factor get a slot of their own, all others share
the factor's last slot ("other").  The index of slots is bounded by its
parameter, whatever the number of levels, so it may be broadcast and its slots
may become columns; rows never shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir

#: Levels of a factor that get a slot of their own.
SLOTS = 100


def level_index(df: DataFrame, cols: list[str], slots: int = SLOTS) -> DataFrame:
    """factor, level (as text), n, slot (from 0): the `slots` most frequent
    levels of every column, ties to the smaller text.  Null is no level.  Each
    task keeps no more than `slots` levels a factor before the final ranking."""
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in cols])
    n = df.select(F.explode(pairs).alias("e")).select("e.factor", "e.level").filter(F.col("level").isNotNull()) \
        .groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("factor").orderBy(F.desc("n"), "level")
    return n.withColumn("slot", F.row_number().over(w)).filter(F.col("slot") <= slots) \
        .withColumn("slot", F.col("slot") - 1)


def frequent_levels(df: DataFrame, col: str, slots: int = SLOTS) -> tuple[list, bool]:
    """The at most `slots` most frequent levels in their own type, sorted, and
    whether there are others."""
    n = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    rows = n.orderBy(F.desc("n"), col).limit(slots + 1).collect()          # bounded by `slots`
    return sorted(r[col] for r in rows[:slots]), len(rows) > slots


def sparse_encode(df: DataFrame, cols: list[str], slots: int = SLOTS, index: DataFrame | None = None,
                  out: str = "encoded") -> DataFrame:
    """Every row and column of `df`, plus `out`: struct<size int, indices
    array<int>, values array<double>>, the row's one-hot vector over the slots
    of all factors in the order of `cols`.

    A factor with m indexed levels takes m + 1 positions, the last one for
    every level without a slot of its own.  A null sets no position.  `index`
    (of `level_index`, e.g. of a training table) may be given; levels it lacks
    are "other"."""
    ensure_checkpoint_dir(df.sparkSession)
    index = (level_index(df, cols, slots) if index is None else index).checkpoint(eager=True)
    held = {r["factor"]: r["m"] for r in index.groupBy("factor").agg(F.count(F.lit(1)).alias("m")).collect()}
    res, at, marks = df, 0, []
    for i, c in enumerate(cols):
        m = held.get(c, 0)
        one = index.filter(F.col("factor") == c).select(F.col("level").alias(f"__l{i}"), F.col("slot").alias(f"__s{i}"))
        res = res.join(F.broadcast(one), F.col(c).cast("string") == F.col(f"__l{i}"), "left")     # `slots` rows at most
        marks.append(F.when(F.col(c).isNotNull(), F.lit(at) + F.coalesce(F.col(f"__s{i}"), F.lit(m))))
        at += m + 1
    indices = F.array_compact(F.array(*marks)).cast("array<int>")
    return res.withColumn(out, F.struct(F.lit(at).alias("size"), indices.alias("indices"),
                                        F.array_repeat(F.lit(1.0), F.size(indices)).alias("values"))) \
        .drop(*[f"__{x}{i}" for i in range(len(cols)) for x in "ls"])
