"""Relational operators: dedup, joins, grouped aggregates, top-k, reshaping
(C15-C17, D1-D9, E1-E28, G1-G5, H1-H7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.columns import all_of


# ------------------------------------------------------------------ dedup
def dedup_key(df: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key, keeping all columns; the kept row is the
    smallest by `order_by` then by the remaining columns (deterministic).

    Implemented as a `min(struct(...))` aggregate with a partial (map-side)
    step, so duplicates are collapsed before the shuffle and a hot key costs
    one row per map task (Spark executes it sort-based, as the struct buffer
    is variable-width)."""
    order = list(order_by or [])
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], *[F.col(c) for c in others])
    return (df.groupBy(*keys).agg(F.min(packed).alias("__r"))
            .select(*[F.col(k) for k in keys], *[F.col(f"__r.{c}").alias(c) for c in others])
            .select(*df.columns))


def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier identical row."""
    g = df.groupBy(*df.columns).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                 F.sum("count").cast("long").alias("n_rows"))


def check_unique_key(df: DataFrame, key: str, case_insensitive: bool = False) -> DataFrame:
    """(n_rows, n_distinct, n_duplicated) for a key column."""
    k = F.lower(F.col(key)) if case_insensitive else F.col(key)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(k).alias("n_distinct")).withColumn(
        "n_duplicated", F.col("n_rows") - F.col("n_distinct"))


# ------------------------------------------------------------------- joins
def semi_join_count(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """How many left rows have a partner (`%in%`), and how many do not."""
    matched = left.join(right, on, "left_semi").agg(F.count(F.lit(1)).alias("n_matched"))
    total = left.agg(F.count(F.lit(1)).alias("n_total"))
    return _side_by_side(matched, total)


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row aggregates as one row (scalar subquery, no cartesian join)."""
    return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])


def key_set_difference(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Distinct keys of left missing from right (setdiff)."""
    rk = right_key or key
    return (left.select(key).distinct()
            .join(right.select(F.col(rk).alias(key)).distinct(), key, "left_anti"))


def join_back_aggregate(detail: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Attach group aggregates to every detail row.

    A grouped aggregate joined back on the key: the aggregate side is
    partially combined before its shuffle and is small (one row per group),
    so a hot group does not land in one window task."""
    return detail.join(detail.groupBy(*keys).agg(*aggs), keys, "left")


# ------------------------------------------------------------- aggregates
def group_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Group count (partial aggregation map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_of_counts(df: DataFrame, key: str, name: str = "n_keys") -> DataFrame:
    """Histogram of group sizes."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))
            .groupBy("group_size").agg(F.count(F.lit(1)).alias(name)))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    rank: str = "dense_rank", name: str = "rnk") -> DataFrame:
    """Top-k rows per group with ties (`dense_rank`) or without
    (`row_number`).  Spark inserts a WindowGroupLimit below the shuffle for
    `rank <= k`, so only k candidates per group and map task are moved."""
    fn = {"dense_rank": F.dense_rank, "rank": F.rank, "row_number": F.row_number}[rank]
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, fn().over(w)).filter(F.col(name) <= k)


def pct_of_total(df: DataFrame, count_col: str, name: str = "pct") -> DataFrame:
    """Share of the grand total.  The total is a scalar subquery (one
    extra aggregate job), not an unpartitioned window over every row."""
    total = df.agg(F.sum(count_col)).scalar()
    return df.withColumn(name, F.col(count_col) * 100.0 / total)


def mean_range_filter(df: DataFrame, key: str, value: str, lo: float, hi: float) -> DataFrame:
    """Categories whose mean lies within [lo, hi] (HAVING)."""
    return (df.groupBy(key).agg(F.avg(value).alias("mean_value"))
            .filter(F.col("mean_value").between(lo, hi)))


def summarise_all(df: DataFrame, keys: list[str], fn=F.sum, columns: list[str] | None = None) -> DataFrame:
    """One function over every non-key column."""
    cols = columns or [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[fn(c).alias(c) for c in cols])


def null_dropping_group_sum(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """E10 with R's aggregate() NA rule (R4): rows with NULL key or value are
    dropped before grouping."""
    return df.dropna(subset=[key, value]).groupBy(key).agg(F.sum(value).alias(name))


# ---------------------------------------------------------------- reshape
def unpivot_nonzero(df: DataFrame, ids: list[str], value_cols: list[str], var: str, val: str) -> DataFrame:
    """H4: wide one-hot -> long, keeping only non-zero cells (gather + filter)."""
    return df.unpivot(ids, value_cols, var, val).filter(F.col(val) != 0)


def transpose_small(df: DataFrame, key: str, columns: list[str], values: list) -> DataFrame:
    """H5: transpose a small keyed table: rows become columns, one per listed
    key value (no distinct job, a fixed number of columns)."""
    long = df.unpivot([key], columns, "variable", "value")
    return long.groupBy("variable").pivot(key, values).agg(F.first("value"))


def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Append frames with a tag column (split again by filtering)."""
    out = None
    for name, f in frames.items():
        t = f.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out
