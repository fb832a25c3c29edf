"""Data-quality and profiling operators.

Every profile is one aggregate pass producing one wide row, unpivoted to a
long (column, statistic) table — never one job per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.ordered import exact_percentiles, tukey_hinges


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_null) for every column in one scan."""
    cols = columns or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null")


def drop_all_null_columns(df: DataFrame, max_ratio: float = 1.0) -> DataFrame:
    """Drop columns whose null ratio reaches `max_ratio` (default: all
    null).  The decision is one small row collected after one scan."""
    ratios = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, r in ratios.items() if r is not None and r >= max_ratio])


def min_max_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, max) as doubles, one scan."""
    wide = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(c).cast("double").alias("min_value"),
                             F.max(c).cast("double").alias("max_value")).alias(f"s{i}")
                    for i, c in enumerate(columns)])
    return (wide.select(F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s"))
            .select("s.column", "s.min_value", "s.max_value"))


def percentile_profile(df: DataFrame, col: str, probs: list[float], group: list[str] | None = None) -> DataFrame:
    """C20: exact type-7 percentiles (distributed ranks, see ordered.py)."""
    return exact_percentiles(df, col, probs, group)


def five_number_summary(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """Min, Q1, median, mean, Q3, max (type-7 quartiles)."""
    group = list(group or [])
    q = exact_percentiles(df, col, [0.25, 0.5, 0.75], group)
    wide = q.groupBy(*group).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    wide = wide.toDF(*group, "q1", "median", "q3")
    basic = df.groupBy(*group).agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"))
    return basic.join(wide, group) if group else _one_row_join(basic, wide)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("*", *[b.select(c).scalar().alias(c) for c in b.columns])


def remove_boxplot_outliers(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows outside the Tukey fences (hinges +- 1.5 IQR) of each
    column in turn, recomputing the fences on the surviving rows (as the
    sequential boxplot.stats clean-up does).  Fences are scalar subqueries."""
    out = df
    for c in cols:
        out = filter_within_fences(out, c, tukey_fences(out, c))
    return out


def tukey_fences(df: DataFrame, col: str):
    """The (lo_bound, hi_bound) struct of a column as ONE scalar subquery."""
    return tukey_hinges(df, col).select(F.struct("lo_bound", "hi_bound")).scalar()


def filter_within_fences(df: DataFrame, col: str, fences) -> DataFrame:
    return df.filter(F.col(col).isNull() | F.col(col).between(fences["lo_bound"], fences["hi_bound"]))


def remove_above_percentile(df: DataFrame, col: str, p: float) -> DataFrame:
    """Keep rows at or below the p-th percentile."""
    cut = exact_percentiles(df, col, [p]).select("value").scalar()
    return df.filter(F.col(col) <= cut)


def impute_mode(df: DataFrame, col: str) -> DataFrame:
    """NULL -> most frequent value (ties: smallest value).  Counting is a
    grouped aggregate; only the winning value travels, as a scalar."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col)))).scalar()
    return df.withColumn(col, F.coalesce(F.col(col), best))


def impute_moving_average(df: DataFrame, key: list[str], order: str, col: str, k: int) -> DataFrame:
    """C14: NULL -> simple mean of the non-null values within k rows each
    side (simple weights).  Where fewer than two lie that near, the window
    widens until it holds two, i.e. to the distance of the second-nearest
    value: the two nearest values before and after the row are all it can
    hold.  A series with one value fills with it, one without stays NULL."""
    w = Window.partitionBy(*key).orderBy(order)
    back = Window.partitionBy(*key).orderBy(F.desc(order)).rowsBetween(1, Window.unboundedFollowing)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    x = df.withColumn("__i", F.row_number().over(w)) \
        .withColumn("__v", F.when(F.col(col).isNotNull(), F.struct(F.col("__i").alias("i"), F.col(col).alias("x"))))
    near = w.rowsBetween(-k, k)
    x = x.withColumn("__n", F.count(col).over(near)) \
        .withColumn("__s", F.sum(F.col(col).cast("decimal(38,10)")).over(near))
    for name, frame in (("b", back), ("a", ahead)):
        for nth in (1, 2):
            x = x.withColumn(f"__{name}{nth}", F.nth_value("__v", nth, True).over(frame))
    cand = F.filter(F.array("__b1", "__b2", "__a1", "__a2"), lambda v: v.isNotNull())
    cand = F.transform(cand, lambda v: F.struct(F.abs(v["i"] - F.col("__i")).alias("d"), v["x"].alias("x")))
    x = x.withColumn("__c", F.sort_array(cand))
    reach = F.coalesce(F.get("__c", 1), F.get("__c", 0))["d"]
    inside = F.filter("__c", lambda v: v["d"] <= reach)
    total = F.aggregate(inside, F.lit(0).cast("decimal(38,10)"),
                        lambda acc, v: (acc + v["x"].cast("decimal(38,10)")).cast("decimal(38,10)"))
    wide = total.cast("double") / F.size(inside)
    filled = F.when(F.col("__n") >= 2, F.col("__s").cast("double") / F.col("__n")) \
        .when(F.size("__c") > 0, wide)
    return x.withColumn(col, F.coalesce(F.col(col), filled)) \
        .drop("__i", "__v", "__n", "__s", "__b1", "__b2", "__a1", "__a2", "__c")


def crosstab_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Two-way frequency table, one row per `row` value, one column per
    listed `col` value (fixed list: no extra distinct job)."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0)
