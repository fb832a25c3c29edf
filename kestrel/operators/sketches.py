"""Mergeable sketches (the scale form of C20 and E5).

A day's values are reduced once to a quantile sketch (KLL) and a distinct
sketch (HyperLogLog) per column, kept as binary columns of a small table.  Any
longer period is a merge of its days' sketches: history is never scanned
again, and a new day only adds its own row.  All steps are Spark aggregates
with a map-side part, so a day that holds a third of all rows costs one sketch
per map task.

Nulls (and NaN in numeric columns) are in no sketch.  A key without a single
value of a column has a null sketch; its percentiles are null, its distinct
count is 0.  Null keys are a group of their own, as in groupBy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILE, DISTINCT = "__kll", "__hll"

#: Size parameter of the quantile sketches: a rank is off by at most about 0.35 % of the rows (99 % of all cases).
KLL_K = 800
#: Base-2 logarithm of the registers of the distinct sketches: standard error about 0.8 %.
HLL_LG = 14


def sketch(df: DataFrame, keys: list[str], numeric: list[str], distinct: list[str]) -> DataFrame:
    """One row per key: n_rows, a quantile sketch of every column of `numeric`
    (`<column>__kll`) and a distinct sketch of every one of `distinct`
    (`<column>__hll`; its values are compared as text)."""
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numeric}
    aggs = [F.when(F.count(value[c]) > 0, F.kll_sketch_agg_double(value[c], F.lit(KLL_K))).alias(c + QUANTILE)
            for c in numeric]
    aggs += [F.when(F.count(c) > 0, F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_LG))).alias(c + DISTINCT)
             for c in distinct]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser keys (columns of `sketches`) from those of finer ones."""
    aggs = []
    for c in sketches.columns:
        if c.endswith(QUANTILE):
            aggs.append(F.kll_merge_agg_double(c, F.lit(KLL_K)).alias(c))
        elif c.endswith(DISTINCT):
            aggs.append(F.hll_union_agg(c).alias(c))
    out = sketches.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), *aggs,
                                      *[F.count(c).alias(f"{c}__has") for c in sketches.columns
                                        if c.endswith((QUANTILE, DISTINCT))])
    for c in [c for c in out.columns if c.endswith("__has")]:
        name = c.removesuffix("__has")
        out = out.withColumn(name, F.when(F.col(c) > 0, F.col(name))).drop(c)
    return out


def sketch_percentiles(sketches: DataFrame, keys: list[str], column: str, probs: list[float]) -> DataFrame:
    """keys..., n (values), p, value: values whose rank is near p n; null without values."""
    s = F.col(column + QUANTILE)
    ps = F.array(*[F.lit(float(p)) for p in probs])
    at = F.when(s.isNotNull(), F.kll_sketch_get_quantile_double(s, ps))
    n = F.when(s.isNotNull(), F.kll_sketch_get_n_double(s)).otherwise(F.lit(0))
    both = F.arrays_zip(ps.alias("p"), F.coalesce(at, F.array_repeat(F.lit(None).cast("double"), len(probs))).alias("value"))
    return sketches.select(*keys, n.alias("n"), F.inline(both))


def sketch_rank(column: str, value: Column) -> Column:
    """Share of the values at or below `value`, as the quantile sketch has it."""
    s = F.col(column + QUANTILE)
    return F.when(s.isNotNull(), F.kll_sketch_get_rank_double(s, value))


def sketch_distinct(sketches: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys..., column, n_distinct (estimated) of every distinct-sketched column named."""
    parts = [sketches.select(*keys, F.lit(c).alias("column"),
                             F.coalesce(F.when(F.col(c + DISTINCT).isNotNull(), F.hll_sketch_estimate(c + DISTINCT)),
                                        F.lit(0)).alias("n_distinct")) for c in columns]
    return reduce(DataFrame.unionAll, parts)
