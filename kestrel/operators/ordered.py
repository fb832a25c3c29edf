"""Order-dependent operators (F1-F15) and exact distributed order statistics.

`global_rank` gives every row its exact 1-based position in a global (or
per-group) order without moving all rows to one task: the data is range
partitioned and sorted within partitions, written once to the shared
checkpoint folder (fixing the layout and cutting lineage), and each row's
rank is its position inside its partition plus the number of rows of the same
group in all earlier partitions (a small per-partition count table).
Deciles and stratified splits use it (with a unique tie-break key, so equal
scores still spread over partitions).  Order statistics (percentiles, Tukey
hinges) instead rank a value histogram with `prefix_sums`, so a value that
repeats on a large share of rows never lands whole in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id = (partition << 33) + position


def global_rank(df: DataFrame, order: list[Column | str], group: list[str] | None = None,
                name: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based row position by `order` (within `group` if given).

    Ties get distinct consecutive ranks (order among equal keys arbitrary),
    which is what order statistics and n-tiles need."""
    group = list(group or [])
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    laid = (laid.withColumn("__pid", F.spark_partition_id())
            .withColumn("__pos", F.monotonically_increasing_id()
                        - F.shiftleft(F.spark_partition_id().cast("long"), _POS_BITS)))
    counts = laid.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__cnt"), F.min("__pos").alias("__first"))
    w = Window.partitionBy(*group).orderBy("__pid") if group else Window.orderBy("__pid")
    offsets = counts.withColumn("__before", F.sum("__cnt").over(w) - F.col("__cnt")).drop("__cnt")
    out = laid.join(offsets, ["__pid", *group])
    return (out.withColumn(name, F.col("__before") + F.col("__pos") - F.col("__first") + 1)
            .drop("__pid", "__pos", "__first", "__before"))


def values_at_ranks(df: DataFrame, value: str, ranks, group: list[str] | None = None,
                    buckets: int = 4096) -> DataFrame:
    """Exact order statistics without ranking individual rows.

    Rows are first collapsed to a value histogram (group, value, count) —
    a map-side-combined aggregate, so a value repeated on a third of all rows
    is one row per map task — then cumulative counts over the sorted distinct
    values give each value its rank interval [lo, hi].  `ranks(n)` returns
    the requested ranks as Column expressions of the group size n.  Ranks and
    intervals meet in an equi-join on a rank bucket of width ceil(n/buckets):
    each interval is listed under every bucket it spans (at most `buckets`
    extra rows per group in total) and the join is then filtered to
    lo <= k <= hi.  Output: group..., n, k, x (one row per requested rank)."""
    group = list(group or [])
    base = df.select(*group, value).filter(F.col(value).isNotNull())
    hist = base.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    cum = prefix_sums(hist, [value], ["__c"], group=group)
    cum = cum.withColumn("__lo", F.col("cum___c") - F.col("__c") + 1).withColumnRenamed("cum___c", "__hi")
    spec = hist.groupBy(*group).agg(F.sum("__c").alias("n"))
    req = ranks(F.col("n"))
    req = req if isinstance(req, Column) else F.array(*[r.cast("long") for r in req])
    spec = (spec.withColumn("__ks", F.array_distinct(req.cast("array<long>")))
            .withColumn("__w", F.greatest(F.lit(1), F.ceil(F.col("n") / buckets)).cast("long")))
    if group:
        cum = cum.join(spec.select(*group, "n", "__w"), group)
    else:
        sc = hist.agg(F.struct(F.sum("__c").alias("n"),
                               F.greatest(F.lit(1), F.ceil(F.sum("__c") / buckets)).cast("long").alias("w"))).scalar()
        cum = cum.withColumn("n", sc["n"]).withColumn("__w", sc["w"])
    spans = cum.withColumn("__b", F.explode(F.sequence(F.floor((F.col("__lo") - 1) / F.col("__w")),
                                                       F.floor((F.col("__hi") - 1) / F.col("__w")))))
    want = (spec.select(*group, "__w", F.explode("__ks").alias("k"))
            .withColumn("__b", F.floor((F.col("k") - 1) / F.col("__w"))).drop("__w"))
    hit = spans.join(want, [*group, "__b"]).filter((F.col("k") >= F.col("__lo")) & (F.col("k") <= F.col("__hi")))
    return hit.select(*group, "n", "k", F.col(value).alias("x"))


def exact_percentiles(df: DataFrame, value: str, probs: list[float], group: list[str] | None = None) -> DataFrame:
    """Type-7 (linear interpolation) percentiles, exact at any scale:
    h = (n-1)p + 1, x[floor h] + (h - floor h)(x[ceil h] - x[floor h]).
    The needed ranks are two array expressions over the literal p list; the
    two order statistics per p are attached by equi-joins on rank.
    Output: group..., p, value."""
    group = list(group or [])
    pa = F.array(*[F.lit(float(p)) for p in probs])

    def ranks(n):
        return F.concat(F.transform(pa, lambda p: F.floor((n - 1) * p + 1)),
                        F.transform(pa, lambda p: F.ceil((n - 1) * p + 1)))

    v = values_at_ranks(df, value, ranks, group)
    req = (v.select(*group, "n").distinct()
           .withColumn("p", F.explode(pa))
           .withColumn("h", (F.col("n") - 1) * F.col("p") + 1)
           .withColumn("klo", F.floor("h").cast("long")).withColumn("khi", F.ceil("h").cast("long")))
    lo = v.select(*group, F.col("k").alias("klo"), F.col("x").alias("x_lo"))
    hi = v.select(*group, F.col("k").alias("khi"), F.col("x").alias("x_hi"))
    j = req.join(lo, [*group, "klo"]).join(hi, [*group, "khi"])
    return j.select(*group, "p", (F.col("x_lo") + (F.col("h") - F.col("klo")) * (F.col("x_hi") - F.col("x_lo")))
                    .alias("value"))


def tukey_hinges(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """boxplot.stats hinges: with n4 = floor((n+3)/2)/2 the lower hinge is the
    mean of x[floor n4], x[ceil n4]; the upper one mirrors it from the top.
    Output: group..., n, lower_hinge, median, upper_hinge, lo_bound, hi_bound."""
    group = list(group or [])

    def slots(n):
        n4 = F.floor((n + 3) / 2) / 2
        m = (n + 1) / 2
        return {"a1": F.floor(n4), "a2": F.ceil(n4), "m1": F.floor(m), "m2": F.ceil(m),
                "b1": n + 1 - F.ceil(n4), "b2": n + 1 - F.floor(n4)}

    v = values_at_ranks(df, value, lambda n: list(slots(n).values()), group)
    sl = slots(F.col("n"))
    out = v.groupBy(*group, "n").agg(*[F.max(F.when(F.col("k") == r, F.col("x"))).alias(f"x_{s}")
                                       for s, r in sl.items()])
    lh = (F.col("x_a1") + F.col("x_a2")) / 2
    uh = (F.col("x_b1") + F.col("x_b2")) / 2
    return out.select(*group, "n", lh.alias("lower_hinge"), ((F.col("x_m1") + F.col("x_m2")) / 2).alias("median"),
                      uh.alias("upper_hinge"), (lh - 1.5 * (uh - lh)).alias("lo_bound"),
                      (uh + 1.5 * (uh - lh)).alias("hi_bound"))


def ntile_by_rank(rank: Column, n: Column, buckets: int) -> Column:
    """SQL NTILE(b) from an exact rank: the first n % b tiles get one extra row."""
    size = F.floor(n / buckets)
    extra = n % buckets
    big = extra * (size + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (size + 1)) + 1) \
        .otherwise(extra + F.floor((rank - 1 - big) / size) + 1).cast("int")


# -------------------------------------------------------- keyed time order
def lag_features(df: DataFrame, key: list[str], order: str, col: str, lags=(1, 2, 3)) -> DataFrame:
    """lag k of a column within each key, ordered by `order`."""
    w = Window.partitionBy(*key).orderBy(order)
    for k in lags:
        df = df.withColumn(f"{col}_lag_{k}", F.lag(col, k).over(w))
    return df


def pct_change_vs_lag(col: str, lag_col: str) -> Column:
    """(x - lag) / lag with missing / zero lag -> 0."""
    return F.coalesce(F.try_divide(F.col(col) - F.col(lag_col), F.col(lag_col)), F.lit(0.0))


def trailing_mean(key: list[str], order: str, col: str, k: int) -> Column:
    """right-aligned rolling mean over k rows; NULL until k rows exist."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-(k - 1), 0)
    exact = F.sum(F.col(col).cast("decimal(38,10)")).over(w).cast("double") / k
    return F.when(F.count(F.lit(1)).over(w) == k, exact)


def adstock(df: DataFrame, key: list[str], order: str, col: str, rate: float, out: str = "adstock") -> DataFrame:
    """recursive filter y_t = x_t + rate * y_{t-1} (y_0 = x_0) per key.

    One fold over each key's ordered series (weeks or months, so hundreds of
    values per key), then one row per period again: key..., order, col, out."""
    series = df.groupBy(*key).agg(F.sort_array(F.collect_list(
        F.struct(F.col(order), F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias(col)))).alias("__s"))
    zero = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("ys"))

    def step(acc, v):
        y = v[col] + acc["y"] * F.lit(float(rate))
        return F.struct(y.alias("y"), F.array_append(acc["ys"], y).alias("ys"))
    folded = series.withColumn("__y", F.aggregate("__s", zero, step, lambda acc: acc["ys"]))
    return folded.select(*key, F.explode(F.arrays_zip("__s", "__y")).alias("__r")) \
        .select(*key, F.col(f"__r.__s.{order}").alias(order), F.col(f"__r.__s.{col}").alias(col), F.col("__r.__y").alias(out))


def prefix_sums(df: DataFrame, order: list[Column | str], cols: list[str], prefix: str = "cum_",
                group: list[str] | None = None) -> DataFrame:
    """Running totals of `cols` in a global (or per-group) order, exact and
    distributed: the data is range partitioned and sorted, per-partition
    totals give each partition its starting offset (per group), and the
    running sum inside a partition is a window over that partition only."""
    group = list(group or [])
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    laid = (laid.withColumn("__pid", F.spark_partition_id())
            .withColumn("__pos", F.monotonically_increasing_id()
                        - F.shiftleft(F.spark_partition_id().cast("long"), _POS_BITS)))
    tot = laid.groupBy("__pid", *group).agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    wt = Window.partitionBy(*group).orderBy("__pid") if group else Window.orderBy("__pid")
    offs = tot.select("__pid", *group, *[(F.sum(f"__t_{c}").over(wt) - F.col(f"__t_{c}")).alias(f"__o_{c}")
                                         for c in cols])
    wp = Window.partitionBy("__pid", *group).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.join(offs, ["__pid", *group])
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"__o_{c}") + F.sum(c).over(wp))
    return out.drop("__pid", "__pos", *[f"__o_{c}" for c in cols])
