"""Classifier / forecast evaluation (L1-L7): confusion counts, cutoff sweeps,
KS, lift and gain, MAPE.  All are conditional counts in one aggregate, or
window work over a handful of pre-aggregated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.ordered import global_rank, ntile_by_rank, prefix_sums


def confusion_counts(df: DataFrame, actual: Column, predicted: Column, group: list[str] | None = None) -> DataFrame:
    """L1: TP, FP, TN, FN, accuracy, sensitivity, specificity (binary 0/1)."""
    a, p = actual.cast("int"), predicted.cast("int")
    g = df.groupBy(*(group or [])).agg(
        F.count_if((a == 1) & (p == 1)).alias("tp"), F.count_if((a == 0) & (p == 1)).alias("fp"),
        F.count_if((a == 0) & (p == 0)).alias("tn"), F.count_if((a == 1) & (p == 0)).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return (g.withColumn("accuracy", (F.col("tp") + F.col("tn")) / n)
            .withColumn("sensitivity", F.col("tp") / (F.col("tp") + F.col("fn")))
            .withColumn("specificity", F.col("tn") / (F.col("tn") + F.col("fp"))))


def cutoff_grid(lo: float = 0.01, hi: float = 0.80, n: int = 100) -> list[float]:
    """seq(lo, hi, length = n)."""
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def cutoff_sweep(df: DataFrame, actual: str, score: str, cutoffs: list[float]) -> DataFrame:
    """L3: sensitivity / specificity / accuracy at every cutoff, without
    pairing rows with cutoffs.  Each row is assigned the number of cutoffs it
    reaches (score >= c); counts per bucket (at most len(cutoffs)+1 rows) are
    then accumulated, so predicted-positive counts at cutoff i are suffix sums.
    Cutoffs must be increasing."""
    cs = sorted(cutoffs)
    arr = F.array(*[F.lit(float(c)) for c in cs])
    s = F.col(score)
    step = (cs[-1] - cs[0]) / (len(cs) - 1) if len(cs) > 1 else 0.0
    uniform = len(cs) > 1 and all(abs(cs[i] - (cs[0] + i * step)) <= 1e-12 for i in range(len(cs)))
    if uniform:
        # even grid: closed-form bucket, then a one-step correction against
        # the exact literal cutoffs (floating error is at most one bucket)
        n = len(cs)
        approx = F.least(F.greatest(F.floor((s - cs[0]) / step).cast("int") + 1, F.lit(0)), F.lit(n))
        up = ((approx < n) & (F.element_at(arr, F.least(approx + 1, F.lit(n))) <= s)).cast("int")
        down = ((approx >= 1) & (F.element_at(arr, F.greatest(approx, F.lit(1))) > s)).cast("int")
        reached = approx + up - down
    else:
        reached = F.size(F.filter(arr, lambda c: c <= s))
    b = (df.filter(s.isNotNull()).select(reached.alias("j"), F.col(actual).cast("int").alias("y"))
         .groupBy("j").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i + 1, float(c)) for i, c in enumerate(cs)], "i int, cutoff double")
    # rows reaching cutoff i are those with j >= i: suffix sums over <= len(cs)+1 bucket rows
    w = Window.orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    cum = b.select("j", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"))
    tot = b.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    P, N = tot.select("P").scalar(), tot.select("N").scalar()
    # the suffix sum for cutoff i is at the smallest bucket j >= i present
    wn = Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    g = (grid.join(F.broadcast(cum), grid.i == cum.j, "left")
         .withColumn("tp", F.coalesce(F.first("tp", ignorenulls=True).over(wn), F.lit(0)).cast("long"))
         .withColumn("fp", F.coalesce(F.first("fp", ignorenulls=True).over(wn), F.lit(0)).cast("long")))
    out = g.select(
        "cutoff", "tp", "fp",
        (F.col("tp") / P).alias("sensitivity"), ((N - F.col("fp")) / N).alias("specificity"),
        ((F.col("tp") + N - F.col("fp")) / (P + N)).alias("accuracy"))
    # balance points: sensitivity and specificity within 0.01 of each other
    return out.withColumn("is_balanced", F.abs(F.col("sensitivity") - F.col("specificity")) < 0.01)


def ks_from_scores(df: DataFrame, actual: str, score: str) -> DataFrame:
    """L4 (score form): max over thresholds of TPR - FPR, scores descending.
    Rows are first collapsed to distinct scores; running totals over them are
    exact distributed prefix sums."""
    agg = (df.filter(F.col(score).isNotNull())
           .groupBy(score).agg(F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg")))
    cum = prefix_sums(agg, [F.desc(score)], ["pos", "neg"])
    P = agg.agg(F.sum("pos")).scalar()
    N = agg.agg(F.sum("neg")).scalar()
    return cum.agg(F.max(F.col("cum_pos") / P - F.col("cum_neg") / N).alias("ks"))


def lift_gain(df: DataFrame, actual: str, score: str, tiebreak: str, groups: int = 10) -> DataFrame:
    """Deciles of descending score (exact distributed n-tile),
    then per decile: rows, responders, cumulative responders, gain %, lift."""
    r = global_rank(df.select(actual, score, tiebreak), [F.desc(score), F.asc(tiebreak)], None, "rk")
    n = df.agg(F.count(F.lit(1))).scalar()
    d = r.withColumn("bucket", ntile_by_rank(F.col("rk"), n, groups))
    g = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(actual).cast("long")).alias("totalresp"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # <= `groups` rows
    total_resp = F.sum("totalresp").over(Window.partitionBy())
    g = g.withColumn("cumresp", F.sum("totalresp").over(w))
    return (g.withColumn("gain", F.col("cumresp") * 100.0 / total_resp)
            .withColumn("cumlift", F.col("gain") / (F.col("bucket") * (100.0 / groups))))


def mape(actual: Column, forecast: Column) -> Column:
    """Mean absolute percentage error (rows with a zero actual are
    skipped, as a division by zero has no percentage)."""
    return F.avg(F.abs(F.try_divide(actual - forecast, actual))) * 100
