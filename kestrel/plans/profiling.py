"""Profiling and data-quality reports over the driver tables: shape, ranges,
percentiles, five-number summaries, Tukey outlier removal, duplicates, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.columns import constant_column_report
from kestrel.operators.encode import level_index, sparse_encode
from kestrel.operators.ordered import tukey_hinges
from kestrel.operators.quality import (filter_within_fences, five_number_summary, min_max_profile,
                                       percentile_profile, remove_above_percentile, remove_boxplot_outliers,
                                       tukey_fences)
from kestrel.operators.relational import check_unique_key, count_duplicate_rows
from kestrel.operators.sketches import merge_sketches, sketch, sketch_distinct, sketch_percentiles
from kestrel.plans.registry import query
from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.io import read_table, shape_report

PROBS = [i / 100 for i in range(101)]
LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_shape", [], """
SELECT column_name AS "column", CAST(ordinal_position AS INTEGER) AS position,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                 WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS data_type,
  data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') AS is_numeric,
  (SELECT count(*) FROM lineitem) AS n_rows, CAST(11 AS INTEGER) AS n_cols
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def profile_shape(spark: SparkSession, d: str) -> DataFrame:
    """Rows, columns, per-column type and numeric flag."""
    return shape_report(read_table(spark, d, "lineitem"))


@query("profile_min_max", [], "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) + 0.0 AS min_value, CAST(max({c}) AS DOUBLE) + 0.0 AS max_value FROM lineitem"
    for c in LI_NUMERIC) + ")")
def profile_min_max(spark: SparkSession, d: str) -> DataFrame:
    """Domain ranges of the numeric columns in one scan."""
    p = min_max_profile(read_table(spark, d, "lineitem"), LI_NUMERIC)
    # -0.0 and 0.0 are equal; report the positive zero
    return p.select("column", (F.col("min_value") + 0.0).alias("min_value"), (F.col("max_value") + 0.0).alias("max_value"))


@query("percentile_profile", [], """
SELECT round(p, 2) AS p, round(v, 6) AS value FROM (
  SELECT unnest(range(0, 101)) / 100 AS p,
         unnest(quantile_cont(o_totalprice, [x / 100 for x in range(0, 101)])) AS v FROM orders)""")
def percentile_profile_q(spark: SparkSession, d: str) -> DataFrame:
    """C20: exact percentiles 0..100 of order value."""
    q = percentile_profile(read_table(spark, d, "orders"), "o_totalprice", PROBS)
    return q.select(F.round("p", 2).alias("p"), F.round("value", 6).alias("value"))


@query("five_number_summary", [], """
SELECT o_orderstatus, min(o_totalprice) AS min, round(sum(o_totalprice), 2) / count(o_totalprice) AS mean,
       max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
       round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3
FROM orders GROUP BY 1""")
def five_number_summary_q(spark: SparkSession, d: str) -> DataFrame:
    """summary() per order status."""
    s = five_number_summary(read_table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])
    o = read_table(spark, d, "orders").groupBy("o_orderstatus").agg(
        (F.round(F.sum("o_totalprice"), 2) / F.count("o_totalprice")).alias("mean2"))
    return s.join(o, "o_orderstatus").select(
        "o_orderstatus", "min", F.col("mean2").alias("mean"), "max",
        F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"), F.round("q3", 6).alias("q3"))


def _hinge_sql(src: str, col: str, name: str) -> str:
    return f"""{name}_x AS (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS k, count(*) OVER () AS n
                FROM {src} WHERE {col} IS NOT NULL),
{name}_i AS (SELECT DISTINCT n, floor(floor((n + 3) / 2) / 2) AS a1, ceil(floor((n + 3) / 2) / 2) AS a2,
               n + 1 - ceil(floor((n + 3) / 2) / 2) AS b1, n + 1 - floor(floor((n + 3) / 2) / 2) AS b2 FROM {name}_x),
{name}_h AS (SELECT (sum(v) FILTER (WHERE k = a1) + sum(v) FILTER (WHERE k = a2)) / 2 AS lh,
                    (sum(v) FILTER (WHERE k = b1) + sum(v) FILTER (WHERE k = b2)) / 2 AS uh
             FROM {name}_x, {name}_i),
{name}_b AS (SELECT lh - 1.5 * (uh - lh) AS lo, uh + 1.5 * (uh - lh) AS hi FROM {name}_h)"""


@query("outlier_boxplot", [], _hinge_sql("orders", "o_totalprice", "h1") + """,
s1 AS (SELECT * FROM orders WHERE o_totalprice IS NULL OR o_totalprice BETWEEN (SELECT lo FROM h1_b) AND (SELECT hi FROM h1_b)),
""" + _hinge_sql("s1", "o_orderkey", "h2") + """,
s2 AS (SELECT * FROM s1 WHERE o_orderkey IS NULL OR o_orderkey BETWEEN (SELECT lo FROM h2_b) AND (SELECT hi FROM h2_b))
SELECT (SELECT count(*) FROM orders) AS n_before, (SELECT count(*) FROM s1) AS n_after_first,
       (SELECT count(*) FROM s2) AS n_after, (SELECT lo FROM h1_b) AS lo_bound, (SELECT hi FROM h1_b) AS hi_bound""")
def outlier_boxplot(spark: SparkSession, d: str) -> DataFrame:
    """Tukey-fence outlier removal on order value, then order key, with
    fences recomputed on the survivors of each step."""
    o = read_table(spark, d, "orders")
    f1 = tukey_fences(o, "o_totalprice")
    s1 = filter_within_fences(o, "o_totalprice", f1)
    s2 = remove_boxplot_outliers(s1, ["o_orderkey"])
    return o.agg(F.count(F.lit(1)).alias("n_before")).select(
        "n_before", s1.agg(F.count(F.lit(1))).scalar().alias("n_after_first"),
        s2.agg(F.count(F.lit(1))).scalar().alias("n_after"),
        f1["lo_bound"].alias("lo_bound"), f1["hi_bound"].alias("hi_bound"))


@query("box_stats_by_class", [], """
WITH x AS (SELECT o_orderstatus AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS k,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WHERE o_totalprice IS NOT NULL),
i AS (SELECT DISTINCT g, n, floor(floor((n + 3) / 2) / 2) AS a1, ceil(floor((n + 3) / 2) / 2) AS a2,
        floor((n + 1) / 2) AS m1, ceil((n + 1) / 2) AS m2,
        n + 1 - ceil(floor((n + 3) / 2) / 2) AS b1, n + 1 - floor(floor((n + 3) / 2) / 2) AS b2 FROM x),
h AS (SELECT x.g AS o_orderstatus, i.n,
        (sum(v) FILTER (WHERE k = a1) + sum(v) FILTER (WHERE k = a2)) / 2 AS lower_hinge,
        (sum(v) FILTER (WHERE k = m1) + sum(v) FILTER (WHERE k = m2)) / 2 AS median,
        (sum(v) FILTER (WHERE k = b1) + sum(v) FILTER (WHERE k = b2)) / 2 AS upper_hinge
      FROM x JOIN i USING (g) GROUP BY x.g, i.n)
SELECT *, lower_hinge - 1.5 * (upper_hinge - lower_hinge) AS lo_bound,
          upper_hinge + 1.5 * (upper_hinge - lower_hinge) AS hi_bound FROM h""")
def box_stats_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Boxplot statistics per class (exact hinges per group)."""
    return tukey_hinges(read_table(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])


@query("outlier_percentile", [], """
SELECT count(*) AS n_kept FROM lineitem WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.99) FROM lineitem)""")
def outlier_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Drop rows above the 99th percentile."""
    kept = remove_above_percentile(read_table(spark, d, "lineitem"), "l_extendedprice", 0.99)
    return kept.agg(F.count(F.lit(1)).alias("n_kept"))


@query("drop_constant_columns", [], """
WITH e AS (SELECT label, vec_id, 0 AS pixel_pad, embedding[1] AS first_pixel FROM embeddings)
SELECT * FROM (
  SELECT 'label' AS "column", count(*) - count(label) AS n_null, count(*) AS n_rows,
         count(label) = 0 OR (count(label) = count(*) AND min(label) = max(label)) AS is_constant FROM e
  UNION ALL SELECT 'vec_id', count(*) - count(vec_id), count(*),
         count(vec_id) = 0 OR (count(vec_id) = count(*) AND min(vec_id) = max(vec_id)) FROM e
  UNION ALL SELECT 'pixel_pad', count(*) - count(pixel_pad), count(*),
         count(pixel_pad) = 0 OR (count(pixel_pad) = count(*) AND min(pixel_pad) = max(pixel_pad)) FROM e
  UNION ALL SELECT 'first_pixel', count(*) - count(first_pixel), count(*),
         count(first_pixel) = 0 OR (count(first_pixel) = count(*) AND min(first_pixel) = max(first_pixel)) FROM e)""")
def drop_constant_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which columns hold a single value (NULL counted as a value)."""
    e = read_table(spark, d, "embeddings").select(
        "label", "vec_id", F.lit(0).alias("pixel_pad"), F.col("embedding")[0].alias("first_pixel"))
    return constant_column_report(e)


@query("count_duplicate_rows", [], """
SELECT CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS n_duplicates, count(*) AS n_rows FROM lineitem""")
def count_duplicate_rows_q(spark: SparkSession, d: str) -> DataFrame:
    """Repeated (order, line) pairs."""
    return count_duplicate_rows(read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("check_unique_key", [], """
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_distinct, count(*) - count(DISTINCT o_orderkey) AS n_duplicated
FROM orders""")
def check_unique_key_q(spark: SparkSession, d: str) -> DataFrame:
    """C17: is the order key unique?"""
    return check_unique_key(read_table(spark, d, "orders"), "o_orderkey")


# ------------------------------------------------------- mergeable sketches
SKETCH_PROBS = [i / 20 for i in range(21)]
SKETCH_RANK_ERROR, SKETCH_DISTINCT_ERROR = 0.01, 0.05


def daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Per order day: sketches of order value and of customers, written once."""
    ensure_checkpoint_dir(spark)
    o = read_table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return sketch(o, ["day"], ["o_totalprice"], ["o_custkey"]).checkpoint(eager=True)


def _monthly(spark, d):
    days = daily_sketches(spark, d).withColumn("month", F.date_format("day", "yyyy-MM"))
    return merge_sketches(days, ["month"])


@query("sketch_percentiles")
def sketch_percentiles_q(spark: SparkSession, d: str) -> DataFrame:
    """C20: percentiles of order value per month, from the merged sketches of its days."""
    return sketch_percentiles(_monthly(spark, d), ["month"], "o_totalprice", SKETCH_PROBS)


@query("sketch_percentile_check", [], f"""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(o_totalprice) AS n FROM orders GROUP BY 1)
SELECT month, n, round(i / 20, 2) AS p, n > 0 AS near FROM m, range(0, {len(SKETCH_PROBS)}) AS r(i)""")
def sketch_percentile_check(spark: SparkSession, d: str) -> DataFrame:
    """C20: whether the rank of every merged percentile, counted over all orders, is within 1 % of the one asked for."""
    at = sketch_percentiles(_monthly(spark, d), ["month"], "o_totalprice", SKETCH_PROBS) \
        .groupBy(F.col("month").alias("m")).agg(F.sort_array(F.collect_list(F.struct("p", "value"))).alias("q"))  # 21 a month
    o = read_table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"),
                                              F.col("o_totalprice").alias("x"))
    o = o.join(at, F.col("month").eqNullSafe(F.col("m")))
    below = [F.struct(F.lit(p).alias("p"), F.count_if(F.col("x") < F.col("q")[i]["value"]).alias("lt"),
                      F.count_if(F.col("x") <= F.col("q")[i]["value"]).alias("le")) for i, p in enumerate(SKETCH_PROBS)]
    r = o.groupBy("month").agg(F.count("x").alias("n"), F.array(*below).alias("b")).select("month", "n", F.inline("b"))
    lo, hi = F.col("lt") / F.col("n") - SKETCH_RANK_ERROR, F.col("le") / F.col("n") + SKETCH_RANK_ERROR
    near = F.when(F.col("n") > 0, F.col("p").between(lo, hi)).otherwise(False)
    return r.select("month", "n", F.round("p", 2).alias("p"), near.alias("near"))


@query("sketch_distinct")
def sketch_distinct_q(spark: SparkSession, d: str) -> DataFrame:
    """E5: estimated number of customers per month, from the merged sketches of its days."""
    return sketch_distinct(_monthly(spark, d), ["month"], ["o_custkey"])


@query("sketch_distinct_check", [], """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS n_exact, true AS near FROM orders GROUP BY 1""")
def sketch_distinct_check(spark: SparkSession, d: str) -> DataFrame:
    """E5: whether the merged estimates are within 5 % of the exact counts (or one off)."""
    est = sketch_distinct(_monthly(spark, d), ["month"], ["o_custkey"]).select(F.col("month").alias("m"), "n_distinct")
    exact = read_table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")) \
        .agg(F.count_distinct("o_custkey").alias("n_exact"))
    off = F.abs(F.col("n_distinct") - F.col("n_exact"))
    return exact.join(est, F.col("month").eqNullSafe(F.col("m"))) \
        .select("month", "n_exact", (off <= F.greatest(F.lit(1.0), F.col("n_exact") * SKETCH_DISTINCT_ERROR)).alias("near"))


# ----------------------------------------------------------- sparse encoding
ENCODED, ENCODED_SLOTS = ["o_orderpriority", "o_orderstatus", "o_custkey"], 16

_LEVELS_SQL = "WITH l AS (" + " UNION ALL ".join(
    f"SELECT {i} AS f, '{c}' AS factor, CAST({c} AS VARCHAR) AS level, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 3"
    for i, c in enumerate(ENCODED)) + f"""),
r AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY n DESC, level) - 1 AS slot FROM l),
s AS (SELECT * FROM r WHERE slot < {ENCODED_SLOTS})"""


@query("level_index", [], _LEVELS_SQL + "\nSELECT factor, level, n, CAST(slot AS INTEGER) AS slot FROM s")
def level_index_q(spark: SparkSession, d: str) -> DataFrame:
    """Slots of the most frequent levels of three factors of orders, one of them with a level per customer."""
    return level_index(read_table(spark, d, "orders"), ENCODED, ENCODED_SLOTS)


@query("sparse_encode", [], _LEVELS_SQL + """,
w AS (SELECT f, count(*) + 1 AS w FROM s GROUP BY f), """ + ", ".join(
    f"""p{i} AS (SELECT o_orderkey, coalesce((SELECT sum(w) FROM w WHERE f < {i}), 0)
       + coalesce(slot, (SELECT w - 1 FROM w WHERE f = {i}), 0) AS p
     FROM orders LEFT JOIN s ON f = {i} AND level = CAST({c} AS VARCHAR) WHERE {c} IS NOT NULL)"""
    for i, c in enumerate(ENCODED)) + """
SELECT o_orderkey, CAST((SELECT sum(w) FROM w) AS INTEGER) AS size, concat_ws(',', """ + ", ".join(
    f"CAST(CAST(p{i}.p AS BIGINT) AS VARCHAR)" for i in range(len(ENCODED))) + """) AS indices
FROM orders """ + " ".join(f"LEFT JOIN p{i} USING (o_orderkey)" for i in range(len(ENCODED))))
def sparse_encode_q(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a sparse one-hot vector over those slots; levels beyond them share the factor's last."""
    o = sparse_encode(read_table(spark, d, "orders"), ENCODED, ENCODED_SLOTS)
    return o.select("o_orderkey", F.col("encoded.size").alias("size"),
                    F.concat_ws(",", F.col("encoded.indices").cast("array<string>")).alias("indices"))
