"""Churn / attrition analysis: encoding, scaling, stratified split, and the
evaluation of a probability score (confusion, cutoff sweep, KS, lift).
Stand-in: `churn` (documents x labels, deterministic score column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.columns import flag_binary
from kestrel.operators.evaluate import confusion_counts, cutoff_grid, cutoff_sweep, ks_from_scores, lift_gain
from kestrel.operators.stats import correlation_matrix, dummy_encode, split_random, split_stratified, vif, zscore_columns
from kestrel.plans import standins as S
from kestrel.plans.registry import query

CUTOFF = 0.5
TRAIN_RATIO = 0.7
CUTOFFS = cutoff_grid(0.01, 0.80, 100)
LANGS = ["de", "en", "es", "fr"]

Y_SQL = "CASE WHEN churn IS NULL THEN NULL WHEN churn = 'Yes' THEN 1 ELSE 0 END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return S.churn(spark, d).withColumn("y", flag_binary(F.col("churn"), "Yes"))


@query("flag_binary", ["churn"], f"SELECT customer_id, CAST({Y_SQL} AS INTEGER) AS y FROM churn")
def flag_binary_q(spark: SparkSession, d: str) -> DataFrame:
    """Yes/No label -> 1/0."""
    return scored(spark, d).select("customer_id", "y")


@query("pct_of_total", ["churn"], f"""
SELECT churn, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM churn) AS pct,
       (SELECT avg({Y_SQL}) FROM churn) * 100 AS churn_rate FROM churn GROUP BY churn""")
def pct_of_total_q(spark: SparkSession, d: str) -> DataFrame:
    """Class counts as % of all rows, and the positive-class rate."""
    from kestrel.operators.relational import group_count, pct_of_total
    s = scored(spark, d)
    g = pct_of_total(group_count(s, ["churn"], "n"), "n", "pct")
    return g.withColumn("churn_rate", s.agg(F.avg("y")).scalar() * 100)


@query("dummy_encode", ["churn"], """
SELECT customer_id, lang, """ + ", ".join(f"CAST(lang = '{v}' AS INTEGER) AS lang_{v}" for v in LANGS[1:]) + " FROM churn")
def dummy_encode_q(spark: SparkSession, d: str) -> DataFrame:
    """Language dummies, first level dropped."""
    return dummy_encode(S.churn(spark, d).select("customer_id", "lang"), "lang")


@query("zscore_columns", ["churn"], """
SELECT customer_id,
  round((n_chars - (SELECT avg(n_chars) FROM churn)) / (SELECT stddev_samp(n_chars) FROM churn), 6) AS n_chars,
  round((n_words - (SELECT avg(n_words) FROM churn)) / (SELECT stddev_samp(n_words) FROM churn), 6) AS n_words
FROM churn""")
def zscore_columns_q(spark: SparkSession, d: str) -> DataFrame:
    """scale(x) on the numeric predictors."""
    z = zscore_columns(S.churn(spark, d).select("customer_id", "n_chars", "n_words"), ["n_chars", "n_words"])
    return z.select("customer_id", F.round("n_chars", 6).alias("n_chars"), F.round("n_words", 6).alias("n_words"))


@query("split_stratified", ["churn"], f"""
SELECT customer_id, churn, row_number() OVER (PARTITION BY churn ORDER BY md5('100|' || customer_id), customer_id)
         <= round(count(*) OVER (PARTITION BY churn) * {TRAIN_RATIO}) AS is_train FROM churn""")
def split_stratified_q(spark: SparkSession, d: str) -> DataFrame:
    """70/30 split preserving the class ratio, row by row."""
    s = split_stratified(S.churn(spark, d).select("customer_id", "churn"), "churn", "customer_id", TRAIN_RATIO)
    return s.select("customer_id", "churn", "is_train")


_LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("split_random", [], """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(('0x' || substr(md5(concat_ws('|', '9999', """ + ", ".join(f"CAST({k} AS VARCHAR)" for k in _LI_KEYS) + """)), 1, 8))
            AS BIGINT) % 10000 < 7000 AS is_train
FROM lineitem""")
def split_random_q(spark: SparkSession, d: str) -> DataFrame:
    """Seeded 70/30 random split of the order lines (hash of the row key)."""
    from kestrel.sources.io import read_table
    li = read_table(spark, d, "lineitem").select(*_LI_KEYS)
    return split_random(li, _LI_KEYS, 0.7)


@query("confusion_metrics", ["churn"], f"""
WITH x AS (SELECT {Y_SQL} AS a, CASE WHEN score >= {CUTOFF} THEN 1 ELSE 0 END AS p FROM churn),
c AS (SELECT count(*) FILTER (WHERE a = 1 AND p = 1) AS tp, count(*) FILTER (WHERE a = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE a = 0 AND p = 0) AS tn, count(*) FILTER (WHERE a = 1 AND p = 0) AS fn FROM x)
SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fn) AS sensitivity, tn / (tn + fp) AS specificity FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """L1/L2: confusion counts and rates at a probability cutoff."""
    s = scored(spark, d)
    return confusion_counts(s, F.col("y"), (F.col("score") >= CUTOFF).cast("int"))


def _grid_sql() -> str:
    return ", ".join(f"('{c!r}'::DOUBLE)" for c in CUTOFFS)


@query("cutoff_sweep", ["churn"], f"""
WITH x AS (SELECT score, {Y_SQL} AS y FROM churn WHERE score IS NOT NULL),
g AS (SELECT * FROM (VALUES {_grid_sql()}) t(cutoff)),
pn AS (SELECT count(*) FILTER (WHERE y = 1) AS P, count(*) FILTER (WHERE y = 0) AS N FROM x),
c AS (SELECT g.cutoff, count(*) FILTER (WHERE x.y = 1 AND x.score >= g.cutoff) AS tp,
             count(*) FILTER (WHERE x.y = 0 AND x.score >= g.cutoff) AS fp FROM g, x GROUP BY g.cutoff)
SELECT c.cutoff, tp, fp, tp / P AS sensitivity, (N - fp) / N AS specificity, (tp + N - fp) / (P + N) AS accuracy,
       abs(tp / P - (N - fp) / N) < 0.01 AS is_balanced
FROM c, pn""")
def cutoff_sweep_q(spark: SparkSession, d: str) -> DataFrame:
    """L3: 100 cutoffs from 0.01 to 0.80; sensitivity/specificity/accuracy and
    the balance points (|sensitivity - specificity| < 0.01)."""
    return cutoff_sweep(scored(spark, d), "y", "score", CUTOFFS)


@query("ks_statistic", ["churn"], f"""
WITH x AS (SELECT score, {Y_SQL} AS y FROM churn WHERE score IS NOT NULL),
a AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM x GROUP BY score),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM a),
c AS (SELECT sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM a),
k AS (SELECT count(*) FILTER (WHERE y = 1 AND score >= {CUTOFF}) AS tp, count(*) FILTER (WHERE y = 1) AS p1,
             count(*) FILTER (WHERE y = 0 AND score < {CUTOFF}) AS tn, count(*) FILTER (WHERE y = 0) AS n0 FROM x)
SELECT (SELECT max(cp / P - cn / N) FROM c, t) AS ks, tp / p1 + tn / n0 - 1 AS ks_at_cutoff FROM k""")
def ks_statistic(spark: SparkSession, d: str) -> DataFrame:
    """L4: KS = max(TPR - FPR) over score thresholds, and the thresholded
    form TPR + TNR - 1 at the chosen cutoff."""
    s = scored(spark, d)
    ks = ks_from_scores(s, "y", "score")
    c = confusion_counts(s, F.col("y"), (F.col("score") >= CUTOFF).cast("int"))
    at = c.select((F.col("tp") / (F.col("tp") + F.col("fn")) + F.col("tn") / (F.col("tn") + F.col("fp")) - 1)).scalar()
    return ks.select("ks", at.alias("ks_at_cutoff"))


@query("lift_gain_table", ["churn"], f"""
WITH x AS (SELECT {Y_SQL} AS y, CAST(ntile(10) OVER (ORDER BY score DESC, customer_id) AS INTEGER) AS bucket FROM churn),
g AS (SELECT bucket, count(*) AS total, CAST(sum(y) AS BIGINT) AS totalresp FROM x GROUP BY bucket),
c AS (SELECT *, CAST(sum(totalresp) OVER (ORDER BY bucket) AS BIGINT) AS cumresp, sum(totalresp) OVER () AS allresp FROM g)
SELECT bucket, total, totalresp, cumresp, CAST(cumresp AS DOUBLE) * 100.0::DOUBLE / allresp AS gain,
       CAST(cumresp AS DOUBLE) * 100.0::DOUBLE / allresp / (bucket * 10.0::DOUBLE) AS cumlift FROM c""")
def lift_gain_table(spark: SparkSession, d: str) -> DataFrame:
    """Decile table of the descending score with gain and lift."""
    return lift_gain(scored(spark, d), "y", "score", "customer_id", 10)


@query("correlation_matrix", ["churn"], """
SELECT * FROM (VALUES ('n_chars', 'n_words'), ('n_chars', 'quality'), ('n_words', 'quality')) p(x, y),
LATERAL (SELECT round(CASE p.x || p.y WHEN 'n_charsn_words' THEN corr(n_chars, n_words)
                      WHEN 'n_charsquality' THEN corr(n_chars, quality) ELSE corr(n_words, quality) END, 6) AS r FROM churn)""")
def correlation_matrix_q(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlations of the numeric predictors."""
    c = correlation_matrix(S.churn(spark, d), ["n_chars", "n_words", "quality"])
    return c.select("x", "y", F.round("r", 6).alias("r"))


@query("vif", ["churn"], """
WITH r AS (SELECT corr(n_chars, n_words) AS a, corr(n_chars, score) AS b, corr(n_words, score) AS c FROM churn)
SELECT * FROM (
  SELECT 'n_chars' AS variable, round(1 / (1 - (a*a + b*b - 2*a*b*c) / (1 - c*c)), 4) AS vif FROM r
  UNION ALL SELECT 'n_words', round(1 / (1 - (a*a + c*c - 2*a*b*c) / (1 - b*b)), 4) FROM r
  UNION ALL SELECT 'score', round(1 / (1 - (b*b + c*c - 2*a*b*c) / (1 - a*a)), 4) FROM r)""")
def vif_q(spark: SparkSession, d: str) -> DataFrame:
    """VIF of three predictors (the SQL uses the closed-form R^2 of each
    on the other two; the operator inverts the correlation matrix)."""
    v = vif(S.churn(spark, d), ["n_chars", "n_words", "score"])
    return v.select("variable", F.round("vif", 4).alias("vif"))
