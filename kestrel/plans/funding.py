"""Investment analysis: companies x funding rounds x sector mapping.
Stand-ins: `companies`, `rounds`, `sector_mapping` (standins.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.columns import count_occurrences, first_token, repair_corrupt_text
from kestrel.operators.relational import (check_unique_key, key_set_difference, mean_range_filter,
                                          null_dropping_group_sum, semi_join_count, top_k_per_group,
                                          unpivot_nonzero)
from kestrel.plans import standins as S
from kestrel.plans.registry import query
from kestrel.sources.io import read_csv, read_csv_inferred, read_table, scratch_path, with_header, write_table

# Parameters: mean-amount band for the preferred round type, chosen type, and
# the number of countries / sectors reported.
MEAN_BAND = (250000.0, 255000.0)
ROUND_TYPE = "high"
TOP_COUNTRIES = 9

SECTOR_COLS_SQL = ", ".join(f'"{s}"' for s in S.SECTORS)


# ------------------------------------------------------------------ sources
@query("src_csv_roundtrip", ["companies"], "SELECT * FROM companies")
def src_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A1/A5: write a table as headed CSV to the shared scratch folder and
    scan it back with an explicit schema (no inference pass)."""
    c = S.companies(spark, d)
    path = scratch_path(spark, "companies-csv")
    write_table(c, path, "csv")
    return read_csv(spark, path, schema=c.schema, header=True)


def _csv_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as text, some columns of which change their type in a few of the rows."""
    o = read_table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(k.cast("string").alias("order_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority",
                    F.when(k % 1000 == 7, "12.5").otherwise((k % 50).cast("string")).alias("sometimes_double"),
                    F.when(k % 1000 == 7, "3000000000").otherwise((k % 50).cast("string")).alias("sometimes_long"),
                    F.when(k % 1000 == 7, "n/a").otherwise((k % 50).cast("string")).alias("sometimes_text"),
                    F.when(k % 2 == 0, "1.5").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("number_or_day"),
                    F.lit(None).cast("string").alias("nothing"))


def _kind_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 0 WHEN regexp_matches({c}, '^[+-]?[0-9]+$') THEN "
            f"CASE WHEN TRY_CAST({c} AS INTEGER) IS NOT NULL THEN 1 ELSE 2 END WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 4 "
            f"WHEN TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 8 ELSE 16 END")


_CSV_COLS = ["order_id", "day", "o_orderpriority", "sometimes_double", "sometimes_long", "sometimes_text", "number_or_day", "nothing"]


@query("src_csv_inferred", [], """
WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, o_orderpriority,
  CASE WHEN o_orderkey % 1000 = 7 THEN '12.5' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS sometimes_double,
  CASE WHEN o_orderkey % 1000 = 7 THEN '3000000000' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS sometimes_long,
  CASE WHEN o_orderkey % 1000 = 7 THEN 'n/a' ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS sometimes_text,
  CASE WHEN o_orderkey % 2 = 0 THEN '1.5' ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS number_or_day,
  CAST(NULL AS VARCHAR) AS nothing FROM orders),
k AS (""" + "\nUNION ALL\n".join(f"SELECT '{c}' AS name, {i} AS position, bit_or({_kind_sql(c)}) AS k, count({c}) AS n_values, count(*) AS n_rows FROM t"
                                 for i, c in enumerate(_CSV_COLS, start=1)) + """)
SELECT name, CAST(position AS INTEGER) AS position, CASE WHEN k = 0 THEN 'string' WHEN k = 8 THEN 'timestamp' WHEN k >= 8 THEN 'string'
       WHEN k >= 4 THEN 'double' WHEN k >= 2 THEN 'long' ELSE 'int' END AS type, n_values, n_rows FROM k""")
def src_csv_inferred(spark: SparkSession, d: str) -> DataFrame:
    """A1: the types of a headed CSV inferred from all of its rows, with the values that each column then holds."""
    path = scratch_path(spark, "orders-csv")
    text = _csv_orders(spark, d)
    write_table(text, path, "csv")
    rows, types, _ = read_csv_inferred(spark, path, text.columns)
    counts = rows.agg(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(i).alias("position"), F.lit(t).alias("type"),
                                         F.count(c).alias("n_values"), F.count(F.lit(1)).alias("n_rows"))
                                for i, (c, t) in enumerate(types.items(), start=1)]).alias("a"))
    return counts.select(F.explode("a").alias("r")).select("r.*")


@query("src_delimited", ["rounds"], "SELECT * FROM rounds")
def src_delimited(spark: SparkSession, d: str) -> DataFrame:
    """A2: headerless tab-separated text -> named, typed columns."""
    r = S.rounds(spark, d)
    path = scratch_path(spark, "rounds-tsv")
    r.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)
    raw = spark.read.option("sep", "\t").option("header", False).schema(
        "c0 string, c1 long, c2 string, c3 double").csv(path)
    return with_header(raw, r.columns)


@query("src_null_sentinels", ["companies"], """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE category_list IS NULL) AS null_category,
       count(*) FILTER (WHERE status IS NULL) AS null_status
FROM (SELECT CASE WHEN category_list IS NULL THEN NULL ELSE category_list END AS category_list,
             CASE WHEN country_code = 'PERU' THEN NULL ELSE status END AS status FROM companies)""")
def src_null_sentinels(spark: SparkSession, d: str) -> DataFrame:
    """A3: a CSV whose missing values are spelled "" or "NA" -> NULLs."""
    from kestrel.sources.io import null_sentinels
    c = S.companies(spark, d).select(
        F.coalesce("category_list", F.lit("NA")).alias("category_list"),
        F.when(F.col("country_code") == "PERU", "").otherwise(F.col("status")).alias("status"))
    path = scratch_path(spark, "companies-na")
    write_table(c, path, "csv")
    back = null_sentinels(read_csv(spark, path, schema="category_list string, status string"), ("", "NA"))
    return back.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(F.col("category_list").isNull()).alias("null_category"),
                    F.count_if(F.col("status").isNull()).alias("null_status"))


# ---------------------------------------------------------------- keys/joins
@query("count_distinct_ci", ["companies", "rounds"], """
SELECT (SELECT count(DISTINCT lower(permalink)) FROM companies) AS n_companies,
       (SELECT count(DISTINCT lower(company_permalink)) FROM rounds) AS n_round_companies,
       (SELECT count(DISTINCT company_permalink) FROM rounds) AS n_round_companies_cs""")
def count_distinct_ci(spark: SparkSession, d: str) -> DataFrame:
    """Unique companies, case-insensitive, on both sides."""
    c = check_unique_key(S.companies(spark, d), "permalink", True).select(F.col("n_distinct").alias("n_companies"))
    r = S.rounds(spark, d)
    return c.select("n_companies",
                    r.agg(F.countDistinct(F.lower("company_permalink"))).scalar().alias("n_round_companies"),
                    r.agg(F.countDistinct("company_permalink")).scalar().alias("n_round_companies_cs"))


@query("containment_check", ["companies", "rounds"], """
SELECT count(*) FILTER (WHERE lower(company_permalink) IN (SELECT lower(permalink) FROM companies)) AS n_matched,
       count(*) AS n_total FROM rounds""")
def containment_check(spark: SparkSession, d: str) -> DataFrame:
    """Are all round companies present in the company table?"""
    r = S.rounds(spark, d).withColumn("k", F.lower("company_permalink"))
    c = S.companies(spark, d).select(F.lower("permalink").alias("k"))
    return semi_join_count(r, c, "k")


@query("key_set_difference", ["companies", "rounds"], f"""
SELECT lower(permalink) AS k FROM companies
EXCEPT SELECT lower(company_permalink) FROM rounds WHERE funding_round_type = '{ROUND_TYPE}'""")
def key_set_difference_q(spark: SparkSession, d: str) -> DataFrame:
    """Companies with no round of the chosen type (setdiff of keys)."""
    c = S.companies(spark, d).select(F.lower("permalink").alias("k"))
    r = S.rounds(spark, d).filter(F.col("funding_round_type") == ROUND_TYPE).select(
        F.lower("company_permalink").alias("k"))
    return key_set_difference(c, r, "k")


def master(spark: SparkSession, d: str) -> DataFrame:
    """Rounds joined to companies on the case-folded key."""
    c = S.companies(spark, d).withColumn("k", F.lower("permalink"))
    r = S.rounds(spark, d).withColumn("k", F.lower("company_permalink"))
    return r.join(c, "k", "inner").drop("k")


MASTER_SQL = """master AS (
  SELECT r.*, c.* FROM rounds r JOIN companies c ON lower(r.company_permalink) = lower(c.permalink))"""


@query("join_inner", ["companies", "rounds"], MASTER_SQL + """
SELECT permalink, funding_round_permalink, funding_round_type, raised_amount_usd, country_code FROM master""")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    """Funding rounds joined to their companies (case-folded key)."""
    m = master(spark, d)
    return m.select("permalink", "funding_round_permalink", "funding_round_type", "raised_amount_usd", "country_code")


@query("case_fold_join", ["companies", "rounds"], """
SELECT count(*) AS n_exact_matches,
       (SELECT count(*) FROM rounds r JOIN companies c ON lower(r.company_permalink) = lower(c.permalink)) AS n_folded_matches
FROM rounds r JOIN companies c ON r.company_permalink = c.permalink""")
def case_fold_join(spark: SparkSession, d: str) -> DataFrame:
    """The keys differ only in case; joining raw keys finds nothing."""
    c = S.companies(spark, d)
    r = S.rounds(spark, d)
    exact = r.join(c, r.company_permalink == c.permalink).agg(F.count(F.lit(1)).alias("n_exact_matches"))
    return exact.select("n_exact_matches",
                        master(spark, d).agg(F.count(F.lit(1))).scalar().alias("n_folded_matches"))


# ------------------------------------------------------------- aggregates
def _avg2(c: str):
    """Mean of 2-decimal money values as (exact 2-dp sum) / n."""
    return F.round(F.sum(c), 2) / F.count(c)


@query("mean_by_category", ["companies", "rounds"], MASTER_SQL + """
SELECT funding_round_type, round(sum(raised_amount_usd), 2) / count(raised_amount_usd) AS mean_raised,
       count(raised_amount_usd) AS n_rounds FROM master GROUP BY 1""")
def mean_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Mean amount per round type in one grouped pass."""
    return master(spark, d).groupBy("funding_round_type").agg(
        _avg2("raised_amount_usd").alias("mean_raised"), F.count("raised_amount_usd").alias("n_rounds"))


@query("having_mean_range", ["companies", "rounds"], MASTER_SQL + f"""
SELECT funding_round_type, avg(raised_amount_usd) BETWEEN {MEAN_BAND[0]} AND {MEAN_BAND[1]} AS in_band
FROM master GROUP BY 1 HAVING avg(raised_amount_usd) BETWEEN {MEAN_BAND[0]} AND {MEAN_BAND[1]}""")
def having_mean_range(spark: SparkSession, d: str) -> DataFrame:
    """Round types whose mean amount lies in the preferred band."""
    m = mean_range_filter(master(spark, d), "funding_round_type", "raised_amount_usd", *MEAN_BAND)
    return m.select("funding_round_type", F.lit(True).alias("in_band"))


def _country_totals(spark, d):
    m = master(spark, d).filter(F.col("funding_round_type") == ROUND_TYPE)
    return null_dropping_group_sum(m, "country_code", "raised_amount_usd", "total_raised")


@query("group_sum", ["companies", "rounds"], MASTER_SQL + f"""
SELECT country_code, round(sum(raised_amount_usd), 2) AS total_raised FROM master
WHERE funding_round_type = '{ROUND_TYPE}' AND country_code IS NOT NULL AND raised_amount_usd IS NOT NULL
GROUP BY 1""")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    """Total per country for the chosen round type (NA rows dropped)."""
    return _country_totals(spark, d).withColumn("total_raised", F.round("total_raised", 2))


@query("top9_total", ["companies", "rounds"], MASTER_SQL + f"""
SELECT country_code, round(sum(raised_amount_usd), 2) AS total_raised FROM master
WHERE funding_round_type = '{ROUND_TYPE}' AND country_code IS NOT NULL AND raised_amount_usd IS NOT NULL
GROUP BY 1 ORDER BY total_raised DESC, country_code LIMIT {TOP_COUNTRIES}""")
def top9_total(spark: SparkSession, d: str) -> DataFrame:
    """Top-9 countries (sort + limit -> TakeOrderedAndProject)."""
    t = _country_totals(spark, d).withColumn("total_raised", F.round("total_raised", 2))
    return t.orderBy(F.desc("total_raised"), "country_code").limit(TOP_COUNTRIES)


# --------------------------------------------------------- sector mapping
def repaired_mapping(spark: SparkSession, d: str) -> DataFrame:
    m = S.sector_mapping(spark, d)
    return m.withColumn("category_list", repair_corrupt_text(F.col("category_list")))


@query("repair_corrupt_text", ["sector_mapping"], """
SELECT category_list AS raw_category,
       CAST(length(category_list) - length(replace(category_list, '0', '')) AS INTEGER) AS n_zeros,
       regexp_replace(replace(category_list, '0', 'na'), '^Enterprise 2\\.na$', 'Enterprise 2.0') AS category_list
FROM sector_mapping""")
def repair_corrupt_text_q(spark: SparkSession, d: str) -> DataFrame:
    """Count the corrupting '0's, replace all, re-fix the one true '0'."""
    m = S.sector_mapping(spark, d)
    return m.select(F.col("category_list").alias("raw_category"),
                    count_occurrences(F.col("category_list"), "0").alias("n_zeros"),
                    repair_corrupt_text(F.col("category_list")).alias("category_list"))


def long_mapping(spark: SparkSession, d: str) -> DataFrame:
    return unpivot_nonzero(repaired_mapping(spark, d), ["category_list"], S.SECTORS, "main_sector", "my_val").drop("my_val")


LONG_MAPPING_SQL = f"""long_mapping AS (
  SELECT regexp_replace(replace(category_list, '0', 'na'), '^Enterprise 2\\.na$', 'Enterprise 2.0') AS category_list,
         main_sector
  FROM (UNPIVOT sector_mapping ON {SECTOR_COLS_SQL} INTO NAME main_sector VALUE my_val) WHERE my_val <> 0)"""


@query("unpivot_onehot", ["sector_mapping"], LONG_MAPPING_SQL + "\nSELECT * FROM long_mapping")
def unpivot_onehot(spark: SparkSession, d: str) -> DataFrame:
    """H4: wide one-hot mapping -> (category, main_sector) rows."""
    return long_mapping(spark, d)


@query("first_token", ["companies"], """
SELECT permalink, CASE WHEN category_list IS NULL THEN NULL ELSE string_split(category_list, '|')[1] END AS primary_sector
FROM companies""")
def first_token_q(spark: SparkSession, d: str) -> DataFrame:
    """Primary sector = first '|'-separated category."""
    return S.companies(spark, d).select("permalink", first_token("category_list").alias("primary_sector"))


def sectors(spark: SparkSession, d: str) -> DataFrame:
    """Master rows + primary sector + main sector (left join on the lower-
    cased category; the join's strategy is left to the size checks)."""
    m = master(spark, d).withColumn("primary_sector", first_token("category_list"))
    lm = long_mapping(spark, d).select(F.lower("category_list").alias("ps"), "main_sector")
    return m.join(lm, F.lower(m.primary_sector) == lm.ps, "left").drop("ps")


SECTORS_SQL = MASTER_SQL + ",\n" + LONG_MAPPING_SQL + """,
sectors AS (
  SELECT m.*, lm.main_sector FROM
    (SELECT *, CASE WHEN category_list IS NULL THEN NULL ELSE string_split(category_list, '|')[1] END AS primary_sector
     FROM master) m
  LEFT JOIN long_mapping lm ON lower(m.primary_sector) = lower(lm.category_list))"""


@query("join_left", ["companies", "rounds", "sector_mapping"], SECTORS_SQL + """
SELECT main_sector, count(*) AS n_rounds, count(primary_sector) AS n_with_category FROM sectors GROUP BY 1""")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    """D3: left join keeps rounds without a category (main_sector NULL)."""
    s = sectors(spark, d)
    return s.groupBy("main_sector").agg(F.count(F.lit(1)).alias("n_rounds"),
                                        F.count("primary_sector").alias("n_with_category"))


@query("drop_null_rows", ["companies", "rounds", "sector_mapping"], SECTORS_SQL + """
SELECT count(*) AS n_complete FROM sectors WHERE permalink IS NOT NULL AND funding_round_permalink IS NOT NULL
  AND funding_round_type IS NOT NULL AND raised_amount_usd IS NOT NULL AND country_code IS NOT NULL
  AND category_list IS NOT NULL AND main_sector IS NOT NULL AND primary_sector IS NOT NULL""")
def drop_null_rows(spark: SparkSession, d: str) -> DataFrame:
    """Na.omit over the analysed columns."""
    s = sectors(spark, d).select("permalink", "funding_round_permalink", "funding_round_type", "raised_amount_usd",
                                 "country_code", "category_list", "main_sector", "primary_sector")
    return s.dropna("any").agg(F.count(F.lit(1)).alias("n_complete"))


def _top3_countries(spark, d):
    t = _country_totals(spark, d)
    return t.orderBy(F.desc("total_raised"), "country_code").limit(3).select("country_code")


_CLEAN_SECTORS_SQL = SECTORS_SQL + f""",
top3 AS (SELECT country_code FROM master WHERE funding_round_type = '{ROUND_TYPE}' AND country_code IS NOT NULL
         AND raised_amount_usd IS NOT NULL GROUP BY 1 ORDER BY sum(raised_amount_usd) DESC, country_code LIMIT 3),
focus AS (SELECT * FROM sectors WHERE funding_round_type = '{ROUND_TYPE}' AND main_sector IS NOT NULL
          AND raised_amount_usd IS NOT NULL AND country_code IN (SELECT country_code FROM top3))"""


def _focus(spark, d):
    s = sectors(spark, d).filter((F.col("funding_round_type") == ROUND_TYPE) & F.col("main_sector").isNotNull()
                                 & F.col("raised_amount_usd").isNotNull())
    return s.join(F.broadcast(_top3_countries(spark, d)), "country_code", "left_semi")


@query("group_count_sum", ["companies", "rounds", "sector_mapping"], _CLEAN_SECTORS_SQL + """
SELECT country_code, main_sector, count(*) AS investment_count, round(sum(raised_amount_usd), 2) AS total_investment
FROM focus GROUP BY ALL""")
def group_count_sum(spark: SparkSession, d: str) -> DataFrame:
    """Count and sum per (country, main sector) for the top-3 countries."""
    return _focus(spark, d).groupBy("country_code", "main_sector").agg(
        F.count(F.lit(1)).alias("investment_count"), F.round(F.sum("raised_amount_usd"), 2).alias("total_investment"))


@query("grand_totals", ["companies", "rounds", "sector_mapping"], _CLEAN_SECTORS_SQL + """
SELECT country_code, count(*) AS investment_count, round(sum(raised_amount_usd), 2) AS total_investment
FROM focus GROUP BY ALL""")
def grand_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per-country totals in one pass (not a re-sum of three frames)."""
    return _focus(spark, d).groupBy("country_code").agg(
        F.count(F.lit(1)).alias("investment_count"), F.round(F.sum("raised_amount_usd"), 2).alias("total_investment"))


@query("join_back_aggregate", ["companies", "rounds", "sector_mapping"], _CLEAN_SECTORS_SQL + """
SELECT f.funding_round_permalink, f.country_code, f.main_sector, a.sector_count, a.sector_total
FROM focus f JOIN (SELECT country_code, main_sector, count(*) AS sector_count,
                          round(sum(raised_amount_usd), 2) AS sector_total FROM focus GROUP BY ALL) a
  USING (country_code, main_sector)""")
def join_back_aggregate_q(spark: SparkSession, d: str) -> DataFrame:
    """Sector count/total attached to every round row."""
    from kestrel.operators.relational import join_back_aggregate
    f = _focus(spark, d)
    j = join_back_aggregate(f, ["country_code", "main_sector"],
                            [F.count(F.lit(1)).alias("sector_count"),
                             F.round(F.sum("raised_amount_usd"), 2).alias("sector_total")])
    return j.select("funding_round_permalink", "country_code", "main_sector", "sector_count", "sector_total")


@query("top_company_in_nth_sector", ["companies", "rounds", "sector_mapping"], _CLEAN_SECTORS_SQL + """,
sec AS (SELECT country_code, main_sector, count(*) AS n FROM focus GROUP BY ALL),
sec_r AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY n DESC, main_sector) AS sector_rank FROM sec),
comp AS (SELECT country_code, main_sector, permalink, round(sum(raised_amount_usd), 2) AS company_total
         FROM focus GROUP BY ALL),
comp_r AS (SELECT c.*, s.sector_rank,
             row_number() OVER (PARTITION BY c.country_code, c.main_sector ORDER BY company_total DESC, permalink) AS rn
           FROM comp c JOIN sec_r s USING (country_code, main_sector) WHERE s.sector_rank <= 3)
SELECT country_code, CAST(sector_rank AS INTEGER) AS sector_rank, main_sector, permalink, company_total
FROM comp_r WHERE rn = 1""")
def top_company_in_nth_sector(spark: SparkSession, d: str) -> DataFrame:
    """Per country, rank sectors by round count; for sectors 1-3 the
    company with the largest total.  Both rankings are windows over
    aggregated rows, partitioned by country / (country, sector)."""
    f = _focus(spark, d)
    sec = f.groupBy("country_code", "main_sector").agg(F.count(F.lit(1)).alias("n"))
    sec_r = top_k_per_group(sec, ["country_code"], [F.desc("n"), "main_sector"], 3, "row_number", "sector_rank")
    comp = f.groupBy("country_code", "main_sector", "permalink").agg(
        F.round(F.sum("raised_amount_usd"), 2).alias("company_total"))
    j = comp.join(sec_r.drop("n"), ["country_code", "main_sector"])
    best = top_k_per_group(j, ["country_code", "main_sector"], [F.desc("company_total"), "permalink"], 1,
                           "row_number", "rn")
    return best.select("country_code", "sector_rank", "main_sector", "permalink", "company_total")
