"""Parking-ticket analysis: cleaning chain + SQL-style reports (Spark SQL
case study).  Stand-in input: `tickets` / `season_tickets` (standins.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.columns import (HOUR_BINS, any_of, bin_by_ranges, compact_time_to_timestamp,
                                       normalize_column_names, parse_date, season_of_month, string_columns)
from kestrel.operators.ordered import global_rank
from kestrel.operators.relational import dedup_key, group_count, top_k_per_group
from kestrel.plans import standins as S
from kestrel.plans.registry import query

# The window of the two queries about a date range (filter, out-of-range count).
FISCAL = ("2024-01-02", "2024-01-28")


def clean_tickets(raw: DataFrame, window: tuple[str, str] | None = None) -> DataFrame:
    """Normalise names, dedup on the ticket key, parse the issue date, keep
    those inside `window` (all by default), derive year/month and the
    violation timestamp."""
    df = normalize_column_names(raw)
    df = dedup_key(df, ["summons_number"])
    df = df.withColumn("issue_date", parse_date(F.col("issue_date"), "MM/dd/yyyy"))
    if window is not None:
        df = df.filter(F.col("issue_date").between(*[F.to_date(F.lit(x)) for x in window]))
    df = df.withColumn("issue_yr", F.year("issue_date")).withColumn("issue_mnth", F.month("issue_date"))
    if "violation_time" in df.columns:
        df = df.withColumn("violation_ts", compact_time_to_timestamp(F.col("issue_date"), F.col("violation_time")))
    return df


def _order_all(cols: list[str]) -> str:
    return ", ".join(f"{c} ASC NULLS FIRST" for c in cols)


_T_COLS = ["plate_id", "registration_state", "issue_date", "violation_code", "vehicle_body_type",
           "vehicle_make", "violation_precinct", "issuer_precinct", "violation_time"]

CLEAN_SQL = f"""clean_tickets AS (
  SELECT *, CAST(year(issue_date) AS INTEGER) AS issue_yr, CAST(month(issue_date) AS INTEGER) AS issue_mnth,
    try_strptime(strftime(issue_date, '%Y-%m-%d') || ' ' || concat_ws(':',
        regexp_replace(substr(violation_time, 1, 2), '00', '12', 'g'), substr(violation_time, 3, 2),
        regexp_replace(regexp_replace(substr(violation_time, 5, 1), 'A', 'AM', 'g'), 'P', 'PM', 'g')),
      '%Y-%m-%d %I:%M:%p') AS violation_ts
  FROM (SELECT * REPLACE (CAST(try_strptime(issue_date, '%m/%d/%Y') AS DATE) AS issue_date) FROM tickets
        QUALIFY row_number() OVER (PARTITION BY summons_number ORDER BY {_order_all(_T_COLS)}) = 1))"""

SEASON_CLEAN_SQL = """clean_season AS (
  SELECT *, CAST(year(issue_date) AS INTEGER) AS issue_yr, CAST(month(issue_date) AS INTEGER) AS issue_mnth
  FROM (SELECT * REPLACE (CAST(try_strptime(issue_date, '%m/%d/%Y') AS DATE) AS issue_date) FROM season_tickets
        QUALIFY row_number() OVER (PARTITION BY summons_number ORDER BY issue_date, violation_code) = 1))"""


def _hour_bin_sql(h: str) -> str:
    return "CASE " + " ".join(f"WHEN {h} BETWEEN {lo} AND {hi} THEN '{lab}'" for lo, hi, lab in HOUR_BINS) + " END"


def _clean(spark, d):
    return clean_tickets(S.tickets(spark, d))


# ----------------------------------------------------------------- flagship
@query("top3_per_time_bin", ["tickets"], CLEAN_SQL + f""",
counted AS (
  SELECT {_hour_bin_sql('hour(violation_ts)')} AS violation_hour_bin, violation_code, count(*) AS frequency_of_tickets
  FROM clean_tickets WHERE violation_ts IS NOT NULL GROUP BY ALL)
SELECT violation_hour_bin, violation_code, frequency_of_tickets,
       CAST(dense_rank() OVER (PARTITION BY violation_hour_bin ORDER BY frequency_of_tickets DESC) AS INTEGER) AS rnk
FROM counted QUALIFY rnk <= 3""")
def top3_per_time_bin(spark: SparkSession, d: str) -> DataFrame:
    """Six 4-hour bins of the (24-hour) violation
    time; the 3 most frequent violation codes per bin, ties kept (dense_rank)."""
    t = _clean(spark, d).filter(F.col("violation_ts").isNotNull())
    binned = t.select(bin_by_ranges(F.hour("violation_ts"), HOUR_BINS).alias("violation_hour_bin"), "violation_code")
    counted = group_count(binned, ["violation_hour_bin", "violation_code"], "frequency_of_tickets")
    return top_k_per_group(counted, ["violation_hour_bin"], [F.desc("frequency_of_tickets")], 3)


@query("bin_hour_of_day", ["tickets"], CLEAN_SQL + f""",
b AS (SELECT {_hour_bin_sql('hour(violation_ts)')} AS violation_hour_bin,
        {_hour_bin_sql("TRY_CAST(TRY_CAST(regexp_replace(substr(violation_time, 1, 2), '00', '12', 'g') AS DOUBLE) AS INTEGER)")} AS clock_hour_bin
      FROM clean_tickets)
SELECT violation_hour_bin, clock_hour_bin, count(*) AS n_tickets FROM b GROUP BY ALL""")
def bin_hour_of_day(spark: SparkSession, d: str) -> DataFrame:
    """Bin by the parsed 24-hour time (intended) and, for comparison, by
    the raw 12-hour clock digits (what a plain string bin would give)."""
    t = _clean(spark, d)
    clock = F.regexp_replace(F.substring("violation_time", 1, 2), "00", "12").try_cast("double").try_cast("int")
    b = t.select(bin_by_ranges(F.hour("violation_ts"), HOUR_BINS).alias("violation_hour_bin"),
                 bin_by_ranges(clock, HOUR_BINS).alias("clock_hour_bin"))
    return group_count(b, ["violation_hour_bin", "clock_hour_bin"], "n_tickets")


def _season_clean(spark, d):
    return clean_tickets(S.season_tickets(spark, d))


_SEASON_SQL = ("CASE WHEN issue_mnth IN (12, 1, 2) THEN 'WINTER' WHEN issue_mnth IN (3, 4, 5) THEN 'SPRING' "
               "WHEN issue_mnth IN (6, 7, 8) THEN 'SUMMER' WHEN issue_mnth IN (9, 10, 11) THEN 'FALL' END")


@query("bin_season", ["season_tickets"], SEASON_CLEAN_SQL + f"""
SELECT {_SEASON_SQL} AS season, count(*) AS n_tickets FROM clean_season GROUP BY ALL""")
def bin_season(spark: SparkSession, d: str) -> DataFrame:
    """Season of the issue month (CASE over month numbers), ticket counts."""
    t = _season_clean(spark, d)
    return group_count(t.select(season_of_month(F.col("issue_mnth")).alias("season")), ["season"], "n_tickets")


@query("top3_per_season", ["season_tickets"], SEASON_CLEAN_SQL + f""",
c AS (SELECT {_SEASON_SQL} AS season, violation_code, count(*) AS n_tickets FROM clean_season GROUP BY ALL)
SELECT season, violation_code, n_tickets,
       CAST(dense_rank() OVER (PARTITION BY season ORDER BY n_tickets DESC) AS INTEGER) AS rnk
FROM c QUALIFY rnk <= 3""")
def top3_per_season(spark: SparkSession, d: str) -> DataFrame:
    """the four per-season top-3 queries as one grouped pass."""
    t = _season_clean(spark, d).select(season_of_month(F.col("issue_mnth")).alias("season"), "violation_code")
    c = group_count(t, ["season", "violation_code"], "n_tickets")
    return top_k_per_group(c, ["season"], [F.desc("n_tickets")], 3)


# ----------------------------------------------------------- data quality
@query("normalize_columns", ["tickets"], """
SELECT summons_number AS summons_number, plate_id AS plate_id, registration_state AS registration_state,
       issue_date AS issue_date, violation_code AS violation_code FROM tickets""")
def normalize_columns(spark: SparkSession, d: str) -> DataFrame:
    """Raw headers like ' Summons Number ' -> summons_number."""
    raw = S.tickets(spark, d).select(
        F.col("summons_number").alias(" Summons Number "), F.col("plate_id").alias("Plate ID"),
        F.col("registration_state").alias("Registration State"), F.col("issue_date").alias("Issue Date "),
        F.col("violation_code").alias("Violation Code"))
    return normalize_column_names(raw)


@query("dedup_key", [], """
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY
  l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1""")
def dedup_key_q(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem has repeated (orderkey, linenumber) pairs; keep one
    full row per pair (all columns), deterministically."""
    from kestrel.sources.io import read_table
    return dedup_key(read_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("sql_view_count", ["tickets"], CLEAN_SQL + """
SELECT violation_code, count(*) AS num_of_records FROM clean_tickets GROUP BY violation_code""")
def sql_view_count(spark: SparkSession, d: str) -> DataFrame:
    """Name the cleaned plan as a view and run SQL text on it."""
    view = f"tickets_clean_{abs(hash(d)) % 10**8}"
    _clean(spark, d).createOrReplaceTempView(view)
    return spark.sql(f"SELECT violation_code, count(*) AS num_of_records FROM {view} GROUP BY violation_code")


@query("dq_nonempty_rows", ["tickets"], f"""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE {' OR '.join(f"(CAST({c} AS VARCHAR) IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '')" for c in _T_COLS)}) AS n_nonempty_rows,
       count(*) FILTER (WHERE {' OR '.join(f"(CAST({c} AS VARCHAR) IS NULL OR trim(CAST({c} AS VARCHAR)) = '')" for c in _T_COLS)}) AS n_rows_with_missing
FROM tickets""")
def dq_nonempty_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with any non-empty column, and (what the check intends) rows
    with any missing/empty column."""
    t = S.tickets(spark, d)
    cols = [c for c in t.columns if c != "summons_number"]
    filled = [F.col(c).cast("string").isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in cols]
    missing = [F.col(c).cast("string").isNull() | (F.trim(F.col(c).cast("string")) == "") for c in cols]
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_of(filled)).alias("n_nonempty_rows"),
                 F.count_if(any_of(missing)).alias("n_rows_with_missing"))


_STR_COLS = ["plate_id", "registration_state", "issue_date", "violation_code", "vehicle_body_type",
             "vehicle_make", "violation_time"]


@query("dq_sentinel_rows", ["tickets"], """
SELECT s.sentinel, count(*) FILTER (WHERE """ + " OR ".join(f"t.{c} = s.sentinel" for c in _STR_COLS) + """) AS n_rows
FROM tickets t, (VALUES ('NA'), ('N/A')) s(sentinel) GROUP BY s.sentinel""")
def dq_sentinel_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows holding a sentinel string ('NA', 'N/A') in any text column;
    one scan, one conditional count per sentinel."""
    t = S.tickets(spark, d)
    cols = string_columns(t)
    aggs = [F.count_if(any_of([F.col(c) == s for c in cols])).alias(s) for s in ("NA", "N/A")]
    return t.agg(*aggs).unpivot([], ["NA", "N/A"], "sentinel", "n_rows")


@query("dq_unparsed_timestamps", ["tickets"], CLEAN_SQL + """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE violation_ts IS NULL) AS n_unparsed FROM clean_tickets""")
def dq_unparsed_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps that failed to parse after cleaning."""
    t = _clean(spark, d)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("violation_ts").isNull()).alias("n_unparsed"))


@query("date_range", ["tickets"], """
SELECT strftime(min(d), '%Y-%m-%d') AS first_issue_date, strftime(max(d), '%Y-%m-%d') AS last_issue_date
FROM (SELECT CAST(try_strptime(issue_date, '%m/%d/%Y') AS DATE) AS d FROM tickets)""")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    """First and last parsed issue date."""
    t = S.tickets(spark, d).select(parse_date(F.col("issue_date"), "MM/dd/yyyy").alias("d"))
    return t.agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("first_issue_date"),
                 F.date_format(F.max("d"), "yyyy-MM-dd").alias("last_issue_date"))


@query("dq_out_of_range", ["tickets"], f"""
SELECT count(*) FILTER (WHERE d > DATE '{FISCAL[1]}' OR d < DATE '{FISCAL[0]}') AS n_out_of_range, count(*) AS n_rows
FROM (SELECT CAST(try_strptime(issue_date, '%m/%d/%Y') AS DATE) AS d FROM tickets)""")
def dq_out_of_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows outside the analysed window."""
    t = S.tickets(spark, d).select(parse_date(F.col("issue_date"), "MM/dd/yyyy").alias("d"))
    lo, hi = F.to_date(F.lit(FISCAL[0])), F.to_date(F.lit(FISCAL[1]))
    return t.agg(F.count_if((F.col("d") > hi) | (F.col("d") < lo)).alias("n_out_of_range"),
                 F.count(F.lit(1)).alias("n_rows"))


@query("filter_range", ["tickets"], CLEAN_SQL + f"""
SELECT summons_number, strftime(issue_date, '%Y-%m-%d') AS issue_date, violation_code FROM clean_tickets
WHERE issue_date BETWEEN DATE '{FISCAL[0]}' AND DATE '{FISCAL[1]}'""")
def filter_range(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned tickets inside the window (the date is text, so it is
    filtered after parsing; nothing is pushed to the scan)."""
    t = clean_tickets(S.tickets(spark, d), FISCAL)
    return t.select("summons_number", F.date_format("issue_date", "yyyy-MM-dd").alias("issue_date"), "violation_code")


@query("group_count_multikey", ["season_tickets"], SEASON_CLEAN_SQL + """
SELECT issue_yr, issue_mnth, count(*) AS num_of_records FROM clean_season GROUP BY ALL""")
def group_count_multikey(spark: SparkSession, d: str) -> DataFrame:
    """Tickets per (year, month)."""
    return group_count(_season_clean(spark, d), ["issue_yr", "issue_mnth"], "num_of_records")


def _states(spark, d):
    t = _clean(spark, d)
    return t.withColumn("registration_state", F.regexp_replace("registration_state", "^99$", "NY"))


@query("group_count_ranked", ["tickets"], CLEAN_SQL + """
SELECT regexp_replace(registration_state, '^99$', 'NY') AS registration_state, count(*) AS num_of_tickets,
       CAST(row_number() OVER (ORDER BY count(*) DESC, regexp_replace(registration_state, '^99$', 'NY')) AS INTEGER) AS position
FROM clean_tickets GROUP BY 1""")
def group_count_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Frequency ranking of registration states after recoding the
    invalid '99' to the dominant state; a distributed rank of the aggregated
    rows (one per state)."""
    g = group_count(_states(spark, d), ["registration_state"], "num_of_tickets")
    r = global_rank(g, [F.desc("num_of_tickets"), "registration_state"], name="position")
    return r.withColumn("position", F.col("position").cast("int"))


@query("count_distinct", ["tickets"], CLEAN_SQL + """
SELECT count(DISTINCT regexp_replace(registration_state, '^99$', 'NY')) AS n_states,
       count(DISTINCT registration_state) AS n_states_raw FROM clean_tickets""")
def count_distinct(spark: SparkSession, d: str) -> DataFrame:
    """E5: unique states (after and before the recode)."""
    t = _clean(spark, d)
    return t.agg(F.countDistinct(F.regexp_replace("registration_state", "^99$", "NY")).alias("n_states"),
                 F.countDistinct("registration_state").alias("n_states_raw"))


@query("filter_in_list", ["tickets"], CLEAN_SQL + """
SELECT issuer_precinct, violation_code, count(*) AS n_tickets FROM clean_tickets
WHERE issuer_precinct IN (0, 1, 4, 9) GROUP BY ALL""")
def filter_in_list(spark: SparkSession, d: str) -> DataFrame:
    """IN-list filter then (precinct, code) counts."""
    t = _clean(spark, d).filter(F.col("issuer_precinct").isin(0, 1, 4, 9))
    return group_count(t, ["issuer_precinct", "violation_code"], "n_tickets")


@query("filter_like", ["tickets"], """
SELECT substr(violation_time, 5, 1) AS am_pm, count(*) AS n_tickets FROM tickets
WHERE lower(violation_time) LIKE '%na%' OR violation_time IS NULL GROUP BY ALL""")
def filter_like(spark: SparkSession, d: str) -> DataFrame:
    """C4: LIKE filter for dirty compact times."""
    t = S.tickets(spark, d)
    t = t.filter(F.lower("violation_time").like("%na%") | F.col("violation_time").isNull())
    return group_count(t.select(F.substring("violation_time", 5, 1).alias("am_pm")), ["am_pm"], "n_tickets")


@query("parse_compact_time", ["tickets"], CLEAN_SQL + """
SELECT summons_number, violation_time, strftime(violation_ts, '%Y-%m-%d %H:%M:%S') AS violation_ts,
       CAST(hour(violation_ts) AS INTEGER) AS violation_hour FROM clean_tickets""")
def parse_compact_time(spark: SparkSession, d: str) -> DataFrame:
    """Compact 'hhmmA' time + issue date -> timestamp."""
    t = _clean(spark, d)
    return t.select("summons_number", "violation_time",
                    F.date_format("violation_ts", "yyyy-MM-dd HH:mm:ss").alias("violation_ts"),
                    F.hour("violation_ts").alias("violation_hour"))


# Fine amounts for the three most frequent codes, by rank.
FINE_BY_RANK = [(1, 55), (2, 50), (3, 50)]


@query("top3_revenue_estimate", ["tickets"], CLEAN_SQL + """,
c AS (SELECT violation_code, count(*) AS num_of_tickets FROM clean_tickets GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY num_of_tickets DESC, violation_code) AS INTEGER) AS rnk FROM c)
SELECT r.violation_code, r.num_of_tickets, r.rnk, f.fine, CAST(r.num_of_tickets * f.fine AS BIGINT) AS revenue
FROM r JOIN (VALUES """ + ", ".join(f"({a}, {b})" for a, b in FINE_BY_RANK) + """) f(rnk, fine) ON r.rnk = f.rnk""")
def top3_revenue_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Top-3 codes, fine by rank from a literal table, revenue."""
    from pyspark.sql import Window
    c = group_count(_clean(spark, d), ["violation_code"], "num_of_tickets")
    top = c.orderBy(F.desc("num_of_tickets"), "violation_code").limit(len(FINE_BY_RANK))
    r = top.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("num_of_tickets"), "violation_code")))
    fines = spark.createDataFrame(FINE_BY_RANK, "rnk int, fine int")
    return (r.join(F.broadcast(fines), "rnk")
            .select("violation_code", "num_of_tickets", "rnk", "fine",
                    (F.col("num_of_tickets") * F.col("fine")).cast("long").alias("revenue")))


@query("parse_dates", ["tickets"], """
SELECT summons_number, issue_date AS raw_issue_date,
       strftime(CAST(try_strptime(issue_date, '%m/%d/%Y') AS DATE), '%Y-%m-%d') AS issue_date FROM tickets""")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    """I8: 'MM/dd/yyyy' text -> DATE (shown ISO)."""
    t = S.tickets(spark, d)
    return t.select("summons_number", F.col("issue_date").alias("raw_issue_date"),
                    F.date_format(parse_date(F.col("issue_date"), "MM/dd/yyyy"), "yyyy-MM-dd").alias("issue_date"))


@query("date_parts", ["season_tickets"], SEASON_CLEAN_SQL + """
SELECT issue_yr, issue_mnth, strftime(issue_date, '%m-%y') AS month_label, count(*) AS n_tickets
FROM clean_season GROUP BY ALL""")
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    """Year, month and a 'MM-yy' label."""
    t = _season_clean(spark, d)
    return group_count(t.select("issue_yr", "issue_mnth", F.date_format("issue_date", "MM-yy").alias("month_label")),
                       ["issue_yr", "issue_mnth", "month_label"], "n_tickets")
