"""Ride-request analysis: multi-format timestamps, durations, demand by hour
and weekday, null handling.  Stand-in: `rides` (standins.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.columns import minutes_between, parse_timestamp_multi, split_columns
from kestrel.operators.quality import drop_all_null_columns, impute_mode, null_counts
from kestrel.operators.relational import group_count
from kestrel.plans import standins as S
from kestrel.plans.registry import query

FORMATS = ["dd/MM/yyyy H:mm", "dd-MM-yyyy HH:mm:ss"]
BIN_MINUTES = 5

PARSED_SQL = """parsed AS (
  SELECT *, coalesce(try_strptime(request_timestamp, '%d/%m/%Y %H:%M'),
                     try_strptime(request_timestamp, '%d-%m-%Y %H:%M:%S')) AS request_ts,
            coalesce(try_strptime(drop_timestamp, '%d/%m/%Y %H:%M'),
                     try_strptime(drop_timestamp, '%d-%m-%Y %H:%M:%S')) AS drop_ts
  FROM rides)"""


def parsed(spark: SparkSession, d: str) -> DataFrame:
    r = S.rides(spark, d)
    return (r.withColumn("request_ts", parse_timestamp_multi(F.col("request_timestamp"), FORMATS))
            .withColumn("drop_ts", parse_timestamp_multi(F.col("drop_timestamp"), FORMATS)))


@query("parse_multi_format", ["rides"], PARSED_SQL + """
SELECT request_id, strftime(request_ts, '%Y-%m-%d %H:%M:%S') AS request_ts,
       strftime(drop_ts, '%Y-%m-%d %H:%M:%S') AS drop_ts FROM parsed""")
def parse_multi_format(spark: SparkSession, d: str) -> DataFrame:
    """Two textual layouts in one column; first that parses wins."""
    p = parsed(spark, d)
    return p.select("request_id", F.date_format("request_ts", "yyyy-MM-dd HH:mm:ss").alias("request_ts"),
                    F.date_format("drop_ts", "yyyy-MM-dd HH:mm:ss").alias("drop_ts"))


@query("trip_duration", ["rides"], PARSED_SQL + """
SELECT request_id, pickup_point, (epoch_us(drop_ts) - epoch_us(request_ts)) / 6e7 AS duration_min FROM parsed""")
def trip_duration(spark: SparkSession, d: str) -> DataFrame:
    """Trip length in minutes (NULL when the trip has no drop time)."""
    p = parsed(spark, d)
    return p.select("request_id", "pickup_point", minutes_between(F.col("drop_ts"), F.col("request_ts")).alias("duration_min"))


@query("split_columns", ["rides"], """
SELECT request_id, string_split(request_timestamp, ' ')[1] AS request_date,
       string_split(request_timestamp, ' ')[2] AS request_time FROM rides""")
def split_columns_q(spark: SparkSession, d: str) -> DataFrame:
    """Separate 'date time' text into two columns."""
    r = S.rides(spark, d)
    return r.select("request_id", *split_columns("request_timestamp", ["request_date", "request_time"], " "))


@query("demand_by_hour_weekday", ["rides"], PARSED_SQL + """
SELECT pickup_point, strftime(request_ts, '%A') AS weekday, CAST(hour(request_ts) AS INTEGER) AS request_hour,
       count(*) AS n_requests FROM parsed GROUP BY ALL""")
def demand_by_hour_weekday(spark: SparkSession, d: str) -> DataFrame:
    """Requests per (pickup point, weekday name, hour) — the per-
    pickup-point subsets are one grouped pass keyed by pickup point."""
    p = parsed(spark, d).select("pickup_point", F.date_format("request_ts", "EEEE").alias("weekday"),
                                F.hour("request_ts").alias("request_hour"))
    return group_count(p, ["pickup_point", "weekday", "request_hour"], "n_requests")


@query("stacked_counts", ["rides"], PARSED_SQL + """
SELECT CAST(hour(request_ts) AS INTEGER) AS request_hour, status, count(*) AS n_requests FROM parsed GROUP BY ALL""")
def stacked_counts(spark: SparkSession, d: str) -> DataFrame:
    """Data behind a stacked bar chart (hour x status)."""
    p = parsed(spark, d).select(F.hour("request_ts").alias("request_hour"), "status")
    return group_count(p, ["request_hour", "status"], "n_requests")


@query("histogram_bins", ["rides"], PARSED_SQL + f"""
SELECT CAST(floor((epoch_us(drop_ts) - epoch_us(request_ts)) / 6e7 / {BIN_MINUTES}) * {BIN_MINUTES} AS BIGINT) AS bin_start,
       count(*) AS n_trips
FROM parsed WHERE drop_ts IS NOT NULL GROUP BY ALL""")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width histogram of trip minutes."""
    p = parsed(spark, d).filter(F.col("drop_ts").isNotNull())
    dur = minutes_between(F.col("drop_ts"), F.col("request_ts"))
    b = p.select((F.floor(dur / BIN_MINUTES) * BIN_MINUTES).cast("long").alias("bin_start"))
    return group_count(b, ["bin_start"], "n_trips")


@query("dq_null_counts", ["rides"], """
SELECT * FROM (SELECT count(*) FILTER (WHERE request_id IS NULL) AS request_id,
  count(*) FILTER (WHERE pickup_point IS NULL) AS pickup_point, count(*) FILTER (WHERE driver_id IS NULL) AS driver_id,
  count(*) FILTER (WHERE status IS NULL) AS status, count(*) FILTER (WHERE request_timestamp IS NULL) AS request_timestamp,
  count(*) FILTER (WHERE drop_timestamp IS NULL) AS drop_timestamp FROM rides)
UNPIVOT (n_null FOR "column" IN (request_id, pickup_point, driver_id, status, request_timestamp, drop_timestamp))""")
def dq_null_counts(spark: SparkSession, d: str) -> DataFrame:
    """NULLs per column, one scan."""
    return null_counts(S.rides(spark, d))


@query("impute_mode", ["rides"], """
SELECT request_id, coalesce(driver_id, (SELECT driver_id FROM rides WHERE driver_id IS NOT NULL
  GROUP BY driver_id ORDER BY count(*) DESC, driver_id LIMIT 1)) AS driver_id FROM rides""")
def impute_mode_q(spark: SparkSession, d: str) -> DataFrame:
    """Missing driver -> most frequent driver (ties: smallest id)."""
    return impute_mode(S.rides(spark, d).select("request_id", "driver_id"), "driver_id")


@query("fill_null_zero", ["rides"], PARSED_SQL + """
SELECT request_id, coalesce((epoch_us(drop_ts) - epoch_us(request_ts)) / 6e7, 0.0::DOUBLE) AS duration_min FROM parsed""")
def fill_null_zero(spark: SparkSession, d: str) -> DataFrame:
    """Missing duration -> 0."""
    p = parsed(spark, d)
    return (p.select("request_id", minutes_between(F.col("drop_ts"), F.col("request_ts")).alias("duration_min"))
            .fillna(0.0, subset=["duration_min"]))


@query("drop_all_null_columns", ["rides"], """
SELECT request_id, pickup_point, driver_id, status, request_timestamp, drop_timestamp FROM rides""")
def drop_all_null_columns_q(spark: SparkSession, d: str) -> DataFrame:
    """An all-NULL column (e.g. a holiday in an attendance sheet) is
    dropped; partially-null columns stay."""
    r = S.rides(spark, d).withColumn("holiday_2024_01_01", F.lit(None).cast("timestamp"))
    return drop_all_null_columns(r)
