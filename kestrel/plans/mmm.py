"""Marketing-mix analysis: order cleaning, calendars and month-to-week
proration of media spend, sale-event labels, weekly KPIs per product
category, lags / rolling means / adstock, price tiers, five model forms and
elasticities.  Stand-ins: `mmm_sales`, and monthly media and score sheets
(all years of orders).  Weeks are keyed by year and week number (YYYYWW)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.columns import (cap_upper, exact_mean, exact_sum, floor_invalid_to_zero, safe_log,
                                       week_of_year_simple, week_start_sunday)
from kestrel.operators.cluster import price_tiers
from kestrel.operators.ordered import adstock, lag_features, pct_change_vs_lag, trailing_mean
from kestrel.operators.quality import crosstab_counts, impute_moving_average
from kestrel.operators.relational import dedup_key, group_count
from kestrel.operators.stats import collinear_columns, zscore_columns
from kestrel.operators.sweep import model_sweep
from kestrel.plans import standins as S
from kestrel.plans.registry import query
from kestrel.plans.sqlfit import coefficient_ctes, residual_ctes, significant, significant_sql
from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.io import read_table, wide_months_to_long

KEY = "sub_category"
SLA_CAP = 17
ADSTOCK_RATE = 0.5
CHANNELS = ["TV", "Digital", "Sponsorship", "Content_Marketing", "Online_Marketing", "Affiliates", "SEM",
            "Radio", "Other"]

# The twelve sale events and their calendar days (month-day),
# held every year.
SALE_EVENTS = [
    ("Eid & Rathayatra", ["07-18", "07-19"]),
    ("Independence Day", ["08-15", "08-16", "08-17"]),
    ("Rakshabandhan", ["08-28", "08-29", "08-30"]),
    ("Daussera", ["10-15", "10-16", "10-17"]),
    ("Diwali", ["11-07", "11-08", "11-09", "11-10", "11-11", "11-12", "11-13", "11-14"]),
    ("Christmas & New Year", ["12-25", "12-26", "12-27", "12-28", "12-29", "12-30", "12-31", "01-01", "01-02", "01-03"]),
    ("Republic Day", ["01-20", "01-21", "01-22"]),
    ("BED", ["02-01", "02-02"]),
    ("Valentine Day", ["02-14", "02-15"]),
    ("FHSD", ["02-20", "02-21"]),
    ("BSD", ["03-07", "03-08", "03-09"]),
    ("Pacman", ["05-25", "05-26", "05-27"]),
]


def period_sales(spark: SparkSession, d: str, period: tuple[str, str] | None = None) -> DataFrame:
    """The order lines, all of them or those of a period (first, last
    day; a date range the optimizer pushes to the orders scan)."""
    s = S.mmm_sales(spark, d)
    if period is None:
        return s
    return s.filter(F.col("order_date").between(F.to_date(F.lit(period[0])), F.to_date(F.lit(period[1]))))


PERIOD_SQL = "period_sales AS (SELECT * FROM mmm_sales)"


def iso_week_key(day: str):
    """Year and number of the ISO week as one ordered number, YYYYWW."""
    return (F.expr(f"extract(YEAROFWEEK FROM {day})") * 100 + F.weekofyear(day)).cast("int")


def _iso_week_sql(day: str) -> str:
    return f"CAST(isoyear({day}) * 100 + weekofyear({day}) AS INTEGER)"


MEDIA_COLS = ["Total_Investment", *CHANNELS]
_HALF_YEAR_GAP = ("Radio", "Other")  # channels the sheet leaves empty from January to June


def media(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in monthly spend sheet: order totals by customer number as
    channels, one row per (Year, Month) of the data."""
    o = read_table(spark, d, "orders").select(
        F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"), "o_custkey", "o_totalprice")
    per = [F.coalesce(exact_sum(F.when(F.col("o_custkey") % len(CHANNELS) == i, F.col("o_totalprice"))), F.lit(0.0))
           / F.lit(1e6) for i in range(len(CHANNELS))]
    cols = [(F.when(F.col("Month") > 6, x) if c in _HALF_YEAR_GAP else x).alias(c) for c, x in zip(CHANNELS, per)]
    m = o.groupBy("Year", "Month").agg(*cols)
    total = F.coalesce(F.col(CHANNELS[0]), F.lit(0.0))
    for c in CHANNELS[1:]:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return m.select("Year", "Month", total.alias("Total_Investment"), *CHANNELS)


def _media_sql() -> str:
    cols = []
    for i, c in enumerate(CHANNELS):
        x = (f"coalesce(CAST(sum(CAST(CASE WHEN o_custkey % {len(CHANNELS)} = {i} THEN o_totalprice END AS DECIMAL(38,10))) "
             "AS DOUBLE), 0.0) / 1e6")
        cols.append(f"CASE WHEN month(o_orderdate) > 6 THEN {x} END AS {c}" if c in _HALF_YEAR_GAP else f"{x} AS {c}")
    total = " + ".join(f"coalesce({c}, 0.0)" for c in CHANNELS)
    return f"""media0 AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS Year, CAST(month(o_orderdate) AS INTEGER) AS Month, {', '.join(cols)}
  FROM orders GROUP BY year(o_orderdate), month(o_orderdate)),
media AS (SELECT Year, Month, {total} AS Total_Investment, {', '.join(CHANNELS)} FROM media0)"""


MEDIA_SQL = _media_sql()
HOLIDAY_SQL = """holidays AS (
  SELECT CAST(y || '-' || md AS DATE) AS day, name
  FROM (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) AS y FROM orders) yy,
       (VALUES """ + ", ".join(f"('{md}', '{n}')" for n, mds in SALE_EVENTS for md in mds) + ") t(md, name))"


def nps_wide(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in score sheet: one wide row per year, one column per month
    (share of urgent orders, in percent)."""
    o = read_table(spark, d, "orders").select(F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("m"),
                                              (F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return o.groupBy("Year").agg(*[
        F.try_divide(F.count_if((F.col("m") == i) & F.col("u")) * 100.0, F.count_if(F.col("m") == i)).alias(f"m{i}")
        for i in range(1, 13)])


NPS_SQL = """nps_wide AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS Year, """ + ", ".join(
    f"count(*) FILTER (WHERE month(o_orderdate) = {i} AND o_orderpriority = '1-URGENT') * 100.0::DOUBLE "
    f"/ nullif(count(*) FILTER (WHERE month(o_orderdate) = {i}), 0) AS m{i}" for i in range(1, 13)) + """
  FROM orders GROUP BY year(o_orderdate)),
nps AS (SELECT Year, CAST(substr(month_col, 2) AS INTEGER) AS Month, nps
        FROM (UNPIVOT nps_wide ON """ + ", ".join(f"m{i}" for i in range(1, 13)) + " INTO NAME month_col VALUE nps))"


# ---------------------------------------------------------------- cleaning
_MMM_OTHERS = ["order_date", "gmv", "deliverybdays", "deliverycdays", "payment_type", "sla", "cust_id",
               "sub_category", "vertical", "product_mrp", "list_mrp", "procurement_sla"]


def clean(spark: SparkSession, d: str, period: tuple[str, str] | None = None) -> DataFrame:
    """Dedup on (fsn, order, item, units); drop zero MRP; zero GMV repaired
    as MRP x units; keep MRP x units >= GMV; sentinel/negative delivery
    days -> 0; negative procurement SLA -> 0; SLA capped at 17; calendar
    attributes; list price, promotional offer, prepaid flag.  All order lines,
    or those of `period`."""
    s = period_sales(spark, d, period)
    s = dedup_key(s, ["fsn_id", "order_id", "order_item_id", "units"])
    s = s.filter(F.col("product_mrp") != 0)
    s = s.withColumn("gmv", F.when(F.col("gmv") == 0, F.col("product_mrp") * F.col("units")).otherwise(F.col("gmv")))
    s = s.filter(F.col("product_mrp") * F.col("units") >= F.col("gmv"))
    s = (s.withColumn("deliverybdays", floor_invalid_to_zero(F.col("deliverybdays")))
         .withColumn("deliverycdays", floor_invalid_to_zero(F.col("deliverycdays")))
         .withColumn("procurement_sla", F.greatest(F.col("procurement_sla"), F.lit(0)))
         .withColumn("sla", cap_upper(F.col("sla"), SLA_CAP)))
    return (s.withColumn("Year", F.year("order_date")).withColumn("Month", F.month("order_date"))
            .withColumn("week", iso_week_key("order_date"))
            .withColumn("month_date", F.trunc("order_date", "MM"))
            .withColumn("week_date", week_start_sunday(F.col("order_date")))
            .withColumn("wday", F.date_format("order_date", "EEEE"))
            .withColumn("list_price", F.col("gmv") / F.col("units"))
            .withColumn("promotional_offer", (F.col("product_mrp") - F.col("list_price")) / F.col("product_mrp"))
            .withColumn("payment_ind", (F.col("payment_type") == "Prepaid").cast("int")))


CLEAN_SQL = PERIOD_SQL + """,
mc0 AS (
  SELECT * FROM period_sales QUALIFY row_number() OVER (PARTITION BY fsn_id, order_id, order_item_id, units ORDER BY """ + \
    ", ".join(f"{c} ASC NULLS FIRST" for c in _MMM_OTHERS) + """) = 1),
mc1 AS (SELECT * REPLACE (CASE WHEN gmv = 0 THEN product_mrp * units ELSE gmv END AS gmv) FROM mc0 WHERE product_mrp <> 0),
mc AS (
  SELECT * REPLACE (
      greatest(coalesce(TRY_CAST(deliverybdays AS INTEGER), 0), 0) AS deliverybdays,
      greatest(coalesce(TRY_CAST(deliverycdays AS INTEGER), 0), 0) AS deliverycdays,
      greatest(procurement_sla, 0) AS procurement_sla,
      CASE WHEN sla > """ + str(SLA_CAP) + """ THEN """ + str(SLA_CAP) + """ ELSE sla END AS sla),
    CAST(year(order_date) AS INTEGER) AS Year, CAST(month(order_date) AS INTEGER) AS Month,
    """ + _iso_week_sql("order_date") + """ AS week, date_trunc('month', order_date) AS month_date,
    order_date - CAST(dayofweek(order_date) AS INTEGER) AS week_date, strftime(order_date, '%A') AS wday,
    gmv / units AS list_price, (product_mrp - gmv / units) / product_mrp AS promotional_offer,
    CAST(payment_type = 'Prepaid' AS INTEGER) AS payment_ind
  FROM mc1 WHERE product_mrp * units >= gmv)"""


@query("repair_zero_amount", ["mmm_sales"], CLEAN_SQL + """
SELECT count(*) AS n_rows, CAST(sum(CAST(gmv AS DECIMAL(38,10))) AS DOUBLE) AS total_gmv, count(*) FILTER (WHERE gmv = 0) AS n_zero_gmv FROM mc""")
def repair_zero_amount(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned order lines; zero GMV replaced by MRP x units."""
    c = clean(spark, d)
    return c.agg(F.count(F.lit(1)).alias("n_rows"), exact_sum("gmv").alias("total_gmv"),
                 F.count_if(F.col("gmv") == 0).alias("n_zero_gmv"))


@query("filter_price_consistency", ["mmm_sales"], """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE list_mrp * units >= gmv) AS n_consistent FROM mmm_sales""")
def filter_price_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose list MRP x units covers the GMV."""
    s = S.mmm_sales(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("list_mrp") * F.col("units") >= F.col("gmv")).alias("n_consistent"))


@query("floor_invalid_to_zero", ["mmm_sales"], CLEAN_SQL + """
SELECT deliverybdays, deliverycdays, count(*) AS n FROM mc GROUP BY ALL""")
def floor_invalid_to_zero_q(spark: SparkSession, d: str) -> DataFrame:
    """B15: '\\N' and negative delivery days become 0."""
    return group_count(clean(spark, d), ["deliverybdays", "deliverycdays"], "n")


@query("cap_upper", ["mmm_sales"], CLEAN_SQL + "\nSELECT sla, count(*) AS n FROM mc GROUP BY ALL")
def cap_upper_q(spark: SparkSession, d: str) -> DataFrame:
    """Service level capped at 17 days."""
    return group_count(clean(spark, d), ["sla"], "n")


@query("derive_list_price_promo", ["mmm_sales"], CLEAN_SQL + """
SELECT order_id, order_item_id, fsn_id, list_price, promotional_offer FROM mc""")
def derive_list_price_promo(spark: SparkSession, d: str) -> DataFrame:
    """List price = GMV / units; offer = (MRP - list price) / MRP."""
    c = clean(spark, d)
    return c.select("order_id", "order_item_id", "fsn_id", "list_price", "promotional_offer")


@query("period_floor", ["mmm_sales"], CLEAN_SQL + """
SELECT strftime(month_date, '%Y-%m-%d') AS month_date, strftime(week_date, '%Y-%m-%d') AS week_date, count(*) AS n
FROM mc GROUP BY ALL""")
def period_floor(spark: SparkSession, d: str) -> DataFrame:
    """Month floor and Sunday-start week floor."""
    c = clean(spark, d).select(F.date_format("month_date", "yyyy-MM-dd").alias("month_date"),
                               F.date_format("week_date", "yyyy-MM-dd").alias("week_date"))
    return group_count(c, ["month_date", "week_date"], "n")


@query("week_numbers", ["mmm_sales"], PERIOD_SQL + """
SELECT DISTINCT strftime(order_date, '%Y-%m-%d') AS day, CAST(weekofyear(order_date) AS INTEGER) AS iso_week,
       CAST(floor((dayofyear(order_date) - 1) / 7) + 1 AS INTEGER) AS simple_week FROM period_sales""")
def week_numbers(spark: SparkSession, d: str) -> DataFrame:
    """ISO week (%V) and the simple week() numbering side by side."""
    s = period_sales(spark, d)
    return s.select(F.date_format("order_date", "yyyy-MM-dd").alias("day"),
                    F.weekofyear("order_date").alias("iso_week"),
                    week_of_year_simple(F.col("order_date")).alias("simple_week")).distinct()


@query("fiscal_week", ["mmm_sales"], CLEAN_SQL + """
SELECT week, CASE WHEN week % 100 >= 26 THEN week % 100 - 25 ELSE week % 100 + 28 END AS fiscal_week, count(*) AS n
FROM mc GROUP BY ALL""")
def fiscal_week(spark: SparkSession, d: str) -> DataFrame:
    """re-index weeks to start mid-year (week 26 -> 1)."""
    n = F.col("week") % 100
    c = clean(spark, d).withColumn("fiscal_week", F.when(n >= 26, n - 25).otherwise(n + 28))
    return group_count(c, ["week", "fiscal_week"], "n")


@query("units_by_weekday", ["mmm_sales"], CLEAN_SQL + """
SELECT wday, CAST(isodow(order_date) AS INTEGER) AS weekday_index, sum(units) AS units FROM mc GROUP BY ALL""")
def units_by_weekday(spark: SparkSession, d: str) -> DataFrame:
    """Units sold per weekday with Monday-first ordering index."""
    c = clean(spark, d).withColumn("weekday_index", ((F.dayofweek("order_date") + 5) % 7 + 1).cast("int"))
    return c.groupBy("wday", "weekday_index").agg(F.sum("units").alias("units"))


@query("top10_products", ["mmm_sales"], CLEAN_SQL + """
SELECT vertical, CAST(sum(CAST(gmv AS DECIMAL(38,10))) AS DOUBLE) AS gmv FROM mc GROUP BY 1 ORDER BY CAST(sum(CAST(gmv AS DECIMAL(38,10))) AS DOUBLE) DESC, vertical LIMIT 10""")
def top10_products(spark: SparkSession, d: str) -> DataFrame:
    """Ten best-selling verticals by GMV."""
    c = clean(spark, d).groupBy("vertical").agg(exact_sum("gmv").alias("g"))
    return c.orderBy(F.desc("g"), "vertical").limit(10).select("vertical", F.col("g").alias("gmv"))


@query("filter_negated_periods", [], """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders
WHERE NOT ((month(o_orderdate) = 5 AND year(o_orderdate) = 1995) OR (month(o_orderdate) = 6 AND year(o_orderdate) = 1995)
           OR (month(o_orderdate) = 7 AND year(o_orderdate) = 2001)) GROUP BY ALL""")
def filter_negated_periods(spark: SparkSession, d: str) -> DataFrame:
    """Drop months outside the analysed window (negated disjunction)."""
    o = read_table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    bad = (((F.col("month") == 5) & (F.col("year") == 1995)) | ((F.col("month") == 6) & (F.col("year") == 1995))
           | ((F.col("month") == 7) & (F.col("year") == 2001)))
    return group_count(o.filter(~bad), ["year", "month"], "n")


@query("crosstab_year_month", [], """
SELECT year, """ + ", ".join(f"CAST(count(*) FILTER (WHERE month = {m}) AS BIGINT) AS \"{m}\"" for m in range(1, 13)) + """
FROM (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders) GROUP BY year""")
def crosstab_year_month(spark: SparkSession, d: str) -> DataFrame:
    """table(Year, Month) — one row per year, one column per month."""
    o = read_table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    t = crosstab_counts(o, "year", "month", list(range(1, 13)))
    return t.select(F.col("year").cast("long").alias("year"), *[F.col(str(m)).cast("long") for m in range(1, 13)])


# --------------------------------------------------------------- calendars
def calendar_weeks(spark: SparkSession, d: str) -> DataFrame:
    """A10: every day between the first and last order date, counted per
    (year, month, simple week) with the fraction of a 7-day week."""
    s = period_sales(spark, d)
    rng = s.agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    days = rng.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    week = (F.year("day") * 100 + week_of_year_simple(F.col("day"))).cast("int")
    g = days.groupBy(F.year("day").alias("Year"), F.month("day").alias("Month"), week.alias("week")).agg(
        F.count(F.lit(1)).alias("n_days"))
    return g.withColumn("frac_days", F.col("n_days") / 7.0)


CAL_SQL = """days AS (SELECT CAST(unnest(range(CAST((SELECT min(order_date) FROM period_sales) AS TIMESTAMP),
                                  CAST((SELECT max(order_date) FROM period_sales) AS TIMESTAMP) + INTERVAL 1 DAY,
                                  INTERVAL 1 DAY)) AS DATE) AS day),
cal AS (SELECT CAST(year(day) AS INTEGER) AS Year, CAST(month(day) AS INTEGER) AS Month,
               CAST(year(day) * 100 + floor((dayofyear(day) - 1) / 7) + 1 AS INTEGER) AS week, count(*) AS n_days, count(*) / 7.0::DOUBLE AS frac_days FROM days GROUP BY ALL)"""


@query("calendar_month_week_days", ["mmm_sales"], PERIOD_SQL + ",\n" + CAL_SQL + "\nSELECT * FROM cal")
def calendar_month_week_days(spark: SparkSession, d: str) -> DataFrame:
    """A10: days per (month, week) over the order date range."""
    return calendar_weeks(spark, d)


def weekly_media(spark: SparkSession, d: str) -> DataFrame:
    """Monthly spend / 4.30 spread over weeks by the share of the week's
    days in the month, summed per week, x 1e7 (the sheet is in crores)."""
    m = media(spark, d).fillna(0.0)
    m = m.select("Year", "Month", *[(F.col(c) / 4.30).alias(c) for c in MEDIA_COLS])
    j = calendar_weeks(spark, d).join(m, ["Year", "Month"], "left")
    return j.groupBy("week").agg(*[(exact_sum(F.col(c) * F.col("frac_days")) * 10000000).alias(c) for c in MEDIA_COLS])


WMEDIA_SQL = CAL_SQL + ",\n" + MEDIA_SQL + """,
wmedia AS (SELECT week, """ + ", ".join(
    f"CAST(sum(CAST(coalesce({c}, 0.0) / 4.30 * frac_days AS DECIMAL(38,10))) AS DOUBLE) * 10000000 AS {c}"
    for c in MEDIA_COLS) + """
           FROM cal LEFT JOIN media USING (Year, Month) GROUP BY week)"""


@query("prorate_month_to_week", ["mmm_sales"], PERIOD_SQL + ",\n" + WMEDIA_SQL + "\nSELECT week, " + ", ".join(MEDIA_COLS) + " FROM wmedia")
def prorate_month_to_week(spark: SparkSession, d: str) -> DataFrame:
    """Weekly media spend from the monthly sheet."""
    w = weekly_media(spark, d)
    return w.select("week", *MEDIA_COLS)


def holidays(spark: SparkSession, d: str) -> DataFrame:
    """The sale days of every year of the data (years x a fixed list of days)."""
    years = read_table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    days = F.array(*[F.struct(F.lit(md).alias("md"), F.lit(n).alias("name")) for n, mds in SALE_EVENTS for md in mds])
    return years.select(F.explode(F.sequence("a", "b")).alias("y")).select("y", F.explode(days).alias("e")) \
        .select(F.to_date(F.concat_ws("-", F.col("y").cast("string"), "e.md")).alias("day"), F.col("e.name").alias("name"))


def holidays_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Sale days per ISO week."""
    return holidays(spark, d).groupBy(iso_week_key("day").alias("week")).agg(F.count(F.lit(1)).alias("holiday_count"))


HW_SQL = "hw AS (SELECT " + _iso_week_sql("day") + " AS week, count(*) AS holiday_count FROM holidays GROUP BY ALL)"


@query("join_holiday_calendar", ["mmm_sales"], CLEAN_SQL + ",\n" + HOLIDAY_SQL + """
SELECT coalesce(h.name, 'Regular Day') AS special_sale_day, CASE WHEN h.name IS NULL THEN 'N' ELSE 'Y' END AS is_sale_day,
       count(*) AS n_orders FROM mc LEFT JOIN holidays h ON mc.order_date = h.day GROUP BY ALL""")
def join_holiday_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Label each order with its sale event (fixed calendar,
    broadcast: 35 days per year of data)."""
    c = clean(spark, d)
    j = c.join(F.broadcast(holidays(spark, d)), c.order_date == F.col("day"), "left")
    j = j.select(F.coalesce("name", F.lit("Regular Day")).alias("special_sale_day"),
                 F.when(F.col("name").isNull(), "N").otherwise("Y").alias("is_sale_day"))
    return group_count(j, ["special_sale_day", "is_sale_day"], "n_orders")


@query("holidays_per_week", ["mmm_sales"], CLEAN_SQL + ",\n" + HOLIDAY_SQL + ",\n" + HW_SQL + """
SELECT Year, week, count(*) AS n_orders, coalesce(max(holiday_count), 0) AS holiday_count
FROM mc LEFT JOIN hw USING (week) GROUP BY ALL""")
def holidays_per_week(spark: SparkSession, d: str) -> DataFrame:
    """Sale days per ISO week joined onto weekly orders."""
    c = clean(spark, d).join(F.broadcast(holidays_by_week(spark, d)), ["week"], "left")
    return c.groupBy("Year", "week").agg(F.count(F.lit(1)).alias("n_orders"),
                                         F.coalesce(F.max("holiday_count"), F.lit(0)).alias("holiday_count"))


def nps_long(spark: SparkSession, d: str) -> DataFrame:
    long = wide_months_to_long(nps_wide(spark, d), ["Year"], [f"m{i}" for i in range(1, 13)], "nps")
    return long.select(F.col("Year").cast("int").alias("Year"), F.col("month").cast("int").alias("Month"), "nps")


@query("wide_months_to_long", ["mmm_sales"], CLEAN_SQL + ",\n" + NPS_SQL + """
SELECT Year, Month, nps, CAST(sum(CAST(gmv AS DECIMAL(38,10))) AS DOUBLE) AS gmv FROM mc JOIN nps USING (Year, Month) GROUP BY ALL""")
def wide_months_to_long_q(spark: SparkSession, d: str) -> DataFrame:
    """A4/H5: a wide row of 12 monthly scores per year -> (Year, Month, nps),
    joined to monthly GMV."""
    c = clean(spark, d).join(nps_long(spark, d), ["Year", "Month"])
    return c.groupBy("Year", "Month", "nps").agg(exact_sum("gmv").alias("gmv"))


@query("join_left_multikey", ["mmm_sales"], CLEAN_SQL + ",\n" + NPS_SQL + """
SELECT Year, Month, week, count(*) AS n_orders, max(nps) AS nps FROM mc LEFT JOIN nps USING (Year, Month) GROUP BY ALL""")
def join_left_multikey(spark: SparkSession, d: str) -> DataFrame:
    """Left join on (Year, Month) of the monthly score onto order rows."""
    c = clean(spark, d).join(nps_long(spark, d), ["Year", "Month"], "left")
    return c.groupBy("Year", "Month", "week").agg(F.count(F.lit(1)).alias("n_orders"), F.max("nps").alias("nps"))


@query("share_by_period", ["mmm_sales"], CLEAN_SQL + """
SELECT Year, Month, week, count(*) AS n_orders, avg(payment_ind) AS per_order FROM mc GROUP BY ALL""")
def share_by_period(spark: SparkSession, d: str) -> DataFrame:
    """Prepaid share per (year, month, week) in one aggregate."""
    c = clean(spark, d)
    return c.groupBy("Year", "Month", "week").agg(F.count(F.lit(1)).alias("n_orders"),
                                                  F.avg("payment_ind").alias("per_order"))


# ------------------------------------------------------------- weekly KPIs
_CELL = [KEY, "vertical", "Year", "Month", "week"]
_COUNTED = ["units", "deliverybdays", "deliverycdays", "sla", "procurement_sla", "payment_ind"]
_EXACT = ["gmv", "product_mrp", "list_price", "promotional_offer"]
_MEANS = ["units", "list_price", "product_mrp"]
_MAY_LACK = ["sla", "payment_ind"]                               # `clean` leaves no null in the others


def _cell_sums(get) -> list[Column]:
    """The aggregates of a cell over the columns that `get` gives for the names."""
    return [*[F.sum(get(c)).alias(f"s_{c}") for c in _COUNTED], *[F.sum(get(c).cast("decimal(38,10)")).alias(f"s_{c}") for c in _EXACT],
            *[F.count(get(c)).alias(f"n_{c}") for c in _MAY_LACK]]


def line_cells(spark: SparkSession, d: str) -> DataFrame:
    """Sums and counts of the cleaned order lines per product category, vertical, month and week.  They add up, so all
    weekly figures come from one pass over the lines."""
    return clean(spark, d).groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"), *_cell_sums(F.col))


def cells_and_verticals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """`line_cells` and `vertical_means` of one pass over the lines, written once: a line counts for its cell and for its vertical."""
    lines = clean(spark, d).withColumn("__cell", F.explode(F.array(F.lit(True), F.lit(False))))

    def cell(c):
        return F.when(F.col("__cell"), F.col(c))
    keys = [KEY, "vertical", *[cell(c).alias(c) for c in _CELL[2:]]]
    ensure_checkpoint_dir(spark)
    both = lines.groupBy("__cell", *keys).agg(
        F.count(F.lit(1)).alias("n"), *_cell_sums(cell),
        *[F.avg(F.when(~F.col("__cell"), F.col(c))).alias(f"m_{c}") for c in _MEANS]).checkpoint(eager=True)
    cells = both.filter("__cell").drop("__cell", *[f"m_{c}" for c in _MEANS])
    means = both.filter(~F.col("__cell")).select(KEY, "vertical", *[F.col(f"m_{c}").alias(c) for c in _MEANS], F.col("n").alias("n_orders"))
    return cells, means


def _cell_sum(c: str) -> Column:
    total = F.sum(f"s_{c}")
    return (total.cast("double") if c in _EXACT else total).alias(c)


def _cell_mean(c: str) -> Column:
    return F.try_divide(F.sum(f"s_{c}").cast("double"), F.sum(f"n_{c}" if c in _MAY_LACK else "n")).alias(c)


def vertical_means(lines: DataFrame) -> DataFrame:
    """Means of units and prices and the number of order lines per product category and vertical."""
    return lines.groupBy(KEY, "vertical").agg(*[F.avg(c).alias(c) for c in _MEANS], F.count(F.lit(1)).alias("n_orders"))


def weekly(spark: SparkSession, d: str, cells: DataFrame | None = None, spend: DataFrame | None = None) -> DataFrame:
    """Per (product category, week): sums, means, prepaid share, media
    spend of the week, monthly score and sale days (mixed aggregate).  `cells` and `spend` are
    `line_cells` and `weekly_media`, if at hand."""
    c = (line_cells(spark, d) if cells is None else cells).join(nps_long(spark, d), ["Year", "Month"], "left")
    c = c.join(F.broadcast(holidays_by_week(spark, d)), ["week"], "left").fillna(0, subset=["holiday_count"])
    w = c.groupBy(KEY, "week").agg(
        _cell_sum("gmv"), _cell_sum("units"), _cell_mean("deliverybdays"),
        _cell_mean("deliverycdays"), _cell_mean("sla"),
        _cell_sum("product_mrp"), _cell_mean("procurement_sla"),
        F.try_divide(F.sum(F.col("nps") * F.col("n")), F.sum(F.when(F.col("nps").isNotNull(), F.col("n")))).alias("nps"),
        (F.sum(F.col("holiday_count") * F.col("n")) / F.sum("n")).alias("holiday_count"),
        _cell_sum("list_price"), _cell_mean("promotional_offer"),
        _cell_mean("payment_ind").alias("per_order"), F.sum("n").alias("n_orders"))
    return w.join(weekly_media(spark, d) if spend is None else spend, "week", "left")


WEEKLY_SQL = CLEAN_SQL + ",\n" + HOLIDAY_SQL + ",\n" + NPS_SQL + ",\n" + WMEDIA_SQL + ",\n" + HW_SQL + """,
wk0 AS (SELECT sub_category, week, CAST(sum(CAST(gmv AS DECIMAL(38,10))) AS DOUBLE) AS gmv, sum(units) AS units, avg(deliverybdays) AS deliverybdays,
          avg(deliverycdays) AS deliverycdays, avg(sla) AS sla, CAST(sum(CAST(product_mrp AS DECIMAL(38,10))) AS DOUBLE) AS product_mrp,
          avg(procurement_sla) AS procurement_sla, avg(nps) AS nps, avg(coalesce(holiday_count, 0)) AS holiday_count,
          CAST(sum(CAST(list_price AS DECIMAL(38,10))) AS DOUBLE) AS list_price, CAST(sum(CAST(promotional_offer AS DECIMAL(38,10))) AS DOUBLE) / count(promotional_offer) AS promotional_offer, avg(payment_ind) AS per_order,
          count(*) AS n_orders
        FROM mc LEFT JOIN nps USING (Year, Month) LEFT JOIN hw USING (week) GROUP BY ALL),
wk AS (SELECT * FROM wk0 LEFT JOIN wmedia USING (week))"""

_WK_OUT = ["gmv", "units", "deliverybdays", "deliverycdays", "sla", "product_mrp", "procurement_sla", "nps",
           "holiday_count", "list_price", "promotional_offer", "per_order", "TV", "SEM"]


@query("weekly_kpi", ["mmm_sales"], WEEKLY_SQL + "\nSELECT sub_category, week, n_orders, "
       + ", ".join(f"{significant_sql(c, 12)} AS {c}" for c in _WK_OUT) + " FROM wk")
def weekly_kpi(spark: SparkSession, d: str) -> DataFrame:
    """The weekly modelling table per product category."""
    w = weekly(spark, d)
    return w.select(KEY, "week", "n_orders", *[significant(F.col(c), 12).alias(c) for c in _WK_OUT])


ADSTOCKS = [f"{c}_adstock" for c in CHANNELS]
MEASURES = ["gmv", "units", "deliverybdays", "deliverycdays", "sla", "product_mrp", "procurement_sla", *MEDIA_COLS, "nps",
            "holiday_count", "list_price", "promotional_offer", "per_order", *ADSTOCKS]


def weekly_measures(spark: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    """`weekly` with the adstock of the week's spend per channel: 31 measures per (product category, week)."""
    ensure_checkpoint_dir(spark)
    spend = weekly_media(spark, d).checkpoint(eager=True)          # a row a week
    long = spend.unpivot(["week"], CHANNELS, "channel", "spend")
    stock = adstock(long, ["channel"], "week", "spend", ADSTOCK_RATE)
    wide = stock.groupBy("week").agg(*[F.max(F.when(F.col("channel") == c, F.col("adstock"))).alias(f"{c}_adstock")
                                       for c in CHANNELS])
    return weekly(spark, d, cells, spend).join(wide, "week", "left")


ADSTOCK_SQL = """
al AS (UNPIVOT (SELECT week, """ + ", ".join(CHANNELS) + """ FROM wmedia) ON """ + ", ".join(CHANNELS) + """ INTO NAME channel VALUE spend),
an AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY week) AS t FROM al),
ad AS (SELECT x.channel, x.week, sum(y.spend * pow(""" + str(ADSTOCK_RATE) + """, x.t - y.t)) AS adstock
       FROM an x JOIN an y ON x.channel = y.channel AND y.t <= x.t GROUP BY ALL),
aw AS (SELECT week, """ + ", ".join(f"max(adstock) FILTER (WHERE channel = '{c}') AS {c}_adstock" for c in CHANNELS) + """
       FROM ad GROUP BY week)"""


@query("weekly_feature_table", ["mmm_sales"], WEEKLY_SQL + "," + ADSTOCK_SQL + "\nSELECT sub_category, week, n_orders, "
       + ", ".join(f"{significant_sql(c, 9)} AS {c}" for c in MEASURES) + " FROM wk LEFT JOIN aw USING (week)")
def weekly_feature_table(spark: SparkSession, d: str) -> DataFrame:
    """All 31 weekly measures per product category: sums, means, shares, media spend and its adstock."""
    return weekly_measures(spark, d).select(KEY, "week", "n_orders", *[significant(F.col(c), 9).alias(c) for c in MEASURES])


@query("group_mean_compare", ["mmm_sales"], CLEAN_SQL + """,
v AS (SELECT sub_category, vertical, avg(product_mrp) AS m, count(*) AS n FROM mc GROUP BY ALL)
SELECT sub_category, vertical, n, """ + significant_sql("m", 9) + """ AS mean_mrp,
       """ + significant_sql("m / max(m) OVER (PARTITION BY sub_category)", 9) + """ AS share_of_highest FROM v""")
def group_mean_compare(spark: SparkSession, d: str) -> DataFrame:
    """Mean MRP of the verticals of each product category, against the category's highest."""
    v = clean(spark, d).groupBy(KEY, "vertical").agg(F.avg("product_mrp").alias("m"), F.count(F.lit(1)).alias("n"))
    top = F.max("m").over(Window.partitionBy(KEY))
    v = v.select(KEY, "vertical", "n", "m", (F.col("m") / top).alias("share"))
    return v.select(KEY, "vertical", "n", significant(F.col("m"), 9).alias("mean_mrp"),
                    significant(F.col("share"), 9).alias("share_of_highest"))


@query("summarise_all_sum", ["mmm_sales"], CLEAN_SQL + """
SELECT week, CAST(sum(CAST(gmv AS DECIMAL(38,10))) AS DOUBLE) AS gmv, CAST(sum(CAST(units AS DECIMAL(38,10))) AS DOUBLE) AS units, CAST(sum(deliverybdays) AS BIGINT) AS deliverybdays,
       CAST(sum(sla) AS BIGINT) AS sla, CAST(sum(CAST(product_mrp AS DECIMAL(38,10))) AS DOUBLE) AS product_mrp FROM mc GROUP BY week""")
def summarise_all_sum(spark: SparkSession, d: str) -> DataFrame:
    """One function (sum) over every measure column, per week."""
    from kestrel.operators.relational import summarise_all
    c = clean(spark, d).select("week", "gmv", "units", "deliverybdays", "sla", "product_mrp")
    s = summarise_all(c, ["week"], exact_sum)
    return s.select("week", "gmv", "units", F.col("deliverybdays").cast("long"),
                    F.col("sla").cast("long"), "product_mrp")


@query("period_sequence", ["mmm_sales"], CLEAN_SQL + """
SELECT strftime(week_date, '%Y-%m-%d') AS week_date, CAST(sum(CAST(gmv AS DECIMAL(38,10))) AS DOUBLE) AS gmv,
       CAST(row_number() OVER (ORDER BY week_date) AS INTEGER) AS period FROM mc GROUP BY week_date""")
def period_sequence(spark: SparkSession, d: str) -> DataFrame:
    """weekly totals numbered 1..n in date order (window over the
    aggregated weeks only)."""
    w = clean(spark, d).groupBy("week_date").agg(exact_sum("gmv").alias("gmv"))
    return w.select(F.date_format("week_date", "yyyy-MM-dd").alias("week_date"), "gmv",
                    F.row_number().over(Window.orderBy("week_date")).alias("period"))


_FACTORS = ["sub_category", "vertical", "payment_type", "wday", "sla", "procurement_sla"]


@query("weekly_category_counts", ["mmm_sales"], CLEAN_SQL + "\n" + "\nUNION ALL\n".join(
    f"SELECT week, '{c}' AS factor, CAST({c} AS VARCHAR) AS level, count(*) AS n FROM mc GROUP BY ALL" for c in _FACTORS))
def weekly_category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the dummies of six factors per week, as rows (week,
    factor, level, n): however many levels a factor has, one combined
    aggregate and no column per level."""
    levels = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in _FACTORS])
    c = clean(spark, d).select("week", F.explode(levels).alias("l"))
    return c.groupBy("week", "l.factor", "l.level").agg(F.count(F.lit(1)).alias("n"))


PAYMENTS = ["COD", "Prepaid"]


@query("pivot_wide", ["mmm_sales"], CLEAN_SQL + "\nSELECT week, " + ", ".join(
    f"count(*) FILTER (WHERE payment_type = '{p}') AS {p}" for p in PAYMENTS) + " FROM mc GROUP BY week")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    """H6: weekly orders per payment type, long to wide (the levels are an
    argument, so no distinct job and a fixed number of columns)."""
    return crosstab_counts(clean(spark, d), "week", "payment_type", PAYMENTS)


@query("lag_features", ["mmm_sales"], WEEKLY_SQL + """
SELECT sub_category, week, """ + ", ".join(
    f"lag({c}, {k}) OVER (PARTITION BY sub_category ORDER BY week) AS {c}_lag_{k}"
    for c in ("list_price", "gmv") for k in (1, 2, 3)) + " FROM wk")
def lag_features_q(spark: SparkSession, d: str) -> DataFrame:
    """lags 1-3 of weekly list price and GMV per category."""
    w = weekly(spark, d).select(KEY, "week", "list_price", "gmv")
    w = lag_features(lag_features(w, [KEY], "week", "list_price"), [KEY], "week", "gmv")
    return w.select(KEY, "week", *[F.col(f"{c}_lag_{k}")
                                   for c in ("list_price", "gmv") for k in (1, 2, 3)])


@query("lag_pct_change", ["mmm_sales"], WEEKLY_SQL + """
SELECT sub_category, week, """ + ", ".join(
    f"coalesce((gmv - lag(gmv, {k}) OVER w) / NULLIF(lag(gmv, {k}) OVER w, 0), 0.0) AS GMV_lag_{k}_per"
    for k in (1, 2, 3)) + " FROM wk WINDOW w AS (PARTITION BY sub_category ORDER BY week)")
def lag_pct_change(spark: SparkSession, d: str) -> DataFrame:
    """(x - lag_k) / lag_k, missing -> 0."""
    w = lag_features(weekly(spark, d).select(KEY, "week", "gmv"), [KEY], "week", "gmv")
    return w.select(KEY, "week", *[pct_change_vs_lag("gmv", f"gmv_lag_{k}").alias(f"GMV_lag_{k}_per")
                                   for k in (1, 2, 3)])


@query("rolling_mean", ["mmm_sales"], WEEKLY_SQL + """
SELECT sub_category, week, """ + ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY sub_category ORDER BY week ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} THEN "
    + significant_sql(f"CAST(sum(CAST(list_price AS DECIMAL(38,10))) OVER (PARTITION BY sub_category ORDER BY week "
                      f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS DOUBLE) / {k}", 9) + f" END AS LP_MA{k - 1}"
    for k in (2, 3, 4)) + " FROM wk")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    """right-aligned rolling means k = 2, 3, 4 (NULL until full)."""
    w = weekly(spark, d).select(KEY, "week", "list_price")
    return w.select(KEY, "week", *[significant(trailing_mean([KEY], "week", "list_price", k), 9).alias(f"LP_MA{k - 1}")
                                   for k in (2, 3, 4)])


@query("rolling_mean_increment", ["mmm_sales"], WEEKLY_SQL + f""",
ma AS (SELECT sub_category, week, list_price,
         CASE WHEN count(*) OVER w = 3 THEN CAST(sum(CAST(list_price AS DECIMAL(38,10))) OVER w AS DOUBLE) / 3 END AS ma
       FROM wk WINDOW w AS (PARTITION BY sub_category ORDER BY week ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT sub_category, week, {significant_sql('(list_price - ma) / ma', 8)} AS inc_LP_MA2 FROM ma""")
def rolling_mean_increment(spark: SparkSession, d: str) -> DataFrame:
    """F8: (x - MA) / MA against the 3-week moving average."""
    w = weekly(spark, d).select(KEY, "week", "list_price")
    w = w.withColumn("ma", trailing_mean([KEY], "week", "list_price", 3))
    return w.select(KEY, "week", significant((F.col("list_price") - F.col("ma")) / F.col("ma"), 8).alias("inc_LP_MA2"))


def _ma_impute_sql(k: int) -> str:
    """Oracle of C14 over a table ma(sub_category, week, x): the mean within k rows, or within the
    distance of the second-nearest value where fewer than two lie that near."""
    near = f"ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING"
    return f"""
p AS (SELECT *, row_number() OVER (PARTITION BY sub_category ORDER BY week) AS i FROM ma),
q AS (SELECT a.sub_category, a.week, abs(a.i - b.i) AS dist, b.x,
             row_number() OVER (PARTITION BY a.sub_category, a.week ORDER BY abs(a.i - b.i), b.i) AS nth
      FROM p a JOIN p b ON a.sub_category = b.sub_category AND a.x IS NULL AND b.x IS NOT NULL),
r AS (SELECT sub_category, week, greatest({k}, coalesce(max(dist) FILTER (WHERE nth = 2), max(dist))) AS reach FROM q GROUP BY ALL),
m AS (SELECT sub_category, week, CAST(sum(CAST(q.x AS DECIMAL(38,10))) AS DOUBLE) / count(*) AS x
      FROM q JOIN r USING (sub_category, week) WHERE q.dist <= r.reach GROUP BY ALL)"""


@query("impute_moving_average", ["mmm_sales"], WEEKLY_SQL + """,
ma AS (SELECT sub_category, week,
         CASE WHEN count(*) OVER (PARTITION BY sub_category ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4
              THEN CAST(sum(CAST(list_price AS DECIMAL(38,10))) OVER (PARTITION BY sub_category ORDER BY week
                   ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DOUBLE) / 4 END AS x
       FROM wk),""" + _ma_impute_sql(4) + """
SELECT ma.sub_category, ma.week, round(coalesce(ma.x, m.x), 6) AS LP_MA3 FROM ma LEFT JOIN m USING (sub_category, week)""")
def impute_moving_average_q(spark: SparkSession, d: str) -> DataFrame:
    """C14: the leading NULLs of the 4-week rolling mean filled with the
    mean of the values within 4 weeks (widening until two exist)."""
    w = weekly(spark, d).select(KEY, "week", "list_price")
    w = w.withColumn("LP_MA3", trailing_mean([KEY], "week", "list_price", 4))
    f = impute_moving_average(w, [KEY], "week", "LP_MA3", 4)
    return f.select(KEY, "week", F.round("LP_MA3", 6).alias("LP_MA3"))


@query("adstock", ["mmm_sales"], PERIOD_SQL + ",\n" + WMEDIA_SQL + """,
l AS (UNPIVOT (SELECT week, """ + ", ".join(CHANNELS) + """ FROM wmedia) ON """ + ", ".join(CHANNELS) + """ INTO NAME channel VALUE spend),
n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY week) AS t FROM l),
a AS (SELECT x.channel, x.week, sum(y.spend * pow(""" + str(ADSTOCK_RATE) + """, x.t - y.t)) AS adstock
      FROM n x JOIN n y ON x.channel = y.channel AND y.t <= x.t GROUP BY ALL)
SELECT channel, week, round(adstock, 2) AS adstock FROM a""")
def adstock_q(spark: SparkSession, d: str) -> DataFrame:
    """recursive adstock (rate 0.5) of the weekly spend of all nine
    channels, one series per channel."""
    long = weekly_media(spark, d).unpivot(["week"], CHANNELS, "channel", "spend")
    return adstock(long, ["channel"], "week", "spend", ADSTOCK_RATE).select("channel", "week", F.round("adstock", 2).alias("adstock"))


@query("log_transform_safe", ["mmm_sales"], WEEKLY_SQL + """
SELECT sub_category, week, round(ln(CASE WHEN gmv = 0 THEN 1e-5 ELSE gmv END), 6) AS log_gmv,
       """ + significant_sql("1 + promotional_offer - (SELECT min(promotional_offer) FROM wk)", 10) + """ AS promo_shifted FROM wk""")
def log_transform_safe(spark: SparkSession, d: str) -> DataFrame:
    """Log with exact zeros replaced, and shift-to-positive 1 + x - min(x)."""
    ensure_checkpoint_dir(spark)
    w = weekly(spark, d).select(KEY, "week", "gmv", "promotional_offer").checkpoint(eager=True)
    mn = w.agg(F.min("promotional_offer")).scalar()
    w = w.select(KEY, "week", "gmv", (1 + F.col("promotional_offer") - mn).alias("promo_shifted"))
    return w.select(KEY, "week", F.round(safe_log(F.col("gmv")), 6).alias("log_gmv"),
                    significant(F.col("promo_shifted"), 10).alias("promo_shifted"))


# ----------------------------------------------------------- models (rows)
@query("price_tier_clusters")
def price_tier_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Within each product category, k-means (k = 3, best of 50
    starts) on scaled per-vertical means of units, list price and MRP; tiers
    are named by their order rows (most: mass, fewest: premium).  With two or
    fewer verticals the higher-MRP one is 'Aspiring'."""
    return vertical_tiers(vertical_means(clean(spark, d)))


def vertical_tiers(means: DataFrame) -> DataFrame:
    return price_tiers(means, KEY, "vertical", ["units", "list_price", "product_mrp"], "product_mrp", "n_orders")


def features(spark: SparkSession, d: str) -> DataFrame:
    """Weekly table, written once, + moving-average increments and lag % changes."""
    ensure_checkpoint_dir(spark)
    w = weekly(spark, d).checkpoint(eager=True)
    w = w.withColumn("LP_MA1", trailing_mean([KEY], "week", "list_price", 2))
    w = w.withColumn("inc_LP_MA1", F.coalesce(F.try_divide(F.col("list_price") - F.col("LP_MA1"), F.col("LP_MA1")),
                                              F.lit(0.0)))
    w = lag_features(w, [KEY], "week", "gmv")
    for k in (1, 2, 3):
        w = w.withColumn(f"GMV_lag_{k}_per", pct_change_vs_lag("gmv", f"gmv_lag_{k}"))
    return w.fillna(0.0)


BASE_X = ["units", "sla", "product_mrp", "promotional_offer", "per_order", "TV", "SEM", "nps"]
FORMS = {
    "linear": BASE_X,
    "koyck": BASE_X + ["GMV_lag_1_per"],
    "distributed_lag": BASE_X + ["GMV_lag_1_per", "GMV_lag_2_per", "GMV_lag_3_per", "inc_LP_MA1"],
    "multiplicative": BASE_X,
    "multiplicative_lag": BASE_X + ["GMV_lag_1_per"],
}


@query("mmm_model_forms")
def mmm_model_forms(spark: SparkSession, d: str) -> DataFrame:
    """Five model forms per product category: linear / Koyck /
    distributed-lag forms on z-scored weekly data, multiplicative forms on
    logs (exact zeros -> 1e-5; a column with non-positive values is shifted
    to 1 + x - min first).  All (form, category) OLS fits run in parallel,
    one weekly table per group."""
    f = features(spark, d)
    allx = sorted({x for xs in FORMS.values() for x in xs})
    cols = ["gmv", *allx]
    st = f.groupBy(KEY).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols],
                            *[F.min(c).alias(f"__min_{c}") for c in cols])
    base = f.join(st, KEY)

    def zs(c):
        return (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")

    def logged(c):
        shifted = F.when(F.col(f"__min_{c}") > 0, F.col(c)).otherwise(1 + F.col(c) - F.col(f"__min_{c}"))
        return safe_log(shifted)

    forms = []
    for form, xs in FORMS.items():
        tr = logged if form.startswith("multiplicative") else zs
        forms.append(F.struct(F.lit(form).alias("form"), tr("gmv").alias("y"), F.array(*[tr(c) for c in xs]).alias("x")))
    data = base.select(KEY, F.explode(F.array(*forms)).alias("r")).select("r.form", KEY, "r.y", "r.x")
    names = dict(FORMS)

    def fit(g):
        import numpy as np
        from kestrel.operators.models import ols_numpy
        form = g["form"].iloc[0]
        x = np.stack(g["x"].to_numpy()).astype(float)
        res = ols_numpy(x, g["y"].to_numpy(dtype=float), names[form])
        res.insert(0, KEY, g[KEY].iloc[0])
        res.insert(0, "form", form)
        return res

    schema = (f"form string, {KEY} string, term string, estimate double, std_error double, t_value double, "
              "p_value double, r2 double, adj_r2 double, n long")
    return data.groupBy("form", KEY).applyInPandas(fit, schema)


TIERS = ["Mass_Product", "Aspiring_Product", "Premium_Product"]
SWEEP_X = ["week_index", "units", "deliverybdays", "deliverycdays", "sla", "product_mrp", "procurement_sla", *MEDIA_COLS, "nps",
           "holiday_count", "per_order", *ADSTOCKS, *TIERS, "Prepaid"]
LAGS = ["GMV_lag_1_per", "GMV_lag_2_per", "GMV_lag_3_per"]
SWEEP_FORMS = {"linear": SWEEP_X, "koyck": SWEEP_X + LAGS[:1], "distributed_lag": SWEEP_X + LAGS, "multiplicative": SWEEP_X,
               "multiplicative_lag": SWEEP_X + LAGS}
LOGGED = {"multiplicative", "multiplicative_lag"}
SWEEP_FOLDS, SWEEP_SEED = 5, 29


def sweep_table(spark: SparkSession, d: str) -> DataFrame:
    """Per (product category, week): the 31 measures, order lines per price tier, prepaid lines, lag changes of
    GMV and the week's number.  One row per category and week, written once and read by every step after.  The
    order lines are cleaned once: price tiers, their weekly lines and the measures all come from one aggregate."""
    cells, means = cells_and_verticals(spark, d)
    c = cells.join(vertical_tiers(means).select(KEY, "vertical", "price_tag"), [KEY, "vertical"])
    tiers = c.groupBy(KEY, "week").agg(*[F.sum(F.when(F.col("price_tag") == t, F.col("n")).otherwise(0)).alias(t) for t in TIERS],
                                       F.sum("s_payment_ind").alias("Prepaid"))
    w = weekly_measures(spark, d, cells).join(tiers, [KEY, "week"]).checkpoint(eager=True)
    w = lag_features(w, [KEY], "week", "gmv")
    for k, name in enumerate(LAGS, start=1):
        w = w.withColumn(name, pct_change_vs_lag("gmv", f"gmv_lag_{k}"))
    return w.withColumn("week_index", F.row_number().over(Window.partitionBy(KEY).orderBy("week"))).fillna(0.0).fillna(0)


def sweep_designs(table: DataFrame) -> DataFrame:
    """One row per form and row of the table: form, category, fold, v (predictors, then the response).

    The multiplicative forms take logarithms: a column with negative values is shifted
    to 1 + x - min within its category first, a zero counts as 1e-5."""
    fold = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SWEEP_SEED)), F.col("week").cast("string"))), 1, 8), 16, 10) \
        .cast("long") % SWEEP_FOLDS
    columns = ["gmv", *SWEEP_X, *LAGS]
    least = Window.partitionBy(KEY)
    base = table.select(KEY, fold.cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in columns],
                        *[F.min(F.col(c).cast("double")).over(least).alias(f"__min_{c}") for c in columns])

    def logged(c):
        return safe_log(F.when(F.col(f"__min_{c}") < 0, 1 + F.col(c) - F.col(f"__min_{c}")).otherwise(F.col(c)))
    forms = [F.struct(F.lit(form).alias("form"), F.array(*[logged(x) if form in LOGGED else F.col(x) for x in [*xs, "gmv"]]).alias("v"))
             for form, xs in SWEEP_FORMS.items()]
    return base.select(KEY, "fold", F.explode(F.array(*forms)).alias("r")).select("r.form", KEY, "fold", "r.v")


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return model_sweep(sweep_designs(sweep_table(spark, d)), ["form", KEY], SWEEP_FORMS, LOGGED, SWEEP_FOLDS)


@query("mmm_model_sweep")
def mmm_model_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The five forms of every product category through the whole chain (aliased columns, stepwise
    AIC from the empty model, elimination by VIF, p-value and adjusted R^2, 5-fold CV): the final terms with their
    elasticities.  One Gram aggregate serves all models; no model reads rows."""
    out = _sweep(spark, d).filter(F.col("stage") == "final").drop("stage", "aic")
    return out.withColumn("direction", F.when(F.col("elasticity") > 0, "Positive").when(F.col("elasticity").isNotNull(), "Negative"))


@query("mmm_sweep_log")
def mmm_sweep_log(spark: SparkSession, d: str) -> DataFrame:
    """The moves of the chain of every form and product category: aliased columns, stepwise additions and
    removals with the AIC they reach, eliminations with the p-value and VIF that caused them."""
    return _sweep(spark, d).filter(F.col("stage") != "final").select("form", KEY, "stage", "step", "term", "aic", "p_value", "vif")


@query("elasticity", ["mmm_sales"], WEEKLY_SQL + ",\nf AS (SELECT sub_category, gmv, "
       + ", ".join(f"coalesce({x}, 0.0) AS {x}" for x in BASE_X) + " FROM wk),\n"
       + residual_ctes("o", "f", [KEY], "gmv", BASE_X) + ",\n" + coefficient_ctes("o", [KEY], BASE_X) + """,
mean AS (SELECT sub_category, avg(gmv) AS my, """ + ", ".join(f"avg({x}) AS m_{x}" for x in BASE_X) + """ FROM f GROUP BY 1),
l AS (""" + "\nUNION ALL\n".join(f"SELECT sub_category, '{x}' AS term, b{i} AS b, b{i} * m_{x} / my AS e FROM o_coef JOIN mean USING (sub_category)"
                              for i, x in enumerate(BASE_X, start=1)) + f""")
SELECT sub_category, term, {significant_sql('b', 4)} AS estimate, {significant_sql('e', 4)} AS elasticity,
       CASE WHEN e > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM l""")
def elasticity_q(spark: SparkSession, d: str) -> DataFrame:
    """K9: beta * mean(x) / mean(y) of the linear form on unscaled weekly
    data, with a sign label — one OLS per product category, fitted in
    parallel (one weekly table per group)."""
    f = features(spark, d).select(KEY, "gmv", F.array(*[F.col(c) for c in BASE_X]).alias("x"))

    def fit(g):
        import numpy as np
        from kestrel.operators.models import ols_numpy
        x = np.stack(g["x"].to_numpy()).astype(float)
        y = g["gmv"].to_numpy(dtype=float)
        t = ols_numpy(x, y, BASE_X)
        t = t[t["term"] != "(Intercept)"].copy()
        t["elasticity"] = t["estimate"].to_numpy() * x.mean(axis=0) / y.mean()
        t["direction"] = np.where(t["elasticity"] > 0, "Positive", "Negative")
        t.insert(0, KEY, g[KEY].iloc[0])
        return t[[KEY, "term", "estimate", "elasticity", "direction"]]

    schema = f"{KEY} string, term string, estimate double, elasticity double, direction string"
    out = f.groupBy(KEY).applyInPandas(fit, schema)
    return out.select(KEY, "term", significant(F.col("estimate"), 4).alias("estimate"),
                      significant(F.col("elasticity"), 4).alias("elasticity"), "direction")


_ALIAS_X = [*CHANNELS, "Total_Investment", "gmv", "units"]


@query("collinear_columns", ["mmm_sales"], WEEKLY_SQL + ",\nf AS (SELECT "
       + ", ".join(_ALIAS_X) + " FROM wk WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in _ALIAS_X) + "),\n"
       + residual_ctes("o", "f", [], "0", _ALIAS_X) + ",\ntotal AS (SELECT "
       + ", ".join(f"var_pop({x}) * count(*) AS t_{x}" for x in _ALIAS_X) + " FROM f)\n"
       + "\nUNION ALL\n".join(f"SELECT '{x}' AS variable, d{i} <= 1e-9 * t_{x} AS aliased FROM o_a{i}, total"
                              for i, x in enumerate(_ALIAS_X, start=1)))
def collinear_columns_q(spark: SparkSession, d: str) -> DataFrame:
    """Aliased weekly predictors (e.g. total spend = sum of channels)."""
    w = weekly(spark, d)
    return collinear_columns(w, _ALIAS_X)
