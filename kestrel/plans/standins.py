"""Stand-in inputs for each case study, built from the driver's parquet tables.

Each stand-in exists twice: a Spark DataFrame builder and the identical DuckDB
SQL (used only by the oracle check).  They only reshape the test tables into
the schema a case study expects (see FIXTURES.md); none of them does any of
the analysis work, which lives in `kestrel.operators` / `kestrel.functions`.
Sentinels and nulls are injected by fixed expressions so both sides agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.sources.io import read_table


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# --------------------------------------------------------------------------
# Parking tickets (from events)
# --------------------------------------------------------------------------
def tickets(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    uid, eid = F.col("user_id"), F.col("event_id")
    return e.select(
        eid.alias("summons_number"),
        _s("user_id").alias("plate_id"),
        F.when(uid % 50 == 0, "99").otherwise(F.concat(F.lit("S"), _s(uid % 20))).alias("registration_state"),
        F.date_format("ts", "MM/dd/yyyy").alias("issue_date"),
        F.col("event_type").alias("violation_code"),
        F.when(eid % 89 == 0, "NA").otherwise(F.concat(F.lit("B"), _s(uid % 6))).alias("vehicle_body_type"),
        F.when(eid % 101 == 0, "N/A").otherwise(F.concat(F.lit("MK"), _s(uid % 11))).alias("vehicle_make"),
        (uid % 7).cast("int").alias("violation_precinct"),
        (uid % 10).cast("int").alias("issuer_precinct"),
        F.when(eid % 197 == 0, "0.5na")
        .otherwise(F.concat(F.date_format("ts", "hhmm"), F.substring(F.date_format("ts", "a"), 1, 1)))
        .alias("violation_time"),
    )


TICKETS_SQL = """tickets AS (
  SELECT event_id AS summons_number, CAST(user_id AS VARCHAR) AS plate_id,
    CASE WHEN user_id % 50 = 0 THEN '99' ELSE 'S' || CAST(user_id % 20 AS VARCHAR) END AS registration_state,
    strftime(ts, '%m/%d/%Y') AS issue_date, event_type AS violation_code,
    CASE WHEN event_id % 89 = 0 THEN 'NA' ELSE 'B' || CAST(user_id % 6 AS VARCHAR) END AS vehicle_body_type,
    CASE WHEN event_id % 101 = 0 THEN 'N/A' ELSE 'MK' || CAST(user_id % 11 AS VARCHAR) END AS vehicle_make,
    CAST(user_id % 7 AS INTEGER) AS violation_precinct, CAST(user_id % 10 AS INTEGER) AS issuer_precinct,
    CASE WHEN event_id % 197 = 0 THEN '0.5na'
         ELSE strftime(ts, '%I%M') || substr(strftime(ts, '%p'), 1, 1) END AS violation_time
  FROM events)"""


def season_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets over several years (orders), so every month/season occurs."""
    o = read_table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("summons_number"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("issue_date"),
        F.col("o_orderpriority").alias("violation_code"),
    )


SEASON_TICKETS_SQL = """season_tickets AS (
  SELECT o_orderkey AS summons_number, strftime(o_orderdate, '%m/%d/%Y') AS issue_date,
         o_orderpriority AS violation_code FROM orders)"""


# --------------------------------------------------------------------------
# Investment companies / funding rounds / sector mapping (customer, orders)
# --------------------------------------------------------------------------
def companies(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    n = read_table(spark, d, "nation")
    # nation / region are fixed-size dimensions (25 / 5 rows at every scale)
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select(
        F.lower("c_name").alias("permalink"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 41 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.initcap("c_mktsegment"), F.lit("|"), _s("c_nationkey"))).alias("category_list"),
        F.col("n_name").alias("country_code"),
        F.when(F.col("c_acctbal") < 0, "closed").otherwise("operating").alias("status"),
    )


COMPANIES_SQL = """companies AS (
  SELECT lower(c_name) AS permalink, c_name AS name,
    CASE WHEN c_custkey % 41 = 0 THEN NULL
         ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '|' || CAST(c_nationkey AS VARCHAR)
    END AS category_list,
    n_name AS country_code, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'operating' END AS status
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def rounds(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    c = read_table(spark, d, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.upper("c_name").alias("company_permalink"),
        F.col("o_orderkey").alias("funding_round_permalink"),
        F.lower(F.substring("o_orderpriority", 3, 100)).alias("funding_round_type"),
        F.when(F.col("o_orderkey") % 53 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("o_totalprice")).alias("raised_amount_usd"),
    )


ROUNDS_SQL = """rounds AS (
  SELECT upper(c_name) AS company_permalink, o_orderkey AS funding_round_permalink,
    lower(substr(o_orderpriority, 3, 100)) AS funding_round_type,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_totalprice END AS raised_amount_usd
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# The nine main-sector columns of the sector mapping file, in
# file order, and the two rows the file carries besides real categories.
SECTORS = [
    "Automotive & Sports", "Blanks", "Cleantech / Semiconductors", "Entertainment", "Health",
    "Manufacturing", "News, Search and Messaging", "Others", "Social, Finance, Analytics, Advertising",
]
FILE_ROWS = [("Enterprise 2.0", "Others"), ("", "Blanks")]
# Stand-in rule: sector of each market segment, and of each region's nations.
SEGMENT_SECTOR = [("automobile", "Automotive & Sports"), ("building", "Manufacturing"), ("furniture", "Others"),
                  ("household", "Entertainment"), ("machinery", "Manufacturing")]
REGION_SECTOR = [("AFRICA", "Health"), ("AMERICA", "News, Search and Messaging"),
                 ("ASIA", "Social, Finance, Analytics, Advertising"), ("EUROPE", "Cleantech / Semiconductors"),
                 ("MIDDLE EAST", "Others")]


def sector_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Wide one-hot sector mapping (category_list + one 0/1 column per
    sector) over the categories found in the tables: market segments, and
    nation names written with the same "na" -> "0" corruption as the
    original mapping file; plus the file's own two extra rows."""
    seg_map = F.create_map(*[x for k, v in SEGMENT_SECTOR for x in (F.lit(k), F.lit(v))])
    reg_map = F.create_map(*[x for k, v in REGION_SECTOR for x in (F.lit(k), F.lit(v))])
    seg = (read_table(spark, d, "customer").select(F.lower("c_mktsegment").alias("category_list")).distinct()
           .withColumn("sector", seg_map[F.col("category_list")]))
    n = read_table(spark, d, "nation")
    r = read_table(spark, d, "region")
    nat = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        F.replace(F.lower("n_name"), F.lit("na"), F.lit("0")).alias("category_list"),
        reg_map[F.col("r_name")].alias("sector"))
    extra = spark.createDataFrame(FILE_ROWS, "category_list string, sector string")
    rows = seg.unionByName(nat).unionByName(extra)
    return rows.select("category_list", *[(F.col("sector") == s).cast("int").alias(s) for s in SECTORS])


def _mapping_sql() -> str:
    seg = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_SECTOR)
    reg = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REGION_SECTOR)
    extra = " UNION ALL ".join(f"SELECT '{c}', '{v}'" for c, v in FILE_ROWS)
    onehot = ", ".join(f"CAST(sector = '{sct}' AS INTEGER) AS \"{sct}\"" for sct in SECTORS)
    return f"""sector_mapping AS (
  SELECT category_list, {onehot} FROM (
    SELECT category_list, CASE category_list {seg} END AS sector
    FROM (SELECT DISTINCT lower(c_mktsegment) AS category_list FROM customer)
    UNION ALL
    SELECT replace(lower(n_name), 'na', '0'), CASE r_name {reg} END
    FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL {extra}) m)"""


SECTOR_MAPPING_SQL = _mapping_sql()


# --------------------------------------------------------------------------
# Ride requests (events)
# --------------------------------------------------------------------------
def rides(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    drop_ts = F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))

    def fmt(c):
        return F.when(even, F.date_format(c, "dd/MM/yyyy H:mm")).otherwise(F.date_format(c, "dd-MM-yyyy HH:mm:ss"))

    return e.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("user_id") % 2 == 0, "City").otherwise("Airport").alias("pickup_point"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("driver_id"),
        F.col("event_type").alias("status"),
        fmt(F.col("ts")).alias("request_timestamp"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(fmt(drop_ts)).alias("drop_timestamp"),
    )


RIDES_SQL = """rides AS (
  SELECT event_id AS request_id, CASE WHEN user_id % 2 = 0 THEN 'City' ELSE 'Airport' END AS pickup_point,
    CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS driver_id, event_type AS status,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%d/%m/%Y %-H:%M') ELSE strftime(ts, '%d-%m-%Y %H:%M:%S') END AS request_timestamp,
    CASE WHEN event_type = 'error' THEN NULL
         WHEN event_id % 2 = 0 THEN strftime(ts + to_minutes(CAST(floor(value) AS BIGINT)), '%d/%m/%Y %-H:%M')
         ELSE strftime(ts + to_minutes(CAST(floor(value) AS BIGINT)), '%d-%m-%Y %H:%M:%S') END AS drop_timestamp
  FROM events)"""


# --------------------------------------------------------------------------
# Ratings (lineitem x orders): one rating per (customer, part) pair
# --------------------------------------------------------------------------
def ratings(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    g = (li.join(o, li.l_orderkey == o.o_orderkey)
         .groupBy("o_custkey", "l_partkey")
         .agg((F.round(F.avg("l_quantity") / 5) / 2).alias("review_overall")))
    return g.select(
        F.col("l_partkey").alias("beer_beerid"),
        F.when(F.col("o_custkey") % 37 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("User"), _s("o_custkey"))).alias("review_profilename"),
        F.col("o_custkey").alias("user_id"),
        "review_overall",
    )


RATINGS_SQL = """ratings AS (
  SELECT l_partkey AS beer_beerid,
    CASE WHEN o_custkey % 37 = 0 THEN NULL ELSE 'User' || CAST(o_custkey AS VARCHAR) END AS review_profilename,
    o_custkey AS user_id, round(avg(l_quantity) / 5) / 2 AS review_overall
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_custkey, l_partkey)"""


# --------------------------------------------------------------------------
# Cars (lineitem x part)
# --------------------------------------------------------------------------
# Car makes including the misspellings repaired by the analysis.
CAR_MAKES = ["alfa-romero", "audi", "bmw", "maxda", "mazda", "nissan", "Nissan", "porcshce",
             "porsche", "toyota", "toyouta", "vokswagen", "volkswagen", "vw"]
CAR_FIXES = [("maxda", "mazda"), ("porcshce", "porsche"), ("vokswagen", "volkswagen"),
             ("vw", "volkswagen"), ("Nissan", "nissan"), ("toyouta", "toyota")]


def cars(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    p = read_table(spark, d, "part")
    makes = F.array(*[F.lit(m) for m in CAR_MAKES])
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.conv(F.substring(F.md5(F.concat_ws("|", *[_s(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                                             F.date_format("l_shipdate", "yyyy-MM-dd"))), 1, 15), 16, 10)
        .cast("long").alias("car_id"),
        F.concat_ws(" ", F.element_at(makes, (F.col("p_partkey") % len(CAR_MAKES) + 1).cast("int")),
                    F.col("p_name")).alias("carname"),
        F.col("p_type").alias("carbody"),
        F.when(F.col("l_returnflag") == "R", "two").otherwise("four").alias("doornumber"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("retailprice"),
        F.col("p_size").cast("double").alias("size"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_extendedprice").alias("price"),
    )


def _car_makes_sql() -> str:
    return "[" + ", ".join(f"'{m}'" for m in CAR_MAKES) + "]"


CARS_SQL = f"""cars AS (
  SELECT CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
           CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d'))), 1, 15) AS BIGINT) AS car_id,
    concat_ws(' ', ({_car_makes_sql()})[CAST(p_partkey % {len(CAR_MAKES)} AS INTEGER) + 1], p_name) AS carname,
    p_type AS carbody, CASE WHEN l_returnflag = 'R' THEN 'two' ELSE 'four' END AS doornumber,
    l_quantity AS quantity, p_retailprice AS retailprice, CAST(p_size AS DOUBLE) AS size,
    l_discount AS discount, l_tax AS tax, l_extendedprice AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# --------------------------------------------------------------------------
# Churn (documents x labels) with a deterministic score for evaluation
# --------------------------------------------------------------------------
def churn(spark: SparkSession, d: str) -> DataFrame:
    doc = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lab = read_table(spark, d, "labels")
    j = doc.join(lab, "doc_id")
    return j.select(
        F.col("doc_id").alias("customer_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("n_words"),
        "lang", "source",
        F.col("quality").cast("double").alias("quality"),
        F.when(F.col("toxic") == 1, "Yes").otherwise("No").alias("churn"),
        ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("score"),
    )


CHURN_SQL = """churn AS (
  SELECT doc_id AS customer_id, CAST(n_chars AS DOUBLE) AS n_chars,
    CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS DOUBLE) AS n_words,
    lang, source, CAST(quality AS DOUBLE) AS quality,
    CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS churn,
    (doc_id * 7919 % 1000) / 1000.0 AS score
  FROM documents JOIN labels USING (doc_id))"""


# --------------------------------------------------------------------------
# Employee attendance (events): long (employee, day, in, out)
# --------------------------------------------------------------------------
def attendance(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return (e.groupBy(F.col("user_id").alias("employee_id"), F.to_date("ts").alias("day"))
            .agg(F.min("ts").alias("in_time"), F.max("ts").alias("out_time")))


ATTENDANCE_SQL = """attendance AS (
  SELECT user_id AS employee_id, CAST(ts AS DATE) AS day, min(ts) AS in_time, max(ts) AS out_time
  FROM events GROUP BY user_id, CAST(ts AS DATE))"""


# --------------------------------------------------------------------------
# Superstore-style sales (lineitem x orders x customer x nation x region)
# --------------------------------------------------------------------------
def sales(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders")
    c = read_table(spark, d, "customer")
    n = read_table(spark, d, "nation")
    r = read_table(spark, d, "region")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
         .join(F.broadcast(r), n.n_regionkey == r.r_regionkey))
    return j.select(
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("order_date"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("market"),
        F.col("l_extendedprice").alias("sales"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) - 0.9 * F.col("l_extendedprice")).alias("profit"),
    )


SALES_SQL = """sales AS (
  SELECT strftime(o_orderdate, '%d-%m-%Y') AS order_date, c_mktsegment AS segment, r_name AS market,
    l_extendedprice AS sales, l_quantity AS quantity,
    l_extendedprice * (1 - l_discount) - 0.9 * l_extendedprice AS profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --------------------------------------------------------------------------
# Electronics sales (lineitem x orders x part), all years; the analysis
# period is chosen by the job, not here
# --------------------------------------------------------------------------
def mmm_sales(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    o = read_table(spark, d, "orders")
    p = read_table(spark, d, "part")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    delay = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return j.select(
        F.col("p_partkey").alias("fsn_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.when(F.col("l_tax") == 0, F.lit(0.0))
        .otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("gmv"),
        F.col("l_quantity").alias("units"),
        F.when(F.col("l_linenumber") == 7, r"\N").otherwise(_s(delay)).alias("deliverybdays"),
        F.when(F.col("l_linenumber") == 6, r"\N").otherwise(_s(delay - 1)).alias("deliverycdays"),
        F.when(F.col("o_orderstatus") == "F", "Prepaid").otherwise("COD").alias("payment_type"),
        (F.col("l_linenumber") * 3).cast("int").alias("sla"),
        F.col("o_custkey").alias("cust_id"),
        F.col("p_type").alias("sub_category"),
        F.col("p_brand").alias("vertical"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("product_mrp"),
        F.col("p_retailprice").alias("list_mrp"),
        (F.col("p_size") % 10).cast("int").alias("procurement_sla"),
    )


MMM_SALES_SQL = """mmm_sales AS (
  SELECT p_partkey AS fsn_id, CAST(o_orderdate AS DATE) AS order_date, o_orderkey AS order_id,
    l_linenumber AS order_item_id, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_extendedprice * (1 - l_discount) END AS gmv,
    l_quantity AS units,
    CASE WHEN l_linenumber = 7 THEN '\\N'
         ELSE CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS VARCHAR) END AS deliverybdays,
    CASE WHEN l_linenumber = 6 THEN '\\N'
         ELSE CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 1 AS VARCHAR) END AS deliverycdays,
    CASE WHEN o_orderstatus = 'F' THEN 'Prepaid' ELSE 'COD' END AS payment_type,
    CAST(l_linenumber * 3 AS INTEGER) AS sla, o_custkey AS cust_id, p_type AS sub_category, p_brand AS vertical,
    l_extendedprice / l_quantity AS product_mrp, p_retailprice AS list_mrp,
    CAST(p_size % 10 AS INTEGER) AS procurement_sla
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


SQL = {
    "tickets": TICKETS_SQL, "season_tickets": SEASON_TICKETS_SQL, "companies": COMPANIES_SQL,
    "rounds": ROUNDS_SQL, "sector_mapping": SECTOR_MAPPING_SQL, "rides": RIDES_SQL,
    "ratings": RATINGS_SQL, "cars": CARS_SQL, "churn": CHURN_SQL, "attendance": ATTENDANCE_SQL,
    "sales": SALES_SQL, "mmm_sales": MMM_SALES_SQL,
}


def with_standins(names: list[str], body: str) -> str:
    """Prefix `body` (a SELECT, or further CTE definitions then a SELECT) with
    the DuckDB definitions of the named stand-ins."""
    defs = ",\n".join(SQL[n] for n in names)
    body = body.strip()
    if not defs:
        starts = body.split(None, 1)[0].upper()
        return body if starts in ("SELECT", "WITH") else "WITH " + body
    first = body.split(None, 1)[0].upper()
    if first == "WITH":
        body = body.split(None, 1)[1]
    sep = "\n" if first == "SELECT" else ",\n"
    return f"WITH {defs}{sep}{body}"
