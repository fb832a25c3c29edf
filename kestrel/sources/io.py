"""Sources and sinks (A1-A11): parquet/CSV/delimited scans, null sentinels,
wide monthly extracts, SQL views, calendars and shape reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Columnar parquet scan; projections and filters written later are pushed
    into this scan by Catalyst (ReadSchema / PushedFilters)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, sep: str = ",", null_value: str | None = None) -> DataFrame:
    """A1/A2: CSV or delimited text.  An explicit schema avoids the extra
    inference pass over the whole input (inferSchema reads the data twice)."""
    r = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


#: What a value can be read as, as a bit each; a column's set of bits is the `bit_or` of its rows.
INT, LONG, DOUBLE, TIMESTAMP, TEXT = 1, 2, 4, 8, 16
_WHOLE, _NUMBER = r"^[+-]?[0-9]+$", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?)?$"


def value_kind(x: str) -> Column:
    """The narrowest of INT, LONG, DOUBLE, TIMESTAMP, TEXT that holds the string column `x`; 0 for null and blank ones."""
    v = F.trim(F.col(x))
    return F.when(v.isNull() | (v == ""), 0).when(v.rlike(_WHOLE) & v.try_cast("int").isNotNull(), INT) \
        .when(v.rlike(_WHOLE) & v.try_cast("long").isNotNull(), LONG).when(v.rlike(_NUMBER), DOUBLE) \
        .when(v.rlike(_MOMENT) & v.try_cast("timestamp").isNotNull(), TIMESTAMP).otherwise(TEXT)


def joined_type(kinds: int) -> str:
    """The least type above all kinds seen: int < long < double < string, timestamp < string; a column of nulls is a string."""
    if kinds in (0, TIMESTAMP):
        return "timestamp" if kinds else "string"
    if kinds & TEXT or kinds & TIMESTAMP:
        return "string"
    return "double" if kinds & DOUBLE else "long" if kinds & LONG else "int"


def infer_types(raw: DataFrame, corrupt: str | None = None) -> tuple[dict[str, str], int, int]:
    """A1: the type of every string column over all rows, the number of rows and of corrupt ones.

    One aggregate: each task ORs a few bits per column, so a value that changes a column's type counts
    wherever in the data it stands, and only the bits reach the driver.  `corrupt` names the column that the reader
    fills with malformed rows; those count, but say nothing about types."""
    names = [c for c in raw.columns if c != corrupt]
    good = F.col(corrupt).isNull() if corrupt else F.lit(True)
    row = raw.agg(F.count(F.lit(1)).alias("n"), F.count_if(~good).alias("bad"),
                  *[F.bit_or(F.when(good, value_kind(c)).otherwise(0)).alias(f"k{i}") for i, c in enumerate(names)]).first()
    return {c: joined_type(row[f"k{i}"] or 0) for i, c in enumerate(names)}, row["n"], row["bad"]


def read_csv_inferred(spark: SparkSession, path: str, names: list[str], header: bool = True, sep: str = ",") -> tuple[DataFrame, dict[str, str], int]:
    """A1: a CSV of unknown types -> typed rows, the types, the number of corrupt rows (left out: those with
    too many or too few fields).  The header gives the order, `names` the column names."""
    mark = next(f"_corrupt{k or ''}" for k in range(len(names) + 1) if f"_corrupt{k or ''}" not in names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, mark]])
    raw = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("enforceSchema", True) \
        .option("columnPruning", False).option("columnNameOfCorruptRecord", mark).schema(schema).csv(path)
    types, _, bad = infer_types(raw, mark)
    whole = F.length(F.coalesce(names[0], F.lit(""))) >= 0   # always true: Spark refuses to read the marks alone
    rows = raw.filter(F.col(mark).isNull() & whole)
    typed = [F.col(c) if t == "string" else F.when(F.trim(c) != "", F.trim(c)).try_cast(t).alias(c) for c, t in types.items()]
    return rows.select(*typed), types, bad


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None) -> None:
    """A5: sink.  Writes are task-parallel; nothing goes through the driver."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def with_header(df: DataFrame, names: list[str]) -> DataFrame:
    """A2: headerless file -> named columns (positional names `_c0..` replaced)."""
    return df.toDF(*names)


def null_sentinels(df: DataFrame, sentinels=("", "NA"), columns: list[str] | None = None) -> DataFrame:
    """A3: treat several sentinel strings as NULL (CSV `nullValue` takes only one)."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    s = list(sentinels)
    return df.select(*[
        (F.when(F.trim(F.col(c)).isin(s), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
         if c in cols else F.col(c)) for c in df.columns])


# English month names and abbreviations.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def wide_months_to_long(df: DataFrame, id_cols: list[str], month_cols: list[str],
                        value_name: str = "value", year_of=None) -> DataFrame:
    """A4: headerless wide monthly sheet (one column per month) -> keyed long
    rows (ids..., month_num, value).  `month_cols` are given in calendar order."""
    long = df.unpivot(id_cols, month_cols, "month_col", value_name)
    mapping = F.create_map(*[x for i, c in enumerate(month_cols) for x in (F.lit(c), F.lit(i + 1))])
    return long.withColumn("month", mapping[F.col("month_col")]).drop("month_col")


def shape_report(df: DataFrame) -> DataFrame:
    """(column, position, data_type, is_numeric, n_rows, n_cols).
    One count job; the schema part is metadata only."""
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(f.name, i + 1, f.dataType.simpleString(), isinstance(f.dataType, numeric))
         for i, f in enumerate(df.schema.fields)],
        "column string, position int, data_type string, is_numeric boolean")
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    return meta.withColumn("n_rows", n_rows).withColumn("n_cols", F.lit(len(df.columns)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp dir, so every executor sees the same files)."""
    import uuid

    from kestrel.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/kestrel-io/{name}-{uuid.uuid4().hex}"
