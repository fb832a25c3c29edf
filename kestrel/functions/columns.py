"""Column shaping (B1-B19) and scalar functions.

All of these build JVM-side expressions (whole-stage codegen, no Python in
the data path).  Raw text is parsed with the `try_*` family so ANSI mode stays
on and dirty values become NULL instead of failing the job.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---------------------------------------------------------------- B: columns
def normalize_column_names(df: DataFrame) -> DataFrame:
    """Trim, inner spaces -> '_', lower-case."""
    return df.toDF(*[re.sub(" ", "_", c.strip()).lower() for c in df.columns])


def drop_constant_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop columns with a single distinct value (NULL counts as a value).

    One aggregate pass: min == max and no mix of null/non-null.  The decision
    (a handful of booleans) is the only thing collected."""
    cols = columns or df.columns
    aggs = []
    for c in cols:
        aggs.append(((F.min(c) == F.max(c)) & ((F.count(c) == F.count(F.lit(1))) | (F.count(c) == 0))
                     | F.min(c).isNull()).alias(c))
    flags = df.agg(*aggs).first().asDict()
    return df.drop(*[c for c in cols if flags[c]])


def constant_column_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """B4 as data: (column, n_null, n_rows, is_constant) in ONE pass of
    min / max / null counts — a column is constant when it holds a single
    value (NULL counting as a value).  No per-column distinct aggregates
    (those would expand every row once per column)."""
    cols = columns or df.columns
    n = F.count(F.lit(1))
    structs = []
    for c in cols:
        nn = F.count(c)
        const = ((nn == 0) | ((nn == n) & (F.min(c) == F.max(c))))
        structs.append(F.struct(F.lit(c).alias("column"), (n - nn).alias("n_null"), n.alias("n_rows"),
                                const.alias("is_constant")).alias(f"s{len(structs)}"))
    wide = df.agg(*structs)
    return (wide.select(F.explode(F.array(*[f"s{i}" for i in range(len(cols))])).alias("s"))
            .select("s.column", "s.n_null", "s.n_rows", "s.is_constant"))


def split_columns(col: str, into: list[str], sep: str) -> list[Column]:
    """separate(col, into, sep) -> one column per piece (regex `sep`)."""
    parts = F.split(F.col(col), sep)
    return [F.get(parts, i).alias(name) for i, name in enumerate(into)]


def first_token(col: str, sep: str = "|") -> Column:
    """First element of a delimited list (null-safe)."""
    return F.split(F.col(col), "[" + re.escape(sep) + "]").getItem(0)


def bin_by_ranges(col: Column, bins: list[tuple[int, int, str]]) -> Column:
    """CASE binning — inclusive (lo, hi, label) ranges."""
    expr = None
    for lo, hi, label in bins:
        cond = col.between(lo, hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


# Six four-hour bins of the day and their labels.
HOUR_BINS = [
    (0, 3, "0_to_3_AM_Hrs"), (4, 7, "4_to_7_AM_Hrs"), (8, 11, "8_to_11_AM_Hrs"),
    (12, 15, "12_to_15_PM_Hrs"), (16, 19, "16_to_19_PM_Hrs"), (20, 24, "20_to_00_PM_Hrs"),
]

# Seasons by month number.
SEASONS = [("WINTER", (12, 1, 2)), ("SPRING", (3, 4, 5)), ("SUMMER", (6, 7, 8)), ("FALL", (9, 10, 11))]


def season_of_month(month: Column) -> Column:
    expr = None
    for name, months in SEASONS:
        cond = month.isin(*months)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def flag_binary(col: Column, positive) -> Column:
    """1 when col == positive else 0 (NULL stays NULL)."""
    return F.when(col.isNull(), F.lit(None).cast("int")).when(col == positive, 1).otherwise(0)


def recode_values(col: Column, mapping: dict) -> Column:
    """Value map; unmapped values pass through unchanged."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[col], col)


def cap_upper(col: Column, cap) -> Column:
    """Winsorise at an upper bound (NULL stays NULL)."""
    return F.when(col > cap, F.lit(cap)).otherwise(col)


def floor_invalid_to_zero(col: Column, to: str = "int") -> Column:
    """Text with sentinels (e.g. '\\N') or negatives -> 0."""
    v = col.try_cast(to)
    return F.greatest(F.coalesce(v, F.lit(0).cast(to)), F.lit(0).cast(to))


# ------------------------------------------------------------ I: scalar fns
def repair_corrupt_text(col: Column, bad: str = "0", good: str = "na",
                        keep: tuple[str, str] | None = ("Enterprise 2.na", "Enterprise 2.0")) -> Column:
    """I4: replace every `bad` by `good`, then undo the one legitimate use."""
    fixed = F.replace(col, F.lit(bad), F.lit(good))
    if keep:
        fixed = F.regexp_replace(fixed, "^" + re.escape(keep[0]) + "$", keep[1])
    return fixed


def count_occurrences(col: Column, pattern: str) -> Column:
    """Occurrences of a regex pattern."""
    return F.regexp_count(col, F.lit(pattern))


def parse_date(col: Column, fmt: str) -> Column:
    """I8: text -> DATE, NULL when unparseable."""
    return F.try_to_date(col, fmt)


def parse_timestamp_multi(col: Column, formats: list[str]) -> Column:
    """First format that parses wins."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats])


def compact_time_to_timestamp(date_col: Column, time_col: Column) -> Column:
    """I2/I3/I7/I9: 'hhmmA' / 'hhmmP' 12-hour compact time + a DATE ->
    TIMESTAMP.  Hour '00' is read as 12 (as the source data uses both);
    anything unparseable (bad hour, minute or AM/PM letter) gives NULL."""
    hour = F.regexp_replace(F.substring(time_col, 1, 2), "00", "12")
    minute = F.substring(time_col, 3, 2)
    ampm = F.regexp_replace(F.regexp_replace(F.substring(time_col, 5, 1), "A", "AM"), "P", "PM")
    text = F.concat_ws(" ", F.date_format(date_col, "yyyy-MM-dd"), F.concat_ws(":", hour, minute, ampm))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd h:mm:a"))


def week_of_year_simple(d: Column) -> Column:
    """week() = floor((day_of_year - 1) / 7) + 1."""
    return (F.floor((F.dayofyear(d) - 1) / 7) + 1).cast("int")


def week_start_sunday(d: Column) -> Column:
    """Floor a date to the Sunday that starts its week."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def minutes_between(end: Column, start: Column) -> Column:
    """Duration in minutes (fractional)."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 6.0e7


def safe_log(col: Column, zero_to: float = 1e-5) -> Column:
    """Log after replacing exact zeros."""
    return F.log(F.when(col == 0, F.lit(zero_to)).otherwise(col))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def exact_sum(col) -> Column:
    """Order-independent sum of doubles: accumulated as DECIMAL(38, 10), so
    every partitioning / merge order gives the same bits (a float sum's last
    digits depend on the order partial sums are combined in)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(38,10)")).cast("double")


def exact_mean(col) -> Column:
    """Mean via `exact_sum` / count (reproducible across engines and runs)."""
    c = F.col(col) if isinstance(col, str) else col
    return exact_sum(c) / F.count(c)
