"""Every query with an oracle must equal its DuckDB SQL on the small tables
(row count, column names, values; order-insensitive)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from kestrel.sources.io import TABLES
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _rows(tbl):
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    return cols, sorted(tuple(_norm(x) for x in r) for r in zip(*data))


def test_every_query_has_unique_key():
    assert len(QUERIES) == len(set(QUERIES))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_duckdb(spark, con, key):
    got = QUERIES[key](spark, SF_SMALL).toArrow()
    want = con.sql(SQL[key]).to_arrow_table()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["violation_hour_bin", "violation_code", "frequency_of_tickets", "rnk"]
    assert df.count() > 0
