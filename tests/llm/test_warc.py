import gzip
import hashlib

import duckdb
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from kestrel.llm import queries, warc

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "é" * 60
ROWS = [(5, "http://a/ b\n", BIG), (2, "http://b/", BIG), (9, None, BIG), (3, "http://c/", None), (4, "u", ""), (6, "u", "x" * 99),
        (7, "u", "x" * 99), (8, "v", "y" * 100), (1, "v", "z" * 100 + "\r\n\r\n"), (10, "w", "long " * 300000), (11, "w", "y" * 100)]


def brute(rows):
    first = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        to = first.get(b)
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_with_odd_rows(spark):
    rows = ROWS + [ROWS[3], ROWS[0], (None, None, BIG), (None, "q", "small")]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("offset", F.lit("x")).repartition(3)
    index, folder = warc.write(d)
    assert digest(warc.read(index, folder)) == brute(rows)
    small = warc.WarcParams(gap=0, read=1, split=200, broadcast_revisits=0)
    assert digest(warc.read(index, folder, params=small)) == brute(rows)
    assert digest(warc.round_trip(d, small)) == brute(rows)
    texts = {r["page_id"]: r["payload"] for r in warc.read(index, folder).filter("record_type = 'response'").collect()}
    assert bytes(texts[1]) == ROWS[8][2].encode() and bytes(texts[10]) == ROWS[9][2].encode() and bytes(texts[3]) == b""


def test_selected_records_only(spark):
    index, folder = warc.write(spark.createDataFrame(ROWS, SCHEMA).repartition(2))
    got = warc.read(index, folder, F.col("page_id").isin(1, 8, 11))
    assert digest(got) == [r for r in brute(ROWS) if r[0] in (1, 8, 11)]
    assert {r["page_id"]: r["url"] for r in got.collect()} == {1: "v", 8: "v", 11: "w"}


def test_archives_are_warc_files(spark):
    index, folder = warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1))
    fs, path = warc._open(folder)
    files = {r["file"] for r in index.collect()}
    raw = b"".join(gzip.decompress(fs.open_input_file(f"{path}/{f}").read()) for f in files)
    assert raw.count(b"WARC/1.1\r\nWARC-Type: response\r\n") == 8 and raw.count(b"WARC-Type: revisit\r\n") == 3
    assert b"WARC-Target-URI: http://a/%20b%0A\r\n" in raw
    ends = sorted((r["offset"], r["length"]) for r in index.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0


def test_ranges_are_coalesced():
    p = warc.WarcParams(gap=10, read=100)
    e = [("a", 0, 20), ("a", 25, 20), ("a", 60, 10), ("a", 71, 30), ("b", 0, 500), ("b", 500, 5)]
    assert [len(g) for g in warc._ranges(iter(e), p)] == [2, 2, 1, 1]


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_on_a_fixture(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.QUERIES["op10_warc"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLE["op10_warc"]).fetchall()) == sorted(brute(ROWS))
