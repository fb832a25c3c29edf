import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kestrel.llm import linededup, queries
from tests.llm.helpers import SCHEMA, words

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(SPACE).translate(lower)
    holders = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(i)
    last = {k: max(v - {None}) for k, v in holders.items() if len(v - {None}) >= min_docs}  # documents: distinct ids
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    shared = [words(rng, 6) for _ in range(8)] + ["Ünïcode líne öf twenty", "short line", "x" * 19, "é" * 20]
    rows = [(None, shared[0]), (1, None), (2, ""), (3, "\n\n"), (4, f"{shared[1]}\n{shared[1].upper()}\n  {shared[1]}\t")]
    for i in range(5, n):
        lines = [rng.choice(shared) if rng.random() < 0.4 else words(rng, rng.randint(1, 8)) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else f" {x}\r" if rng.random() < 0.2 else x for x in lines)))
    rows += [rows[7], rows[7], (n, shared[2] + "\n" + "long " * 60000)]
    return rows


@pytest.mark.parametrize("params", [linededup.LineDedupParams(), linededup.LineDedupParams(broadcast_keys=0),
                                    linededup.LineDedupParams(max_segments=1)])
def test_against_brute_force(spark, params):
    rows = corpus()
    d = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows], SCHEMA).repartition(7) \
        .withColumn("drops", F.lit(1)).withColumn("rewritten", F.lit(2)).withColumn("id", F.lit("c"))
    got = linededup.dedup_lines(d, params=params)
    assert got.columns == [*d.columns, "n_lines", "n_dropped"]
    out = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str)
    assert out == brute(rows)
    assert {(r["drops"], r["rewritten"], r["id"], r["lang"]) for r in got.collect()} == {(1, 2, "c", "a")}


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_sql_on_a_fixture(spark, tmp_path):
    rows = [(i, t) for i, t in dict(corpus()).items() if i is not None]
    spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLE["op2_line_dedup"]).fetchall())
    assert dict((r[0], r[3]) for r in got)[1] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("params", [linededup.LineDedupParams(), linededup.LineDedupParams(broadcast_keys=0)])
def test_rows_that_share_an_id_are_one_document(spark, params):
    line = "a line that two documents hold in three rows"
    rows = [(1, line), (1, line), (2, line), (3, "x" + line), (3, "x" + line), (4, "x" + line), (5, "x" + line), (None, "x" + line)]
    d = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup_lines(d, params=params).collect()), key=str)
    assert got == sorted([(1, line), (1, line), (2, line), (3, ""), (3, ""), (4, ""), (5, "x" + line), (None, "")], key=str)


def test_suspects_never_miss_a_repeat():
    import numpy as np
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)
    b[:700] = a[:700]
    import pyarrow as pa
    import zstandard
    pack = zstandard.ZstdCompressor()
    rows = sorted((s, x) for h in (a, b) for s, x in linededup._segments(h, 16))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                        pa.array([pack.compress(r[1]) for r in rows]),
                                        pa.array([None] * len(rows), pa.binary())], names=["segment", "once", "twice"])
    found = {}
    for out in linededup._merge(iter([batch])):
        found |= dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    seen = linededup.TwiceSeen(16, found)
    assert seen.suspects(a[:700]).all()
    assert seen.suspects(a[700:]).mean() < 0.05
