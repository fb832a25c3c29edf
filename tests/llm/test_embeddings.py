import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import embeddings as em
from kestrel.llm import queries
from tests.llm.helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    ok = {}
    for k, (i, e, l) in enumerate(rows):
        if l is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(v for v in e):
            ok[k] = np.array(e, np.float32).astype(np.float64)
    pairs = []
    keys = list(ok)
    for x, a in enumerate(keys):
        for b in keys[:x]:
            if rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= cosine:
                    pairs.append((b, a))
    comp = components(range(len(rows)), pairs)
    links = [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    small = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            small[comp[k]] = min(small.get(comp[k], i), i)
    return sorted(((r[0], links[k], small.get(comp[k])) for k, r in enumerate(rows)), key=str)


def corpus(dim, seed=0, n=220):
    rng = np.random.default_rng(seed)
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * dim, 1), (3, [float("nan")] * dim, 1), (4, [1.0] * (dim - 1) + [None], 1),
            (5, [float("inf")] + [1.0] * (dim - 1), 1), (6, [1.0] * dim, None), (7, [1.0] * dim, 1), (8, [2.0] * dim, 1),
            (9, [1.0] * dim, 1), (10, [1.0] * dim, 2), (11, [1.0] * (dim + 1), 1), (12, [-0.0] * (dim - 1) + [1.0], 1)]
    base = rng.standard_normal((12, dim))
    for i in range(13, n):
        if i % 3:
            b = base[rng.integers(12)]
            v = b + rng.standard_normal(dim) * np.linalg.norm(b) / np.sqrt(dim) * rng.choice([0.05, 0.12, 0.16, 0.2])
        else:
            v = rng.standard_normal(dim)
        rows.append((i, (v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(2))))
    return rows + [(n, rows[20][1], rows[20][2]), (21, rows[21][1], rows[21][2])]


@pytest.mark.parametrize("dim,params", [(64, em.NearVectorParams()), (64, em.NearVectorParams(group=3, tile=7)),
                                        (13, em.NearVectorParams()), (2, em.NearVectorParams())])
def test_against_brute_force(spark, dim, params):
    rows = corpus(dim)
    d = spark.createDataFrame(rows, SCHEMA).withColumn("cid", F.lit(1)).withColumn("e", F.lit("x")).repartition(5)
    out = em.near_duplicates(d, params=params).collect()
    want = brute(rows)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert sum(w[1] for w in want) > 50


def test_empty_and_null_ids(spark):
    assert em.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = em.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(4, 1, 4, True), (None, 1, 4, False)]


def test_sql_on_a_fixture(spark, tmp_path):
    rows = [(i, *r[1:]) for i, r in enumerate(corpus(64, seed=3))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, queries.QUERIES["op5_embedding_neardup"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(queries.ORACLE["op5_embedding_neardup"]).fetchall())


def test_some_block_is_within_its_budget():
    rng = np.random.default_rng(2)
    p = em.NearVectorParams()
    for dim in (1, 5, 8, 13, 64, 70):
        assert np.allclose(em.rotation(dim, 5) @ em.rotation(dim, 5).T, np.eye(dim))
        a = em._unit(rng.standard_normal((400, dim)))
        b = em._unit(a + rng.standard_normal((400, dim)) * 0.2 / np.sqrt(dim))
        near = (a * b).sum(1) >= p.cosine
        ra, rb = a @ em.rotation(dim, 5), b @ em.rotation(dim, 5)
        hit = np.zeros(400, bool)
        for lo, hi, budget in em.blocks(dim, p):
            hit |= ((ra - rb)[:, lo:hi] ** 2).sum(1) <= budget
        assert hit[near].all()
