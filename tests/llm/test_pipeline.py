import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import quality, queries
from kestrel.llm.common import fold
from tests.llm import test_decontaminate, test_linededup, test_simhash
from tests.llm.helpers import SCHEMA, words
from tests.llm.test_mixing import waterfill
from kestrel.llm.mixing import MixParams


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(9)
    shared = [words(rng, 9) for _ in range(5)]
    items = [(k, words(rng, 25)) for k in range(12)]
    rows, labels = [], []
    for i in range(260):
        lines = [words(rng, rng.randint(4, 14)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(0, rng.choice(shared))
        if i % 11 == 0:
            lines.append(rng.choice(items)[1])
        text = "\n".join(lines)
        bad = i % 7 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, "en", rng.choice(["a", "a", "a", "b", None]), 0))
        labels.append((i, int(not bad), 0))
    rows += [(300 + k, rows[k + 1][1], "en", "b", 0) for k in range(12)]
    rows += [(400, None, None, None, None), (401, "", "en", "a", 0), (402, "\n".join(shared), "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_run_equals_the_stages_by_brute_force(spark, tables):
    path, rows, items = tables
    got = queries.QUERIES["pipeline"](spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "round"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"), fold("doc_id", 5) > 0)
    p = {r["doc_id"]: r["p"] for r in quality.with_score(docs, model, name="p").collect()}
    source = {r[0]: r[3] for r in rows}
    kept = [(i, t) for i, t, *_ in rows if p[i] >= 0.3]
    assert 20 < len(rows) - len(kept) < 60 and all(i % 7 == 0 for i, *_ in rows if i < 260 and p[i] < 0.3)
    text = {i: t for i, t, _, _ in test_linededup.brute(kept)}
    assert any(t != dict(kept)[i] for i, t in text.items())
    comp = {i: c for i, _, c in test_simhash.brute(list(text.items()))}
    text = {i: t for i, t in text.items() if comp[i] == i}
    assert len(text) <= len(kept) - 8                   # most of the twelve copies are gone
    bad = {w[0] for w in test_decontaminate.brute(list(text.items()), items)}
    assert bad
    text = {i: t for i, t in text.items() if i not in bad}
    out = {}
    for r in got.collect():
        assert r["text"] == text[r["doc_id"]] and r["n_chars"] == len(r["text"]) and r["score"] == "x"
        out.setdefault(r["doc_id"], []).append(r["round"])
    assert all(sorted(v) == list(range(len(v))) and len(v) <= 2 for v in out.values())
    size = {}
    for i, t in text.items():
        size[source[i]] = size.get(source[i], 0) + len(t.split())
    goal = waterfill(size, MixParams())
    for s in size:
        taken = sum(len(v) * len(text[i].split()) for i, v in out.items() if source[i] == s)
        assert abs(taken - goal[s]) <= 90


def test_stages_take_empty_and_odd_tables(spark, tables):
    path, rows, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.limit(0)
    strange = docs.withColumn("n_lines", F.lit(1)).withColumn("size", F.lit("s")).withColumn("held", F.lit(0)) \
        .unionByName(docs.limit(3).selectExpr("null as doc_id", "text", "lang", "source", "n_chars", "score",
                                              "1 as n_lines", "'s' as size", "0 as held"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, path).count() == 0
        out = stage(spark, strange, path)
        want = strange.columns + (["round"] if name == "source_mixing" else [])
        assert out.columns == want and out.count() > 100


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
