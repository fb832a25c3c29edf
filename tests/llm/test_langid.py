import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm import langid, queries
from kestrel.llm.common import fold
from tests.llm.helpers import SCHEMA

TRAIN = [(i, t, l, "s", 1) for i, (t, l) in enumerate(
    [("the cat sat on the mat. the hat", "en"), ("this that the other then", "en"),
     ("der hund und die katze sind da", "de"), ("das ist ein schöner hut und", "de")] * 3)]


def brute_lengths(train: dict[str, list[str]], text: str, order: int) -> dict[str, float]:
    """Code length by the definition: one dictionary per language, escape to the shorter context."""
    fold_byte = lambda b: (b if b >= 128 or chr(b).isalpha() else 32) if not 65 <= b <= 90 else b + 32
    seq = lambda t: [32] * order + [fold_byte(b) for b in t.encode()]
    used = {b for ts in train.values() for t in ts for b in seq(t)}
    symbols = sorted(used) + ["other"]
    out = {}
    for lang, ts in train.items():
        count = Counter()
        for t in ts:
            s = seq(t)
            for i in range(order, len(s)):
                for d in range(order + 1):
                    count[tuple(s[i - d:i]), s[i]] += 1

        def prob(ctx, memo={}):
            key = (lang, ctx)
            if key in memo:
                return memo[key]
            base = prob(ctx[1:]) if ctx else None
            got = {s: count[ctx, s] for s in symbols if count[ctx, s]}
            shorter = {s: 1 / len(symbols) for s in symbols} if base is None else base
            if not got:
                p = shorter
            else:
                n, q = sum(got.values()), len(got)
                left = sum(v for s, v in shorter.items() if s not in got)
                p = {s: got[s] / (n + q) if s in got else q / (n + q) * shorter[s] / left for s in symbols} \
                    if left > 0 else {s: got.get(s, 0) / n for s in symbols}
            memo[key] = p
            return p
        known = lambda b: b if b in used else "other"
        s = [known(b) for b in seq(text)]
        out[lang] = -sum(math.log2(prob(tuple(s[i - order:i]))[s[i]]) for i in range(order, len(s)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(TRAIN, SCHEMA), F.lit(True))


@pytest.mark.parametrize("text", ["the hut", "Katze!", "x", "zzz qqq 123", "über den hund " * 40, "日本 the"])
def test_code_lengths_match_the_definition(model, text):
    train = {}
    for _, t, l, _, _ in TRAIN:
        train.setdefault(l, []).append(t)
    want = brute_lengths(train, text, 3)
    got = langid.code_lengths(model, text.encode(), chunk=64)
    assert model.langs == sorted(want)
    assert np.allclose(got, [want[x] for x in model.langs], rtol=1e-4, atol=1e-3)


def test_edges_and_clashing_columns(spark, model):
    rows = [(1, None, None, None, 0), (2, "", "x", None, 0), (3, " 12 !?", "x", None, 0), (3, " 12 !?", "x", None, 0),
            (None, "the cat", "x", None, 0), (5, "der hund und " * 20000, None, None, 0)]
    d = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(0))
    got = sorted(map(tuple, langid.predict(d, model).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == 6 and all(by[i][1:] == ("und", 0.0, None) for i in (1, 2, 3))
    assert by[None][1] == "en" and by[5][1] == "de" and 0 <= by[5][2] <= 1


def test_empty_tables(spark, model):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.fit(empty, F.lit(True)) is None
    assert langid.predict(empty, model).count() == 0
    assert langid.predict(spark.createDataFrame(TRAIN, SCHEMA), None).filter("lang_pred = 'und'").count() == len(TRAIN)


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    held = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98
    assert docs.filter((fold("doc_id", 3) == 1)).count() == n
