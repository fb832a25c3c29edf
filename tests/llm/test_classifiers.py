"""Quality and toxicity: accuracy on held-out rows, and defined results in every odd case."""

import random

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from kestrel.llm import quality, queries, toxicity
from kestrel.llm.common import fold
from tests.llm.helpers import SCHEMA, docs_of, words

LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.01"
ODD = [(1000, None), (1001, ""), (1002, " "), (None, "some plain words"), (1003, "good words " * 40000)]


def made(spark, n=240):
    """Good prose, shouted junk as bad, and insults as toxic."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 4 == 0
        ws = words(rng, rng.randint(20, 60)).split()
        if bad:
            ws = [w.upper() + "!!" for w in ws]
        if toxic:
            ws.insert(rng.randrange(len(ws)), rng.choice(["zounds", "zoundser", "blighter", "Blighters"]))
        rows.append((i, " ".join(ws)))
        if i % 2 or toxic:
            labels.append((i, int(not bad), int(toxic)))
    labels += [(0, None, None), (None, 1, 1), (3, 7, -1), labels[1]]
    d = docs_of(spark, rows + ODD + [rows[5]]).withColumn("k", F.lit("x")).withColumn("y", F.lit(9))
    return d, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("clash"))


def test_quality_separates_and_keeps_every_row(spark):
    d, labels = made(spark)
    m = quality.fit(d, labels, fold("doc_id", 5) > 0)
    out = quality.with_score(d, m, name="p")
    assert out.columns == [*d.columns, "p"] and out.count() == d.count()
    got = {r["doc_id"]: r["p"] for r in out.collect()}
    assert all(0 <= p <= 1 for p in got.values())
    assert got[1000] == got[1001] == pytest.approx(m.prior)
    held = [i for i in range(240) if got[i] is not None]
    right = np.mean([(got[i] >= 0.3) == (i % 3 != 0) for i in held])
    assert right >= 0.95


def test_quality_scores_are_the_definition(spark):
    """The score of the udf equals compressing every chunk of the whole text here."""
    d, labels = made(spark)
    m = quality.fit(d, labels, F.lit(True))
    row = d.filter("doc_id = 1003").first()
    cg, cb = quality._compressor(m.good, 3), quality._compressor(m.bad, 3)
    data, n = row["text"].encode(), m.params.chunk
    sizes = [sum(len(c.compress(data[i:i + n])) - len(c.compress(b"")) for i in range(0, len(data), n)) for c in (cg, cb)]
    x = quality._features(np.array([[*sizes, len(data)]], float))
    want = 1 / (1 + np.exp(-(m.weights[0] + ((x - m.centre) / m.scale) @ m.weights[1:])))
    assert quality.with_score(d.filter("doc_id = 1003"), m).first()["score"] == pytest.approx(float(want[0]))


def test_toxicity_finds_words_and_their_relatives(spark):
    d, labels = made(spark)
    m = toxicity.fit(d, labels, fold("doc_id", 5) > 0)
    out = toxicity.with_score(d, m, name="p")
    assert out.columns == [*d.columns, "p"] and out.count() == d.count()
    got = {r["doc_id"]: r["p"] for r in out.collect()}
    assert all(0 <= p <= 1 for p in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(240)]) >= 0.97
    assert got[1000] == got[1001] < 0.5


def brute(model, text):
    """The mean probability of the classifiers, by one look-up for every letter run of the text."""
    words_ = {w.lower() for w in regex.findall(r"\p{L}+", text or "")}
    found = {f for w in words_ for f in (w, *([w[:4] + "~"] if len(w) > 4 else []), *([w[:5] + "~"] if len(w) > 5 else []))}
    sums = [b + sum(w[model.vocabulary[f]] for f in sorted(found) if f in model.vocabulary)
            for b, w in zip(model.bias, model.weights)]
    return float(np.mean([1 / (1 + np.exp(-max(-30, min(30, x)))) for x in sums]))


def test_toxicity_scores_are_the_definition(spark):
    d, labels = made(spark)
    m = toxicity.fit(d, labels, fold("doc_id", 5) > 0)
    assert m.vocabulary
    rows = toxicity.with_score(d, m).select("text", "score").collect()
    assert [r["score"] for r in rows] == pytest.approx([brute(m, r["text"]) for r in rows], abs=1e-9)


def test_toxicity_vocabulary_is_counted_over_all_training_rows(spark):
    """With hardly any unlabelled text in the steps' sample the features are those of a count over everything."""
    d, labels = made(spark)
    train = fold("doc_id", 5) > 0
    few = toxicity.fit(d, labels, train, params=toxicity.ToxicityParams(unlabelled=5))
    assert few.vocabulary == toxicity.fit(d, labels, train).vocabulary
    texts = [r["text"] for r in d.filter(train).collect()]
    known = labels.filter(train).filter("toxic = 1").select("doc_id").distinct().join(d, "doc_id")
    feats = [toxicity._features(t) for t in texts]
    pos = [toxicity._features(r["text"]) for r in known.collect()]
    n1, n0, want = len(pos), len(feats), []
    for f in sorted(set().union(*pos)):
        a, b = sum(f in x for x in pos), sum(f in x for x in feats)
        p, u = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
        z = abs(p - u) / np.sqrt(p * (1 - p) / n1 + u * (1 - u) / n0)
        if a >= min(3, max(1, n1 // 10)) and z >= 3:
            want.append(f)
    assert set(few.vocabulary) == set(want)


def test_nnpu_needs_no_negative_label():
    """P from one class, U a mixture: the classifier recovers the classes, and its posterior the prior."""
    rng = np.random.default_rng(0)

    def sample(pos, n):
        p = np.array([0.8, 0.6, 0.1, 0.1, 0.5]) if pos else np.array([0.05, 0.1, 0.6, 0.7, 0.5])
        return [np.flatnonzero(rng.random(5) < p).tolist() for _ in range(n)]
    u = sample(True, 300) + sample(False, 700)
    pdf = pd.DataFrame({"bag": 0, "k": range(1400), "y": [1] * 400 + [0] * 1000, "x": sample(True, 400) + u})
    got = toxicity._train(pdf, 5, 0.3, toxicity.ToxicityParams()).iloc[0]
    f = np.array([sum(got["w"][k] for k in x) + got["bias"] for x in u])
    assert np.mean((f > 0) == (np.arange(1000) < 300)) >= 0.9
    assert 0.2 < np.mean(1 / (1 + np.exp(-f))) < 0.4


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels_or_rows(spark, module, label):
    d, labels = made(spark, 24)
    empty_d, empty_l = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    for x, y in ((d, empty_l), (empty_d, labels), (empty_d, empty_l), (d, labels.filter(f"{label} = 1"))):
        m = module.fit(x, y, F.lit(True))
        got = module.with_score(d, m).select("score").collect()
        assert len(got) == d.count() and all(0 <= r[0] <= 1 for r in got)
        assert module.with_score(empty_d, m).count() == 0


@pytest.mark.parametrize("key,label,least", [("op8_quality", "quality", 0.93), ("op6_toxicity", "toxic", 0.88)])
def test_held_out_accuracy_of_the_queries(spark, key, label, least):
    got = queries.QUERIES[key](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = got.filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    right, n = held.select(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert n > 50 and right >= least


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    """Held-out recall and precision at 0.5, and AUC: calling everything clean has neither.

    On the larger table: the smaller one holds out six toxic documents only, of which four are found."""
    large = "/root/testdata/sf0.1"
    got = queries.QUERIES["op6_toxicity"](spark, large).filter("held_out")
    held = got.join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").filter("toxic in (0, 1)").toPandas()
    y, hit, score = held["toxic"] == 1, held["predicted"] == 1, held["score"]
    assert y.sum() >= 90
    assert (y & hit).sum() / y.sum() >= 0.8 and (y & hit).sum() / hit.sum() >= 0.8
    rank = score.rank()
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) >= 0.95
