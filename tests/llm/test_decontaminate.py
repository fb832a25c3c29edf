import random
import re

import pytest
from pyspark.sql import functions as F

from kestrel.llm import decontaminate as dc
from kestrel.llm import queries
from tests.llm.helpers import SCHEMA, docs_of, words

ITEMS = "item_id long, text string"


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, n=5, threshold=0.8):
    out = []
    for i, t in docs:
        w = tokens(t)
        for k, q in items:
            v = tokens(q)
            if k is None or not v:
                continue
            m = min(n, len(v))
            need = {tuple(v[p:p + m]) for p in range(len(v) - m + 1)}
            have = {tuple(w[p:p + m]) for p in range(len(w) - m + 1)}
            c = len(need & have) / len(need)
            if c >= threshold:
                out.append((i, k, c))
    return sorted(out, key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randint(6, 70))) for k in range(40)]
    items += [(40, "tiny item"), (41, "Solo"), (42, ""), (43, None), (44, "!!! ..."), (None, words(rng, 20)),
              (45, " ".join(["same"] * 30)), (46, items[0][1]), (46, items[0][1])]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "here is a tiny   ITEM!"), (4, "solo"), (5, "same " * 50)]
    for i in range(6, 260):
        body = words(rng, rng.randint(1, 300)).split()
        if i % 2:
            q = rng.choice(items[:40])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                q[rng.randrange(len(q))] = "edited"
            at = rng.randint(0, len(body))
            if rng.random() < 0.2:                      # halves far apart
                h = len(q) // 2
                body = q[:h] + body + q[h:]
            else:
                body[at:at] = q
        t = " ".join(body)
        docs.append((i, t.upper().replace(" ", ",\n ") if i % 5 == 0 else t))
    docs.append((400, words(rng, 40000) + " " + items[3][1] + " " + words(rng, 4000)))
    return docs + [docs[7], (None, items[2][1])], items


@pytest.mark.parametrize("params", [dc.DecontaminationParams(hashes=64), dc.DecontaminationParams(hashes=64, block_items=9)])
def test_against_brute_force(spark, params):
    docs, items = corpus()
    b = spark.createDataFrame(items, ITEMS).withColumn("containment", F.lit("c"))
    d = docs_of(spark, docs).withColumn("item_id", F.lit("x")).withColumn("held", F.lit(1)).repartition(5)
    want = brute(docs, items)
    got = sorted(map(tuple, dc.contaminated(d, b, params=params).collect()), key=str)
    assert len(want) > 60
    assert got == want
    clean = dc.decontaminate(d, b, params=params)
    assert clean.columns == d.columns
    bad = {w[0] for w in want}
    assert sorted((r["doc_id"] for r in clean.collect())) == sorted(i for i, _ in docs if i not in bad)


def test_short_items_are_found_wherever_they_stand_with_the_default_parameters(spark):
    docs, items = corpus()
    got = sorted(map(tuple, dc.contaminated(docs_of(spark, docs), spark.createDataFrame(items, ITEMS)).collect()), key=str)
    assert got == brute(docs, items)
    rng = random.Random(12)
    short = [words(rng, n, "klmnopqrst") for n in (1, 2, 3, 4, 5, 6, 7, 8, 9)]
    index = dc.ItemIndex(list(range(len(short))), short, dc.DecontaminationParams())
    texts, want = [], []
    for _ in range(300):
        for k, q in enumerate(short):
            body = words(rng, 60).split()
            at = rng.randint(0, 60)
            texts.append(" ".join([*body[:at], q, *body[at:]]))
            want.append(k)
    held = index.held_by(texts)
    assert all((k, 1.0) in h for k, h in zip(want, held))


def test_items_that_repeat_a_phrase_are_found_where_it_stands_once():
    """Containment counts distinct shingles: a document that holds the phrase once (and its seam) holds them all."""
    rng = random.Random(15)
    for times in (2, 6, 12, 25):
        phrases = [words(rng, 10, "klmnopqrst") for _ in range(400)]
        index = dc.ItemIndex(list(range(400)), [" ".join([p] * times) for p in phrases], dc.DecontaminationParams())
        texts = []
        for p in phrases:
            body, w = words(rng, 60).split(), p.split()
            at = rng.randint(0, 60)
            texts.append(" ".join([*body[:at], *w, *w[:4], *body[at:]]))
        held = index.held_by(texts)
        assert sum((k, 1.0) in h for k, h in enumerate(held)) == 400


def test_items_without_an_id_are_cleaned_out_too(spark):
    d = docs_of(spark, ["one two three four five six seven", "nothing of the kind in here", "a b c d e f"])
    for kind in ("long", "string"):
        b = spark.createDataFrame([(None, "two three four five six"), (None, "a b c d e")], f"item_id {kind}, text string")
        for params in (dc.DecontaminationParams(), dc.DecontaminationParams(block_items=1)):
            assert [r["doc_id"] for r in dc.decontaminate(d, b, params=params).collect()] == [1]
        assert dc.contaminated(d, b).count() == 0        # as in the SQL, which joins on the id


def test_empty_tables_and_string_ids(spark):
    d, e = docs_of(spark, ["a b c d e f g"]), spark.createDataFrame([], ITEMS)
    assert dc.contaminated(d, e).count() == 0 and dc.decontaminate(d, e).count() == 1
    assert dc.contaminated(spark.createDataFrame([], SCHEMA), e).count() == 0
    s = spark.createDataFrame([("q", "a b c d e f")], "item_id string, text string")
    assert [tuple(r) for r in dc.contaminated(d, s).collect()] == [(0, "q", 1.0)]


def test_word_hashes_tell_words_apart():
    rng = random.Random(4)
    ws = [w for w in words(rng, 4000).split()]
    h = dc.word_hashes(dc.normalise(" ".join(ws)))
    first = {}
    for w, x in zip(ws, h.tolist()):
        assert first.setdefault(w, x) == x
    assert len(set(first.values())) == len(first)


def test_query_finds_what_brute_force_finds(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.QUERIES["op4_decontamination"](spark, sf).collect()), key=str)
    rows = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]
    assert got == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))
