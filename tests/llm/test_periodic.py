import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kestrel.llm import periodic, queries
from tests.llm.helpers import docs_of


def brute_runs(w, exponent=4, shortest=6):
    """Every period's maximal stretches; a stretch counts with its smallest period only."""
    best = {}
    for q in range(1, len(w) // exponent + 1):
        s = None
        for i in range(len(w) - q + 1):
            same = i + q < len(w) and w[i] == w[i + q]
            if same and s is None:
                s = i
            elif not same and s is not None:
                e = i + q
                if e - s >= max(shortest, exponent * q) and not any(
                        all(w[x] == w[x + r] for x in range(s, e - r)) for r in range(1, q)):
                    best[s, q] = e - s
                s = None
    return sorted((s, n, q) for (s, q), n in best.items())


def brute(doc_id, text, plant=True):
    w = (text or "").encode().split()
    if plant and doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return w, runs, kept


def corpus():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a", "x a b a b a b a b y", "a b a b a b a", "é é é é é é\x85é",
             "a\x0ba\x0ca\ra\na\ta", "a b c " * 4 + "a b", "a " * 30 + "b " + "a " * 7, ("a " * 8 + "b ") * 5]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            parts += unit * rng.randint(1, 6) + unit[:rng.randint(0, len(unit))]
        texts.append(" ".join(parts))
    texts.append(" ".join(f"w{k % 700}" for k in range(2900)))
    return list(enumerate(texts)) + [(None, "q " * 9), (None, None), (7, "a b " * 5), (7, "a b " * 5)]


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_against_brute_force(spark, piece):
    rows = corpus()
    d = docs_of(spark, rows).withColumn("runs", F.lit(1)).withColumn("words", F.lit("x")).repartition(3)
    out = periodic.with_runs(periodic.repeat_tail(d), params=periodic.RunParams(piece=piece))
    assert out.columns == d.columns + ["periodic"]
    got = sorted(((r["doc_id"], r["periodic"]["words"], [tuple(x) for x in r["periodic"]["runs"]], r["periodic"]["collapsed"])
                  for r in out.collect()), key=str)
    want = sorted(((i, len(b[0]), b[1], b[2].decode()) for i, b in ((i, brute(i, t)) for i, t in rows)), key=str)
    assert got == want
    assert sum(len(w[2]) for w in want) > 100


def test_query_digests(spark, tmp_path):
    rows = corpus()
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = []
    for i, t in rows:
        _, runs, kept = brute(i, t)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        want.append((i, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(kept).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4), st.integers(3, 5), st.integers(1, 9))
def test_find_runs(docs, exponent, shortest):
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    word = np.array([x for d in docs for x in d], np.int64)
    runs = periodic.find_runs(word, starts, periodic.RunParams(exponent=exponent, shortest=shortest))
    assert [tuple(map(int, r)) for r in runs] == [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d, exponent, shortest)]


def test_a_long_text_of_one_word_and_a_long_period():
    n = 200_000
    one = np.zeros(n, np.int64)
    assert periodic.find_runs(one, np.array([0, n]), periodic.RunParams()).tolist() == [[0, 0, n, 1]]
    far = np.arange(n, dtype=np.int64) % 40_000
    assert periodic.find_runs(far, np.array([0, n]), periodic.RunParams()).tolist() == [[0, 0, n, 40_000]]


def test_empty_table_and_no_shuffle(spark):
    d = periodic.with_runs(docs_of(spark, []))
    assert d.count() == 0
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        periodic.RunParams(exponent=2)
