import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kestrel.llm import queries, simhash
from tests.llm.helpers import SCHEMA, components, docs_of, words


def brute_fingerprint(text, n=4, seed=42):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    import re
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if not ws:
        return 0
    sh = [" ".join(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [(i, brute_fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for x, (a, p) in enumerate(fp) for b, q in fp[:x] if (p ^ q).bit_count() <= 4]
    comp = components([i for i, _ in fp], pairs)
    return sorted((i, f"{p:016x}", comp[i]) for i, p in fp)


def corpus(seed=7):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "a b c d"), (6, "ÀB c\x1fd e"),
            (7, "\x85 x y z w")]
    for i in range(8, 60):
        rows.append((i, words(rng, rng.randint(1, 80))))
    base = words(rng, 400).split()
    for i in range(60, 110):
        ws = list(base)
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = "edit"
        rows.append((i, " ".join(ws)))
    rows += [(110 + k, rows[20 + k][1]) for k in range(15)] + [(200, words(rng, 30000))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("params", [simhash.SimHashParams(), simhash.SimHashParams(group=5, pairs=50)])
def test_against_brute_force(spark, params):
    rows = corpus()
    d = docs_of(spark, rows).withColumn("fp", F.lit(1)).withColumn("fingerprint", F.lit(2)).repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(d, params=params).collect()))
    want = brute(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert got == want


def test_trie_walk_finds_exactly_the_pairs_in_budget():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    near = fp[:80] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    near = np.concatenate([near, near ^ np.uint64(0b111), fp[:40] ^ np.uint64(0x8000000000000001)])
    fp = np.unique(np.concatenate([fp, near]))
    group = np.sort(rng.integers(0, 3, len(fp)))
    order = np.lexsort((fp, group))
    group, fp = group[order], fp[order]
    for budget in (0, 1, 4):
        parts = list(simhash.trie_pairs(group, fp, budget, limit=50))
        i, j = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, int) for k in (0, 1))
        want = {(a, b) for b in range(len(fp)) for a in range(b)
                if group[a] == group[b] and int(fp[a] ^ fp[b]).bit_count() <= budget}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_full_subtries_are_split_without_losing_links(spark):
    """A ball of fingerprints around one centre, far more than a task may hold at once."""
    centre = 0x0123456789ABCDEF
    balls = [centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)] + [0xFFFF0000FFFF0000]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in balls]
    d = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.fingerprint_links(d, simhash.SimHashParams(group=64)).collect()
    comp = components(signed, [(r["u"], r["v"]) for r in links])
    assert len(set(comp.values())) == 2
    assert all(bin((r["u"] ^ r["v"]) & (1 << 64) - 1).count("1") <= 64 for r in links)


def test_nulls_repeats_and_empty(spark):
    rng = random.Random(5)
    t = words(rng, 50)
    rows = [(None, t), (5, t), (5, t), (7, t + " x"), (9, words(rng, 50))]
    got = sorted(map(tuple, simhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert len(got) == 5 and {g[2] for g in got if g[0] in (None, 5)} == {5}
    kept = simhash.drop_near_duplicates(docs_of(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in kept if r["text"] == t) == [5]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_by_their_texts(spark):
    rng = random.Random(11)
    a, b, c, e, g, o = (words(rng, 50) for _ in range(6))
    for rows, want in [
        ([(None, a), (None, b), (None, c), (3, c), (4, e)], [(None, a), (None, b), (3, c), (4, e)]),
        ([(None, a), (None, a), (None, b)], [(None, a), (None, b)]),
        ([(5, a), (5, b), (5, b), (5, c), (3, c), (None, g), (None, b)], [(5, a), (5, b), (3, c), (None, g)]),
        ([(1, a), (2, a), (None, o)], [(1, a), (None, o)]),
        ([(1, a), (1, a), (2, b), (3, b)], [(1, a), (2, b)]),
    ]:
        d = docs_of(spark, rows).withColumn("fp", F.lit(1)).withColumn("bits", F.lit(2)).repartition(3)
        kept = simhash.drop_near_duplicates(d)
        assert kept.columns == d.columns
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_query_on_a_table(spark):
    got = queries.QUERIES["op9_simhash"](spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(map(tuple, got)) == brute([(r["doc_id"], r["text"]) for r in docs])
