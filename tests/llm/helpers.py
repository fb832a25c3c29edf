"""Fixtures and brute-force versions shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, alphabet: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def docs_of(spark, texts, lang="en", source="s", schema=SCHEMA):
    """Documents from a list of texts (or (doc_id, text) pairs)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], schema)


def components(nodes, pairs):
    """Smallest node reachable from each node."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
