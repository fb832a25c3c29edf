"""Language identification by prediction by partial matching (PPM).

For every language a context tree of byte n-grams is counted on a bounded
sample of labelled texts and then frozen.  A byte's probability in a context
of length d is c/(n+q) if the context was followed by it (c times out of n,
by q different bytes); otherwise the escape mass q/(n+q) is spent on the
unseen bytes in proportion to their probability in the context one byte
shorter.  This sums to one in every context, so a text's code length is
exact.  The trees of all languages share one set of nodes, and each node's
row holds -log2 p for every next byte and language: scoring is one chain of
array look-ups per byte, over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, pieces

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdParams:
    """order: longest context in bytes.  docs_per_lang: labelled texts a
    language is learnt from, chosen by a hash of the id (its expected number;
    all if there are fewer).  max_nodes: contexts kept per length, the most
    frequent ones; a rarer context uses the next shorter one.  max_cells:
    nodes x symbols x languages of one length, which bounds the model's memory
    (max_nodes is lowered to fit).  max_langs: the fit refuses more languages."""
    order: int = 3
    docs_per_lang: int = 400
    max_nodes: int = 16384
    max_cells: int = 6_000_000
    max_langs: int = 512
    chunk: int = 1 << 18


@dataclass
class PpmModel:
    langs: list[str]
    symbol: bytes            # byte -> symbol
    n_symbols: int
    child: list[np.ndarray]  # child[d][node * A + s]: the node one byte longer, or -1
    row: list[int]           # row of the first node of each length in `cost`
    cost: np.ndarray         # (rows * A, languages) bits


def _raw_symbols() -> bytes:
    """Fold A-Z to a-z and every other ASCII byte that is no letter to one separator."""
    out = bytearray(range(256))
    for b in range(128):
        ch = chr(b).lower()
        out[b] = ord(ch) if ch.isalpha() else 32
    return bytes(out)


_FOLD = _raw_symbols()


def _gram_counts(order: int):
    """Map step: (lang, n-gram of order+1 folded bytes as a number, count), summed per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            acc: dict[str, list[np.ndarray]] = {}
            langs, texts = batch.column(0), batch.column(1)
            for lang, text in (x for at in pieces(texts)
                               for x in zip(langs.slice(*at).to_pylist(), texts.slice(*at).to_pylist())):
                b = np.frombuffer((b" " * order + text.translate(_FOLD)), np.uint8).astype(np.int64)
                code = np.zeros(len(b) - order, np.int64)
                for k in range(order + 1):
                    code = (code << 8) | b[k:len(b) - order + k]
                g, c = np.unique(code, return_counts=True)
                acc.setdefault(lang, []).append(np.stack([g, c]))
            for lang, parts in acc.items():
                both = np.concatenate(parts, axis=1)
                g, inv = np.unique(both[0], return_inverse=True)
                c = np.bincount(inv, weights=both[1]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(c)],
                                                 names=["lang", "gram", "n"])
    return run


def fit(docs: DataFrame, train, text: str = "text", lang: str = "lang", key: str = "doc_id",
        params: LangIdParams = LangIdParams()) -> PpmModel | None:
    """Count the n-grams of a bounded sample of the rows where `train` holds and freeze the trees.

    Rows with a null language, key or text are left out.  None if nothing is left.
    """
    rows = docs.filter(train).select(col(key).alias("k"), col(lang).cast("string").alias("lang"),
                                     col(text).alias("text"))
    rows = rows.filter("k is not null and lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().limit(params.max_langs + 1).collect()
    if not sizes:
        return None
    if len(sizes) > params.max_langs:
        raise ValueError(f"more than {params.max_langs} languages")
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(params.docs_per_lang / r["count"])).otherwise(share)
    unit = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(unit < share).select("lang", F.col("text").cast("binary").alias("text"))
    grams = sample.mapInArrow(_gram_counts(params.order), "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if grams.num_rows == 0:
        return None
    return _compile(sorted({r["lang"] for r in sizes}), grams["lang"].to_pylist(),
                    grams["gram"].to_numpy(), grams["n"].to_numpy(), params)


def _compile(langs: list[str], lang: list[str], gram: np.ndarray, n: np.ndarray, params: LangIdParams) -> PpmModel:
    """Turn counted n-grams into the shared context nodes and their cost rows."""
    order, n_langs = params.order, len(langs)
    at = {x: i for i, x in enumerate(langs)}
    li = np.fromiter((at[x] for x in lang), np.int64, len(lang))
    used = sorted({int(b) for k in range(order + 1) for b in np.unique((gram >> (8 * k)) & 255)})
    code = np.zeros(256, np.uint8)                      # symbol 0: bytes never seen in training
    code[used] = np.arange(1, len(used) + 1)
    a = len(used) + 1
    max_nodes = max(1, min(params.max_nodes, params.max_cells // (a * n_langs)))
    symbol = bytes(code[np.frombuffer(_FOLD, np.uint8)])
    byte = [code[(gram >> (8 * (order - k))) & 255].astype(np.int64) for k in range(order + 1)]

    prob = np.full((1, a, n_langs), 1.0 / a)            # the empty context's prior
    cost_rows: list[np.ndarray] = []
    child: list[np.ndarray] = []
    row: list[int] = []
    node = np.zeros(len(gram), np.int64)                # node of each gram's context of length d
    parent = np.zeros(1, np.int64)                      # node -> node of the context without its oldest byte
    total_rows = 0
    for d in range(order + 1):
        n_nodes = len(parent)
        count = np.zeros((n_nodes, a, n_langs))
        ok = node >= 0
        np.add.at(count, (node[ok], byte[order][ok], li[ok]), n[ok])
        total = count.sum(axis=1, keepdims=True)
        kinds = (count > 0).sum(axis=1, keepdims=True)
        shorter = prob[parent]
        unseen = np.where(count > 0, 0.0, shorter)
        left = unseen.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(count > 0, count / (total + kinds), kinds / (total + kinds) * unseen / left)
            p = np.where(left > 0, p, count / total)    # every byte was seen: no escape
        prob_d = np.where(total > 0, p, shorter)
        cost_rows.append(-np.log2(np.maximum(prob_d, 1e-300)).astype(np.float32))
        row.append(total_rows)
        total_rows += n_nodes
        prob = prob_d
        if d == order:
            break
        # contexts one byte longer: (oldest byte, context of length d)
        old = byte[order - d - 1]
        pair = np.where(node >= 0, node * a + old, -1)
        seen, inv = np.unique(pair, return_inverse=True)
        weight = np.bincount(inv, weights=n)
        weight[seen < 0] = 0
        keep = np.argsort(-weight, kind="stable")[:max_nodes]
        keep = np.sort(keep[weight[keep] > 0])
        link = np.full(n_nodes * a, -1, np.int32)
        link[seen[keep]] = np.arange(len(keep))
        child.append(link)
        parent = seen[keep] // a
        node = np.where(pair >= 0, link[np.maximum(pair, 0)], -1)
    cost = np.concatenate(cost_rows).reshape(total_rows * a, n_langs)
    return PpmModel(langs, symbol, a, child, row, cost)


def code_lengths(model: PpmModel, text: bytes, chunk: int = LangIdParams.chunk) -> np.ndarray:
    """Bits needed for the whole text under each language, in chunks of bounded memory."""
    order, a = len(model.child), model.n_symbols
    s = np.frombuffer((b" " * order + text).translate(model.symbol), np.uint8)
    out = np.zeros(len(model.langs))
    for lo in range(0, len(text), chunk):
        part = s[lo:lo + chunk + order].astype(np.int32)
        m = len(part) - order
        best = np.full(m, model.row[0], np.int64)
        node = np.zeros(m, np.int32)
        live = np.arange(m)
        for d in range(order):                          # grow the context to the left while it is known
            node = model.child[d][node * a + part[order - 1 - d + live]]
            known = node >= 0
            if not known.all():
                node, live = node[known], live[known]
            best[live] = model.row[d + 1] + node
        out += model.cost[best * a + part[order:]].sum(axis=0, dtype=np.float64)
    return out


def _scorer(shared, chunk: int):
    @F.arrow_udf("lang_pred string, score double, bits double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for arr in texts:
            lang, prob, bits = [], [], []
            for t in (t for at in pieces(arr) for t in arr.slice(*at).to_pylist()):
                if t is None:
                    lang.append(UNDETERMINED), prob.append(0.0), bits.append(None)
                    continue
                length = code_lengths(model, t, chunk)
                k = int(np.argmin(length))
                lang.append(model.langs[k])
                prob.append(float(1.0 / np.exp2(np.maximum(length[k] - length, -1000.0)).sum()))
                bits.append(float(length[k]))
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(prob, pa.float64()), pa.array(bits, pa.float64())],
                names=["lang_pred", "score", "bits"])
    return score


def predict(docs: DataFrame, model: PpmModel | None, text: str = "text", key: str = "doc_id",
            keep: list | None = None, params: LangIdParams = LangIdParams()) -> DataFrame:
    """`key`, the columns of `keep`, lang_pred, score, code_bits for every row.

    score is the language's posterior under equal priors, from exact code
    lengths of the whole text.  A null text, or one without a letter of any
    script, is `und` with score 0 and null bits; so is every text if there is
    no model.  Equal code lengths go to the language first in code-point
    order.  Rows are scored one by one, so repeated rows and ids get equal
    results; other columns are not read.
    """
    keep = list(keep or [])
    has = F.col("t").isNotNull() & F.col("t").rlike(r"\p{L}")
    base = docs.select(col(key), *keep, col(text).alias("t"))
    if model is None:
        return base.select(col(key), *[c for c in base.columns if c not in (key, "t")],
                           F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("code_bits"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    udf = _scorer(shared, params.chunk).asNondeterministic()
    out = base.withColumn("t", F.when(has, F.col("t")).cast("binary")).withColumn("r", udf("t"))
    return out.select(col(key), *[c for c in base.columns if c not in (key, "t")],
                      F.col("r.lang_pred").alias("lang_pred"), F.col("r.score").alias("score"),
                      F.col("r.bits").alias("code_bits"))
