"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

Linear classifiers are trained by numpy from confirmed toxic texts (P) and
unlabelled texts (U: all texts, toxic ones among them).  What share of U holds
a feature is counted over all training texts; the gradient steps see a sample
of them.  With
class prior pi the risk is

    pi E_P[l(+f)] + max(0, E_U[l(-f)] - pi E_P[l(-f)])

where l is the logistic loss: the second term is the risk on negatives,
estimated without any negative label; whenever it turns negative the step
pushes it back up.  A text's features are its words and the first four and
five letters of its words.  Several classifiers see different bags of the
samples, each trained in its own task; their probabilities are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, cut, pieces

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


@dataclass(frozen=True)
class ToxicityParams:
    """positives, unlabelled: texts of the gradient steps (expected numbers,
    chosen by a hash of the id; all if there are fewer).  vocabulary: features
    kept, those that separate P from U best; min_positive: texts of P that must
    hold a feature; min_z: least difference of its shares in P and U, in
    standard errors (U: all training texts).  bags: classifiers; each sees
    `bag_share` of the samples."""
    positives: int = 3000
    unlabelled: int = 6000
    vocabulary: int = 3000
    min_positive: int = 3
    min_z: float = 3.0
    bags: int = 3
    bag_share: float = 0.8
    steps: int = 400
    rate: float = 0.05
    decay: float = 2e-4


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]
    weights: np.ndarray      # (bags, features)
    bias: np.ndarray         # (bags,)
    prior: float


def word_features(word: str) -> list[str]:
    """The word, and its first four and five letters where it is longer."""
    out = [word]
    if len(word) > 4:
        out.append(word[:4] + "~")
    if len(word) > 5:
        out.append(word[:5] + "~")
    return out


def _features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


def _udf_features():
    @F.arrow_udf("array<string>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(_features(t)) for t in texts.to_pylist()], pa.list_(pa.string()))
    return features


def _known(text: str | None, vocab: dict[str, int], cache: dict[str, tuple]) -> set[int]:
    """Numbers of the known features in the whole text."""
    out: set[int] = set()
    if not text:
        return out
    for w in set(_WORD.findall(text.lower())):
        hit = cache.get(w)
        if hit is None:
            if len(cache) >= _CACHE:
                cache.clear()
            hit = cache[w] = tuple(vocab[f] for f in word_features(w) if f in vocab)
        if hit:
            out.update(hit)
    return out


def _holders(shared):
    """Map step: for every feature of `shared` that a text of the task holds, in how many texts it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = shared.value, {}
        n = np.zeros(len(vocab), np.int64)
        for batch in batches:
            texts = batch.column(0)
            for t in (t for at in pieces(texts) for t in texts.slice(*at).to_pylist()):
                n[list(_known(t, vocab, cache))] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["f", "n"])
    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id",
        label: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Train on the rows whose key meets `train` (a condition on `key`): features are chosen by their shares in a
    bounded sample of the positives and in all rows, the classifiers take their steps on bounded samples.

    Only label 1 is used as a label of a text; the share of ones among the
    labelled rows is the class prior.  Of a repeated id the largest label
    counts, null labels are ignored.  Without positives every text scores 0.
    """
    lab = labels.filter(train).filter(col(label).isin(0, 1) & col(key).isNotNull()) \
        .groupBy(col(key).alias("k")).agg(F.max(col(label)).cast("int").alias("y"))
    row = lab.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n_pos = int(row["p"] or 0)
    if not n_pos:
        return ToxicityModel({}, np.zeros((1, 0)), np.full(1, -30.0), 0.0)
    prior = n_pos / row["n"]
    pool = docs.filter(train).select(col(key).alias("k"), col(text).alias("t"))
    n_all = pool.count()
    unit = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    unit2 = F.pmod(F.xxhash64("k", F.lit("u")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = lab.filter((F.col("y") == 1) & (unit < params.positives / n_pos)).select("k")
    pos = pool.join(F.broadcast(chosen), "k")                               # bounded by `positives`
    held = cut(pos.select(_udf_features()("t").alias("f")))
    n1, n0 = max(held.count(), 1), max(n_all, 1)
    candidates = held.select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c1")) \
        .filter(F.col("c1") >= min(params.min_positive, max(1, n1 // 10))).orderBy("f").collect()
    number = {r["f"]: i for i, r in enumerate(candidates)}                  # features of the texts of P
    shared = docs.sparkSession.sparkContext.broadcast(number)
    c1, c0 = np.array([r["c1"] for r in candidates], float), np.zeros(len(candidates))
    for r in pool.select("t").mapInArrow(_holders(shared), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        c0[r["f"]] = r["n"]
    p, u = (c1 + 0.5) / (n1 + 1.0), (c0 + 0.5) / (n0 + 1.0)
    z = np.abs(p - u) / np.sqrt(p * (1 - p) / n1 + u * (1 - u) / n0)
    best = [i for i in np.argsort(-z, kind="stable") if z[i] >= params.min_z][:params.vocabulary]
    vocab = {candidates[i]["f"]: j for j, i in enumerate(best)}
    if not vocab:
        return ToxicityModel({}, np.zeros((1, 0)), np.full(1, float(np.log(prior / max(1 - prior, 1e-9)))), prior)

    unl = pool.filter(unit2 < params.unlabelled / n0)
    sample = cut(pos.withColumn("y", F.lit(1)).unionByName(unl.withColumn("y", F.lit(0)))
                 .select("k", "y", _numbering(vocab)("t").alias("x")))
    bags = sample.select("k", "y", "x", F.explode(F.array(*[F.lit(b) for b in range(params.bags)])).alias("bag"))
    in_bag = F.pmod(F.xxhash64("k", "bag"), F.lit(1 << 20)) < int(params.bag_share * (1 << 20))
    bags = bags.filter(in_bag)
    got = bags.groupBy("bag").applyInPandas(lambda pdf: _train(pdf, len(vocab), prior, params),
                                            "bag int, bias double, w array<double>").orderBy("bag").collect()
    return ToxicityModel(vocab, np.array([r["w"] for r in got]), np.array([r["bias"] for r in got]), prior)


def _numbering(vocab: dict[str, int]):
    @F.arrow_udf("array<int>")
    def number(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, tuple] = {}
        for arr in texts:
            yield pa.array([sorted(_known(t, vocab, cache)) for at in pieces(arr) for t in arr.slice(*at).to_pylist()],
                           pa.list_(pa.int32()))
    return number


def _train(pdf: pd.DataFrame, n_features: int, prior: float, params: ToxicityParams) -> pd.DataFrame:
    """nnPU by Adam on one bag; bounded by the sample sizes and the vocabulary."""
    pdf = pdf.sort_values(["y", "k"], kind="stable")
    y = pdf["y"].to_numpy()
    lists = [np.asarray(v, np.int64) for v in pdf["x"]]
    row = np.repeat(np.arange(len(lists)), [len(v) for v in lists])
    feat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    is_p = (y == 1).astype(float)
    mp = is_p / max(is_p.sum(), 1.0)
    mu = (1 - is_p) / max((1 - is_p).sum(), 1.0)
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / max(1 - prior, 1e-9))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, params.steps + 1):
        f = np.bincount(row, weights=theta[feat], minlength=len(y)) + theta[-1]
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))          # d l(-f)/df = s, d l(+f)/df = s - 1
        soft = np.logaddexp(0, f)                           # l(-f)
        negative = mu @ soft - prior * (mp @ soft)
        slope = mu * s - prior * mp * s
        g = prior * mp * (s - 1) + slope if negative >= 0 else -slope
        grad = np.append(np.bincount(feat, weights=g[row], minlength=n_features), g.sum())
        grad[:-1] += params.decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta - params.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return pd.DataFrame({"bag": [int(pdf["bag"].iloc[0])], "bias": [theta[-1]], "w": [theta[:-1].tolist()]})


def _udf_score(shared):
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model: ToxicityModel = shared.value
        cache: dict[str, tuple] = {}
        for arr in texts:
            out = []
            for t in (t for at in pieces(arr) for t in arr.slice(*at).to_pylist()):
                known = sorted(_known(t, model.vocabulary, cache))
                f = model.bias + (model.weights[:, known].sum(axis=1) if known else 0.0)
                out.append(float((1 / (1 + np.exp(-np.clip(f, -30, 30)))).mean()))
            yield pa.array(out, pa.float64())
    return score


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Every row and column of `docs` plus `name`: the probability of toxicity (0 to 1).

    The whole text is read.  Null and empty texts hold no feature and get the
    classifiers' bias.  Rows are scored one by one: repeated rows get equal
    scores, and no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)    # bounded by `vocabulary` and `bags`
    return docs.withColumn(name, _udf_score(shared).asNondeterministic()(col(text)))
