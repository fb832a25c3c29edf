"""Quality classifier by compression: zstandard dictionaries of good and bad text.

One dictionary is trained on texts labelled good, one on texts labelled bad.
A text is cut into chunks, all of which are compressed under both
dictionaries; the evidence is the normalised size difference
(bad size - good size) / length.  A logistic calibration, fitted on labelled
texts that built no dictionary, turns it into a probability; it also sees the
compression ratio, since a given difference says less about a text that
compresses to nothing under either dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, pieces


@dataclass(frozen=True)
class QualityParams:
    """dict_docs: labelled texts per class that build a dictionary, and
    calibration_docs: labelled texts that fit the calibration (expected
    numbers, chosen by a hash of the id; all if there are fewer).
    sample_chunks: chunks a text gives to a dictionary, spread over the whole
    text.  Scoring always reads every chunk."""
    dict_docs: int = 800
    sample_chunks: int = 8
    calibration_docs: int = 4000
    dict_bytes: int = 64 * 1024
    chunk: int = 1024
    level: int = 3
    ridge: float = 1e-3


@dataclass
class QualityModel:
    good: bytes | None
    bad: bytes | None
    weights: np.ndarray | None
    centre: np.ndarray | None
    scale: np.ndarray | None
    prior: float
    params: QualityParams


def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False,
                                    write_content_size=False, write_dict_id=False)


def _measure(texts: list[bytes | None], good, bad, chunk: int) -> np.ndarray:
    """Per text: compressed bytes under both dictionaries and length; frame overhead is left out."""
    g0, b0 = len(good.compress(b"")), len(bad.compress(b""))
    out = np.zeros((len(texts), 3))
    for i, t in enumerate(texts):
        if not t:
            continue
        g = b = 0
        for lo in range(0, len(t), chunk):
            part = t[lo:lo + chunk]
            g += len(good.compress(part)) - g0
            b += len(bad.compress(part)) - b0
        out[i] = g, b, len(t)
    return out


def _measured(arr: pa.Array, good, bad, chunk: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, 3))] + [_measure(arr.slice(*at).to_pylist(), good, bad, chunk) for at in pieces(arr)])


def _features(m: np.ndarray) -> np.ndarray:
    n = np.maximum(m[:, 2], 1.0)
    diff, ratio = (m[:, 1] - m[:, 0]) / n, m[:, 0] / n
    return np.stack([diff, ratio, diff * ratio, diff ** 2, ratio ** 2], axis=1)


def _udf_measure(good: bytes, bad: bytes, params: QualityParams):
    @F.arrow_udf("array<double>")
    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cg, cb = _compressor(good, params.level), _compressor(bad, params.level)
        for arr in texts:
            yield pa.array(_measured(arr, cg, cb, params.chunk).tolist(), pa.list_(pa.float64()))
    return measure


def _udf_chunks(params: QualityParams):
    @F.arrow_udf("array<binary>")
    def chunks(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in texts:
            out = []
            for t in arr.to_pylist():
                n = (len(t or b"") + params.chunk - 1) // params.chunk
                pick = range(n) if n <= params.sample_chunks else \
                    sorted({int(k * n / params.sample_chunks) for k in range(params.sample_chunks)})
                out.append([t[k * params.chunk:(k + 1) * params.chunk] for k in pick])
            yield pa.array(out, pa.list_(pa.binary()))
    return chunks


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id",
        label: str = "quality", params: QualityParams = QualityParams()) -> QualityModel:
    """Build both dictionaries and the calibration from bounded samples of labelled rows.

    `train` is a condition on the labels' key.  Labels other than 0 and 1 are
    ignored; of a repeated id the largest label counts.  Without rows of both
    classes the model gives every text the share of good labels (0.5 without
    any label).
    """
    lab = labels.filter(train).filter(col(label).isin(0, 1) & col(key).isNotNull()) \
        .groupBy(col(key).alias("k")).agg(F.max(col(label)).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    prior = n.get(1, 0) / total if total else 0.5
    if len(n) < 2:
        return QualityModel(None, None, None, None, None, prior, params)
    # one half of the hash range builds dictionaries, the other half calibrates
    unit = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("y") == 1, F.lit(min(0.5, params.dict_docs / n[1]))) \
        .otherwise(F.lit(min(0.5, params.dict_docs / n[0])))
    cal = max(0.5, 1 - params.calibration_docs / total)
    use = F.when(unit < share, F.lit("dict")).when(unit >= cal, F.lit("cal"))
    chosen = lab.withColumn("use", use).filter("use is not null")
    # bounded: at most about 2 * dict_docs + calibration_docs ids
    got = docs.select(col(key).alias("k"), col(text).cast("binary").alias("t")) \
        .join(F.broadcast(chosen), "k").filter(F.length("t") > 0)
    chunks = _udf_chunks(params)
    parts = got.filter("use = 'dict'").select("k", "y", F.posexplode(chunks("t")).alias("i", "c")) \
        .orderBy("y", F.xxhash64("k", "i"), "k", "i").select("y", "c").toArrow()
    made = {}
    for y in (0, 1):
        samples = [c for c, v in zip(parts["c"].to_pylist(), parts["y"].to_pylist()) if v == y]
        made[y] = _dictionary(samples, params)
    measure = _udf_measure(made[1], made[0], params)
    seen = got.filter("use = 'cal'").select("k", "y", measure("t").alias("m")).orderBy("k").toArrow()
    y = seen["y"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(None, None, None, None, None, prior, params)
    x = _features(np.array(seen["m"].to_pylist()))
    w, centre, scale = _logistic(x, y, params.ridge)
    return QualityModel(made[1], made[0], w, centre, scale, float(y.mean()), params)


def _dictionary(samples: list[bytes], params: QualityParams) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train on."""
    raw = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(params.dict_bytes, max(1024, raw // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(samples))[-params.dict_bytes:] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps on standardised features."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    pen = np.full(z.shape[1], ridge * len(x))
    pen[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen) + 1e-9 * np.eye(len(w)),
                               z.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def _udf_score(model: QualityModel):
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = model.params
        cg, cb = _compressor(model.good, p.level), _compressor(model.bad, p.level)
        for arr in texts:
            m = _measured(arr, cg, cb, p.chunk)
            z = (_features(m) - model.centre) / model.scale
            s = 1 / (1 + np.exp(-np.clip(model.weights[0] + z @ model.weights[1:], -30, 30)))
            yield pa.array(np.where(m[:, 2] > 0, s, model.prior))
    return score


def with_score(docs: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """Every row and column of `docs` plus `name`: the probability of good quality (0 to 1).

    Null and empty texts get the share of good texts in the calibration rows.
    Very long texts are compressed chunk by chunk, whole.  Rows are scored one
    by one: repeated rows get equal scores, and no other column is read.
    """
    if model.weights is None:
        return docs.withColumn(name, F.lit(float(model.prior)))
    return docs.withColumn(name, _udf_score(model).asNondeterministic()(col(text).cast("binary")))
