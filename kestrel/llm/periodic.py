"""Runs of periodic text: stretches of words that repeat with a period.

Dictionary of basic factors: level k names every stretch of 2^k words of a
document, equal stretches alike; the names of level k + 1 are the pairs of
names 2^k apart.  At each level a stretch looks for its next equal one, its
successor, within twice its length: equal stretches that close form arithmetic
progressions, whose difference is a period.  Level k proposes the periods q of
2^(k-1) < q <= 2^k.

In a run [s, e) with smallest period q every stretch of 2^k >= q words that
has q more words of the run after it finds its successor at distance q exactly:
its first q words are primitive, so they do not recur sooner.  The positions
with successor distance q are therefore the unbroken row s .. e - 2^k - q, whose
neighbours have another distance, else the run would go on.  So each
unbroken row of equal distances, extended by 2^k + q words, is a maximal
run or too short to be one; its positions propose the same run once, and a run
is proposed at one level only.

Names are kept only where a stretch recurs in its document (a run's
stretches do at every level that its period needs), so ordinary text
leaves the dictionary after a few levels.  A task holds the words of a few
megabytes of whole documents, or of one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, pieces


@dataclass(frozen=True)
class RunParams:
    """exponent: least length of a run in periods (3 or more: a run has to hold a
    stretch of up to two periods and its successor).  shortest: least
    length in words.  piece: bytes of text that are worked on at once (a longer
    document alone)."""
    exponent: int = 4
    shortest: int = 6
    piece: int = 1 << 20

    def __post_init__(self):
        if self.exponent < 3:
            raise ValueError("the exponent has to be 3 or more")


def find_runs(word: np.ndarray, starts: np.ndarray, params: RunParams) -> np.ndarray:
    """Runs as rows (document, start in the document, length, period), in this order.

    `word`: numbers of the words of documents laid end to end; document d
    is starts[d] .. starts[d + 1].
    """
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(len(word), dtype=np.int64)
    name = word.astype(np.int64)
    found, k = [], 0
    while len(at):
        size = 1 << k
        order = np.argsort(name, kind="stable")
        a, n, d = at[order], name[order], doc[at[order]]
        twin = (n[1:] == n[:-1]) & (d[1:] == d[:-1])
        step = np.zeros(len(at), np.int64)
        step[order[:-1][twin]] = (a[1:] - a[:-1])[twin]
        near = np.flatnonzero((step > size // 2) & (step <= size))
        if len(near):
            i, q = at[near], step[near]
            new = np.concatenate(([True], (np.diff(i) != 1) | (np.diff(q) != 0) | (np.diff(doc[i]) != 0)))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(i)) - 1
            period = q[first]
            length = i[last] - i[first] + size + period
            ok = length >= np.maximum(params.shortest, params.exponent * period)
            s = i[first][ok]
            found.append(np.stack([doc[s], s - starts[doc[s]], length[ok], period[ok]], 1))
        # stretches of twice the length: both halves recur, and the document is long enough for a period beyond this level
        recur = np.zeros(len(at), bool)
        recur[order[1:][twin]] = True
        recur[order[:-1][twin]] = True
        at, name = at[recur], name[recur]
        other = np.searchsorted(at, at + size)
        other[other == len(at)] = 0
        length = end[at] - starts[doc[at]]
        ok = (at[other] == at + size) & (at + 2 * size <= end[at]) & (length >= params.exponent * (size + 1)) if len(at) \
            else np.zeros(0, bool)
        pair = np.stack([name[ok], name[other[ok]]], 1)
        at = at[ok]
        if len(at):
            key = pair[:, 0] * (int(name.max()) + 1) + pair[:, 1]
            name = np.unique(key, return_inverse=True)[1].astype(np.int64)
        k += 1
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


_RESULT = "struct<words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, end to end, and where each text's begin."""
    split = pc.ascii_split_whitespace(texts.cast(pa.string()))  # at [\x20\x09-\x0D]+
    count = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # the ends of a text may be empty
    ends = np.cumsum(count)
    filled = np.concatenate(([0], np.cumsum(full)))
    return words.filter(pa.array(full)), np.concatenate(([0], filled[ends]))


def _scan(params: RunParams):
    def one(texts: pa.Array) -> pa.Array:
        words, starts = _words(texts)
        runs = find_runs(words.dictionary_encode().indices.to_numpy(zero_copy_only=False), starts, params)
        # a word goes if it stands in a run after the run's first period
        change = np.zeros(len(words) + 1, np.int64)
        first = starts[runs[:, 0]] + runs[:, 1]
        np.add.at(change, first + runs[:, 3], 1)
        np.add.at(change, first + runs[:, 2], -1)
        kept = np.cumsum(change[:-1]) == 0
        left = np.concatenate(([0], np.cumsum(kept)))[starts]
        collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(kept))), " ")
        of = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(runs[:, c])) for c in (1, 2, 3)], names=["start", "length", "period"]))
        return pa.StructArray.from_arrays([pa.array(np.diff(starts)), listed, collapsed],
                                          names=["words", "runs", "collapsed"])

    @F.arrow_udf(_RESULT)
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.concat_arrays([one(texts.slice(lo, n)) for lo, n in pieces(texts, params.piece)] or [one(texts)])
    return scan.asNondeterministic()  # so that what is made of the struct does not run it again


def with_runs(docs: DataFrame, text: str = "text", params: RunParams = RunParams(), name: str = "periodic") -> DataFrame:
    """`docs` with a struct of the number of words, all runs and the collapsed text.

    Words are `[^\\x20\\x09-\\x0D]+`.  A run is a stretch of words with smallest
    period q, of at least `shortest` words and `exponent` periods, that no
    neighbouring word extends with that period; runs (start, length, period) are
    in order of start, then period.  In the collapsed text a run keeps its
    first period only; words are joined by one space.  A null or empty text has
    no words, no runs and an empty collapsed text.  Rows are independent of each
    other; other columns, also clashing ones, stay as they are, but for one of
    the name `name`, which is replaced.
    """
    return docs.withColumn(name, _scan(params)(col(text)))


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null without runs."""
    def before(a: Column, b: Column) -> Column:
        def key(r):
            return F.struct(-r["length"], r["start"], r["period"])
        return F.when(key(a) < key(b), a).otherwise(b)
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)), before)


def listing(runs: Column) -> Column:
    """All runs as lines `start,length,period`, each ended by a line break."""
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def repeat_tail(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with a repeated tail in one document of ten, chosen by h = crc32 of the id as text.

    If h % 10 = 0, every word i from a on becomes word a + (i - a) % p of the n
    words, where g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8).
    Other texts, texts without words and rows without an id stay.
    """
    @F.arrow_udf("string")
    def tail(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for k, h in enumerate(hashes.to_pylist()):
            words = out[k].encode().split() if out[k] and h is not None and h % 10 == 0 else None
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                out[k] = b" ".join(words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]).decode()
        return pa.array(out, pa.string())
    return docs.withColumn(text, tail(col(text), F.crc32(col(key).cast("string").cast("binary"))))
