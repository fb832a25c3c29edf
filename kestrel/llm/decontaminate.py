"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so whole-document MinHash would
drown an item.  Items are therefore put into size classes (powers of two of
their number of distinct shingles), and for every class that occurs a document is cut
into blocks of the class size, each with a MinHash signature over k hash
functions.  A block is about as large as the item, so wherever a document
holds most of an item's shingles some hash function has the same minimum in
the item and in a block (one common minimum suffices).  Every candidate is
verified by exact containment: the share of the item's distinct shingles that
the whole document holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, fresh, pieces

_SOFT = re.compile("[\u00a0-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2000-\u206f\u3000-\u3004\u3008-\u3020]")     # spaces and marks beyond ASCII
_STRETCH = 1 << 18
_SPLIT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass(frozen=True)
class DecontaminationParams:
    """shingle, threshold: words per shingle and least containment.  hashes:
    MinHash functions.  smallest: least size class.  block_items, block_chars:
    items and characters sent to the tasks at once; a larger test set is
    searched in several passes, one per block, so what is broadcast is bounded."""
    shingle: int = 5
    threshold: float = 0.8
    hashes: int = 32
    smallest: int = 1
    block_items: int = 20_000
    block_chars: int = 4_000_000
    seed: int = 11


def normalise(text: str | None) -> bytes:
    """Lower-cased text with everything but letters and digits as spaces."""
    t = (text or "").lower()
    if not t.isascii():
        t = _SOFT.sub(" ", t)
    return t.encode("utf-8", "replace").translate(_SPLIT)


def word_hashes(norm: bytes, places: bool = False):
    """64-bit hash of every word, by one polynomial prefix sum over the bytes; with `places` also where it starts."""
    b = np.frombuffer(norm, np.uint8)
    inside = b != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(b) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(b.astype(np.uint64) * power[:len(b)], dtype=np.uint64)])
        words = _mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))
    return (words, lo) if places else words


_BASE, _POWER = 0x9E3779B97F4A7C15, [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, kept for the longest text so far."""
    if len(_POWER[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWER[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWER[0], _POWER[1]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[:len(words) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = _mix(out * np.uint64(0x2545F4914F6CDD1D) + words[k:len(words) - n + 1 + k])
    return out


def _functions(params: DecontaminationParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(params.seed)
    return (rng.integers(1, 1 << 63, params.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, params.hashes, dtype=np.uint64))


def _hashed(sh: np.ndarray, mult: np.uint64, add: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = sh * mult
        x += add
    x ^= x >> np.uint64(31)
    return x


def _batches(norms: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, document numbers) of stretches of about _STRETCH bytes: many short
    documents at once, long ones in parts that overlap by `overlap` words."""
    held, n = [], 0

    def joined(docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        text = b" ".join(norms[k] for k in docs)
        size = np.array([len(norms[k]) + 1 for k in docs])
        words, at = word_hashes(text, places=True)
        return words, np.asarray(docs)[np.searchsorted(np.cumsum(size), at, "right")]
    for k, t in enumerate(norms):
        if len(t) <= _STRETCH:
            held.append(k)
            n += len(t)
            if n >= _STRETCH:
                yield joined(held)
                held, n = [], 0
            continue
        parts, lo = [np.zeros(0, np.uint64)], 0
        while lo < len(t):                              # cut at spaces, so no word is split
            hi = t.find(b" ", lo + _STRETCH)
            hi = len(t) if hi < 0 else hi
            words = np.concatenate([parts[-1][max(0, len(parts[-1]) - overlap):], word_hashes(t[lo:hi])])
            yield words, np.full(len(words), k)
            parts, lo = [words], hi + 1
    if held:
        yield joined(held)


class ItemIndex:
    """A block of test items: shingle sets, size classes and MinHash minima."""

    def __init__(self, ids: list, texts: list[str | None], params: DecontaminationParams):
        self.params = params
        self.ids, self.n, self.words = [], [], []
        entries: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        mult, add = _functions(params)
        for i, text in zip(ids, texts):
            words = tuple(normalise(text).split())
            if not words:
                continue                                 # an item without words is held by nothing
            n = min(params.shingle, len(words))
            k = len(self.ids)
            self.ids.append(i)
            self.n.append(n)
            self.words.append({words[p:p + n] for p in range(len(words) - n + 1)})
            sh = shingle_hashes(word_hashes(b" ".join(words)), n)
            size = max(params.smallest, 1 << (len(np.unique(sh)) - 1).bit_length())   # repeats do not make an item larger
            by_fn = entries.setdefault((n, size), {})
            for j in range(params.hashes if size > 1 else 1):    # a block of one shingle is an exact look-up
                by_fn.setdefault(j, []).append((int(_hashed(sh, mult[j], add[j]).min()), k))
        # by shingle length and class size, per function: sorted minima, the items having them, a sieve of their low bits
        self.classes: dict[int, dict[int, list[tuple]]] = {}
        for (n, size), by_fn in sorted(entries.items()):
            rows = []
            for j in sorted(by_fn):
                pairs = sorted(by_fn[j])
                mins = np.array([p[0] for p in pairs], np.uint64)
                sieve = np.zeros(1 << 16, bool)
                sieve[(mins & np.uint64(0xFFFF)).astype(np.int64)] = True
                rows.append((mins, np.array([p[1] for p in pairs]), sieve))
            self.classes.setdefault(n, {})[size] = rows

    def candidates(self, norms: list[bytes]) -> list[set[int]]:
        """Per text the items one of whose minima is the minimum of one of its blocks."""
        out: list[set[int]] = [set() for _ in norms]
        mult, add = _functions(self.params)
        for words, doc in _batches(norms, self.params.shingle - 1):
            for n, sizes in self.classes.items():
                if len(words) < n:
                    continue
                inside = doc[:len(doc) - n + 1] == doc[n - 1:]
                sh, of = shingle_hashes(words, n)[inside], doc[:len(doc) - n + 1][inside]
                if not len(sh):
                    continue
                first = np.flatnonzero(np.diff(of, prepend=-1))
                count = np.diff(np.append(first, len(of)))
                cuts = {}
                for size in sizes:                      # blocks start anew with every document
                    per = -(-count // size)
                    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                    cuts[size] = np.repeat(first, per) + nth * size
                for j in range(self.params.hashes):
                    x = _hashed(sh, mult[j], add[j])
                    for size, rows in sizes.items():
                        if j >= len(rows):
                            continue
                        mins, items, sieve = rows[j]
                        low = np.minimum.reduceat(x, cuts[size])
                        maybe = np.flatnonzero(sieve[(low & np.uint64(0xFFFF)).astype(np.int64)])
                        if not len(maybe):
                            continue
                        v = low[maybe]
                        lo, hi = np.searchsorted(mins, v), np.searchsorted(mins, v, "right")
                        for b in np.flatnonzero(hi > lo):
                            out[of[cuts[size][maybe[b]]]].update(items[lo[b]:hi[b]].tolist())
        return out

    def held_by(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text the (item, containment) it holds, by item order."""
        norms = [normalise(t) for t in texts]
        return [self._verified(t, c) for t, c in zip(norms, self.candidates(norms))]

    def _verified(self, norm: bytes, candidates: set[int]) -> list[tuple]:
        """Exact containment of the candidates in the whole text."""
        out, own, sets = [], None, {}
        for k in sorted(candidates):
            own = own or norm.split()
            n = self.n[k]
            if n not in sets:
                sets[n] = set(zip(*(own[p:] for p in range(n))))
            share = len(self.words[k] & sets[n]) / len(self.words[k])
            if share >= self.params.threshold:
                out.append((self.ids[k], share))
        return out


def _udf_held(shared, item_type: str):
    @F.arrow_udf(f"array<struct<item: {item_type}, containment: double>>")
    def held(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index: ItemIndex = shared.value
        kind = None
        for arr in texts:
            out = [[{"item": i, "containment": c} for i, c in h]
                   for at in pieces(arr) for h in index.held_by(arr.slice(*at).to_pylist())]
            kind = kind or pa.list_(pa.struct([("item", pa.int64() if item_type in ("bigint", "long") else
                                                pa.int32() if item_type == "int" else pa.string()),
                                               ("containment", pa.float64())]))
            yield pa.array(out, kind)
    return held


def _indexes(benchmark: DataFrame, text: str, key: str, params: DecontaminationParams,
             unnamed: bool = False) -> Iterator[tuple[ItemIndex, str]]:
    """Item blocks of bounded size, one after the other; `unnamed`: with the items whose id is null."""
    items = benchmark.select(col(key).alias("i"), col(text).alias("t"))
    items = items if unnamed else items.filter("i is not null")
    kind = items.schema["i"].dataType.simpleString()
    if kind not in ("bigint", "int"):
        items, kind = items.withColumn("i", F.col("i").cast("string")), "string"
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    n_blocks = max(-(-size["n"] // params.block_items), -(-size["c"] // params.block_chars))
    for b in range(max(n_blocks, 1)):
        part = items if n_blocks <= 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        rows = part.orderBy("i").collect()               # a block of the stated test set
        yield ItemIndex([r["i"] for r in rows], [r["t"] for r in rows], params), kind


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                 item_text: str = "text", item_key: str = "item_id",
                 params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """Columns key, item_key, containment: one row per row of `docs` and test item it holds.

    Words are lower-cased runs of letters and digits, shingles are distinct
    runs of `shingle` words; an item with fewer words is one shingle of all
    its words.  An item is held if the whole text has at least `threshold` of
    its shingles.  Null, empty and word-free texts hold nothing, such items
    and items with a null id are held by nothing; repeated documents and items
    are reported as often as they occur.  Other columns are not read.  An
    empty benchmark gives no rows.
    """
    parts = []
    for index, kind in _indexes(benchmark, item_text, item_key, params):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = docs.select(col(key).alias("id"), _udf_held(shared, kind).asNondeterministic()(col(text)).alias("h"))
        parts.append(found.select("id", F.explode("h").alias("h"))
                     .select(F.col("id").alias(key), F.col("h.item").alias(item_key), "h.containment"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text",
                  item_key: str = "item_id", params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The rows of `docs` that hold no test item, with or without an id; all columns.  No shuffle: each text is
    judged where it is read."""
    h, out = fresh(docs, "held"), docs
    for index, kind in _indexes(benchmark, item_text, item_key, params, unnamed=True):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.withColumn(h, _udf_held(shared, kind).asNondeterministic()(col(text))) \
            .filter(F.size(h) == 0).drop(h)
    return out


def oracle_sql(params: DecontaminationParams = DecontaminationParams()) -> str:
    """DuckDB SQL for `contaminated` by exact containment of every item in every document."""
    n = params.shingle
    return f"""
with d as (
  select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') as w from documents),
i as (
  select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}]+') as w from benchmark),
si as (
  select distinct item_id, least({n}, len(w)) as n,
         array_to_string(list_slice(w, p, p + least({n}, len(w)) - 1), ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - least({n}, len(w)) + 2)) as p from i where len(w) > 0)),
size as (select item_id, count(*) as total from si group by item_id),
sizes as (select distinct n from si),
sd as (
  select distinct doc_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hit as (select sd.doc_id, si.item_id, count(*) as k from sd join si on sd.n = si.n and sd.s = si.s group by all)
select doc_id, item_id, k::double / total as containment from hit join size using (item_id)
where k::double / total >= {params.threshold}
"""
