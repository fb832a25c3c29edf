"""Line dedup with two Bloom filters, one of hashes seen once and one of hashes seen twice.

Every task hashes the distinct long line keys of its documents and ships the
bits they set, cut into segments; merging two pieces of a segment moves what
both have into the twice-filter and unites the once-filters.  Only the
twice-filter goes back to the tasks.  Lines it does not know occur in one
document and never leave their task; the rest, the suspects, are counted
exactly by a 128-bit digest of the key, which also picks the document that
keeps the line.  A false positive costs a little shuffle and no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Tuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, cut, fresh, pieces

SEGMENT_BITS = 1 << 16


@dataclass(frozen=True)
class LineDedupParams:
    """min_chars, min_docs: keys of at least so many code points in at least
    so many documents lose their lines.  bits_per_doc sizes the filters;
    max_segments bounds them (segments of 8 KB: 128 MB), beyond which more
    lines are suspects.  broadcast_keys: confirmed keys of up to 40 bytes each
    that are sent to the tasks; beyond that they are joined."""
    min_chars: int = 20
    min_docs: int = 3
    bits_per_doc: int = 256
    max_segments: int = 16384
    broadcast_keys: int = 500_000


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _long(key: bytes, min_chars: int) -> bool:
    if len(key) < min_chars:
        return False
    return key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    """Distinct long keys of a text."""
    return {k for k in map(line_key, (text or b"").split(b"\n")) if _long(k, min_chars)}


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, tuple]:
    """Segment of each hash and its three bits there."""
    seg = ((h >> np.uint64(48)) % np.uint64(segments)).astype(np.int64)
    return seg, tuple(((h >> np.uint64(s)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for s in (0, 16, 32))


def _segments(h: np.ndarray, segments: int) -> Iterator[tuple[int, bytes]]:
    """(segment, packed bits) of the given hashes."""
    seg, bits = _places(h, segments)
    order = np.argsort(seg, kind="stable")
    cuts = np.flatnonzero(np.diff(seg[order], prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        at = order[lo:hi]
        b = np.zeros(SEGMENT_BITS, bool)
        for x in bits:
            b[x[at]] = True
        yield int(seg[at[0]]), np.packbits(b).tobytes()


def _build(min_chars: int, segments: int, flush: int = 1 << 20):
    """Map step: pieces of the once- and twice-filters of one task."""
    def piece(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        twice = dict(_segments(h[n > 1], segments)) if (n > 1).any() else {}
        rows = [(s, pack.compress(b), pack.compress(twice[s]) if s in twice else None)
                for s, b in _segments(h, segments)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                          pa.array([r[1] for r in rows], pa.binary()),
                                          pa.array([r[2] for r in rows], pa.binary())],
                                         names=["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for t in (t for at in pieces(batch.column(0)) for t in batch.column(0).slice(*at).to_pylist()):
                h = _hashes(_keys(t, min_chars))
                if len(h):
                    held.append(h)
                    n += len(h)
            if n >= flush:
                yield from piece(held)
                held, n = [], 0
        if n:
            yield from piece(held)
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce step over pieces sorted by segment; holds one segment at a time."""
    unpack = zstandard.ZstdDecompressor()
    size = SEGMENT_BITS // 8
    at, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([twice.tobytes()], pa.binary())],
                                          names=["segment", "twice"])
    for batch in batches:
        for s, o, t in zip(*(c.to_pylist() for c in batch.columns)):
            if s != at:
                if at is not None and twice.any():
                    yield done()
                at, once, twice = s, np.zeros(size, np.uint8), np.zeros(size, np.uint8)
            bits = np.frombuffer(unpack.decompress(o), np.uint8)
            twice |= once & bits
            once |= bits
            if t is not None:
                twice |= np.frombuffer(unpack.decompress(t), np.uint8)
    if at is not None and twice.any():
        yield done()


class TwiceSeen:
    """The merged twice-filter: at most `max_segments` segments of 8 KB."""

    def __init__(self, segments: int, found: dict[int, bytes]):
        self.segments, self.found = segments, found
        self._bits = None

    def __getstate__(self):
        return self.segments, self.found

    def __setstate__(self, state):
        self.segments, self.found = state
        self._bits = None

    def suspects(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes may have been seen in two documents."""
        if self._bits is None:
            self._row = np.full(self.segments, -1, np.int64)
            self._row[list(self.found)] = np.arange(len(self.found))
            self._bits = np.frombuffer(b"".join(self.found.values()) or bytes(1), np.uint8)
        seg, bits = _places(h, self.segments)
        row = self._row[seg]
        out = row >= 0
        base = np.maximum(row, 0) * (SEGMENT_BITS // 8)
        for b in bits:
            out &= (self._bits[np.where(out, base + (b >> 3), 0)] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
        return out


def _suspect_rows(shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: TwiceSeen = shared.value
        for batch in batches:
            for lo, n in pieces(batch.column(1)):
                keys, rows = [], []
                for i, t in enumerate(batch.column(1).slice(lo, n).to_pylist(), start=lo):
                    ks = _keys(t, min_chars)
                    keys.extend(ks)
                    rows.extend([i] * len(ks))
                if not keys:
                    continue
                hit = np.flatnonzero(seen.suspects(_hashes(keys)))
                ids = batch.column(0).take(pa.array(np.asarray(rows, np.int64)[hit]))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(keys[k]) for k in hit], pa.binary()), ids],
                                                 names=["digest", "id"])
    return run


class ConfirmedKeys:
    """Digests of the confirmed keys and the largest id holding each, sorted for look-up."""

    def __init__(self, digests: list[bytes], last: list):
        self.last = dict(zip(digests, last))


def _rewriter(min_chars: int, shared_filter=None, shared_keys=None):
    """(text, id, digests to drop or null) -> text without the dropped lines, and counts."""
    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def rewrite(parts: Iterator[Tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        seen = shared_filter.value
        last = shared_keys.value.last if shared_keys is not None else None
        for texts, ids, drops in ((x.slice(*at) for x in part) for part in parts for at in pieces(part[0])):
            lines = [(t or b"").split(b"\n") for t in texts.to_pylist()]
            id_list, drop_list = ids.to_pylist(), drops.to_pylist()
            keys = [[k if _long(k, min_chars) else None for k in map(line_key, ls)] for ls in lines]
            flat = list({k for ks in keys for k in ks if k is not None})
            hit = seen.suspects(_hashes(flat)) if flat else []
            digest = {k: _digest(k) for k, s in zip(flat, hit) if s}
            out, n, gone = [], [], []
            for ls, ks, i, dr in zip(lines, keys, id_list, drop_list):
                if last is not None:
                    def drop(d, i=i):
                        return d in last and last[d] != i
                else:
                    dr = set(dr or ())

                    def drop(d, dr=dr):
                        return d in dr
                kept = [x for x, k in zip(ls, ks) if k not in digest or not drop(digest[k])]
                out.append(b"\n".join(kept).decode("utf-8", "replace"))
                n.append(len(ls))
                gone.append(len(ls) - len(kept))
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64()),
                                              pa.array(gone, pa.int64())], names=["text", "n_lines", "n_dropped"])
    return rewrite


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", n_lines: str = "n_lines",
                n_dropped: str = "n_dropped", params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """Every row and column of `docs` with `text` rewritten, plus the line counts.

    A line whose key has at least min_chars code points and is found in at
    least min_docs documents goes, except in the rows with the largest `key`
    value holding it (all its occurrences there stay).  Null and empty texts are
    one empty line, so the text comes back empty.  A document is an id: a key
    repeated within a row or in rows that share their id counts once, and such
    rows keep or lose a line together.  Rows without an id count for no document and lose
    the lines that enough documents hold.  A text all of whose lines go becomes
    empty.  Whole texts are read, however long.
    """
    spark = docs.sparkSession
    base = docs.select(col(key).alias("id"), col(text).cast("binary").alias("t"))
    segments = int(min(params.max_segments, max(16, base.count() * params.bits_per_doc // SEGMENT_BITS)))
    pieces = base.select("t").mapInArrow(_build(params.min_chars, segments),
                                         "segment int, once binary, twice binary")
    twice = pieces.repartition("segment").sortWithinPartitions("segment") \
        .mapInArrow(_merge, "segment int, twice binary").collect()      # bounded by max_segments
    seen = spark.sparkContext.broadcast(TwiceSeen(segments, {r["segment"]: bytes(r["twice"]) for r in twice}))
    id_type = base.schema["id"].dataType.simpleString()
    suspects = base.mapInArrow(_suspect_rows(seen, params.min_chars), f"digest binary, id {id_type}")
    confirmed = cut(suspects.groupBy("digest").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
                    .filter(F.col("n") >= params.min_docs).select("digest", "last"))
    r, d, i = fresh(docs, "rewritten"), fresh(docs, "drops"), fresh(docs, "dropped_id")
    if confirmed.count() <= params.broadcast_keys:
        rows = confirmed.collect()                                      # bounded by broadcast_keys
        keys = spark.sparkContext.broadcast(ConfirmedKeys([bytes(x["digest"]) for x in rows],
                                                          [x["last"] for x in rows]))
        udf = _rewriter(params.min_chars, seen, keys)
        out = docs.withColumn(d, F.lit(None).cast("array<binary>"))
    else:
        # beyond the bound: both sides meet in a join on the digest (a hot key's suspects are split by AQE)
        udf = _rewriter(params.min_chars, seen, None)
        lost = suspects.join(confirmed, "digest").filter(~F.col("id").eqNullSafe(F.col("last"))) \
            .groupBy("id").agg(F.collect_set("digest").alias(d)).withColumnRenamed("id", i)
        out = docs.join(lost, col(key).eqNullSafe(F.col(i)), "left").drop(i)
    out = out.withColumn(r, udf.asNondeterministic()(col(text).cast("binary"), col(key), col(d)))
    return out.select(*[F.col(f"{r}.text").alias(text) if c == text else col(c) for c in docs.columns],
                      F.col(f"{r}.n_lines").alias(n_lines), F.col(f"{r}.n_dropped").alias(n_dropped))
