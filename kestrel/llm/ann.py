"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Largest inner product becomes least distance when every vector x gets one more
coordinate, sqrt(M^2 - |x|^2) with M the longest length, and a query gets 0
there.  Lists are the cells of k-means centroids, fitted on a bounded sample;
every vector is in one list.  A task holds one list (a long one in
segments), rotated by a fixed random orthogonal matrix and stored in blocks of
coordinates.  After d of D rotated coordinates the partial squared distance
times D / d estimates the whole one, with an error that shrinks like
1 / sqrt(d); a candidate whose estimate exceeds the query's bound by more than
(1 + epsilon / sqrt(d)) is abandoned, the hypothesis test.  What is left
is scored on the original vectors in double precision.

Two rounds: a query's nearest lists give its bound (the score of the k-th best
found); then it visits the other lists, by the hits expected there, until
those expected in all unvisited ones are below a share of k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import col, cut


@dataclass(frozen=True)
class AdaptiveScanParams:
    """list_rows: vectors per list aimed at.  lists: most lists in all (the
    centroids are sent to all tasks); beyond list_rows x lists vectors the lists
    grow longer.  lengths: most vector lengths that get lists of their own;
    the others are one list each.  sample: vectors per list, sample_mb: megabytes
    that k-means is fitted on at most.  rounds: of k-means.  first: lists of
    the first round.  miss: share of the neighbours that unvisited lists may
    be expected to hold.  block: coordinates per block.  epsilon: of the
    hypothesis test.  segment, segment_mb: most vectors of a list that one task
    holds, and their megabytes.  pairs: of a query and a candidate scanned at once.
    broadcast: most lists of several segments, and most vectors with surplus
    copies, that are broadcast; more are joined."""
    list_rows: int = 2048
    lists: int = 4096
    lengths: int = 64
    sample: int = 48
    sample_mb: int = 64
    rounds: int = 8
    first: int = 3
    miss: float = 0.02
    block: int = 16
    epsilon: float = 2.1
    segment: int = 16_384
    segment_mb: int = 64
    pairs: int = 1 << 20
    broadcast: int = 100_000
    seed: int = 12


@dataclass(frozen=True)
class Lists:
    """Lists of the vectors of one length: numbers from `base` on, centroids (with
    the further coordinate), the squared longest length, and once all vectors are
    assigned the size and mean squared radius of each list."""
    base: int
    centroids: np.ndarray
    longest2: float
    size: np.ndarray | None = None
    radius2: np.ndarray | None = None


@lru_cache(maxsize=4)
def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _augmented(x: np.ndarray, longest2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest2 - (x * x).sum(1), 0))[:, None]], 1)


def _by_length(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix in double precision) for each length among the vectors."""
    off = arr.offsets.to_numpy()
    size = np.diff(off)
    flat = arr.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, flat[off[at][:, None] + np.arange(d)].astype(np.float64)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k of the vectors; a centroid without vectors moves to a random one."""
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    x = x.astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(x[s:s + 4096] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for s in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        total = np.add.reduceat(x[order], np.minimum(np.concatenate(([0], np.cumsum(n)[:-1])), len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)]).astype(np.float32)
    return c.astype(np.float64)


def _usable(vectors: DataFrame, embedding: str, key: str) -> DataFrame:
    """id, e, and u, v: 128 bits that name the vector's value."""
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(col(key).alias("id"), col(embedding).cast(kind).alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("e").isNotNull() & ~odd & F.exists("e", lambda x: x != 0)) \
        .select("id", F.xxhash64(F.lit(1), "e").alias("u"), F.xxhash64(F.lit(2), "e").alias("v"), "e")


def _without_surplus(rows: DataFrame, keep: int, broadcast: int) -> DataFrame:
    """The rows without those that can be in no answer: of equal vectors the `keep` smallest ids are enough,
    and a row that repeats both id and vector counts once.  Only what names vectors of more than `keep` rows
    shuffles; up to `broadcast` such vectors the rows do not."""
    many = cut(rows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > keep).select("u", "v"))
    n = many.count()
    if n == 0:
        return rows
    named = F.broadcast(many) if n <= broadcast else many
    hot = rows.join(named, ["u", "v"], "left_semi")
    ids = hot.select("u", "v", "id").distinct() \
        .withColumn("r", F.row_number().over(Window.partitionBy("u", "v").orderBy("id"))).filter(F.col("r") <= keep)
    value = hot.groupBy("u", "v").agg(F.first("e").alias("e"))
    return rows.join(named, ["u", "v"], "left_anti").select("id", "u", "v", "e") \
        .unionByName(ids.join(value, ["u", "v"]).select("id", "u", "v", "e"))


def fit(rows: DataFrame, params: AdaptiveScanParams) -> dict[int, Lists]:
    """Centroids per vector length, from a sample of at most `sample` rows per list and `sample_mb` in all."""
    square = F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    sizes = rows.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m2")) \
        .filter(F.col("n") >= 2 * params.list_rows).orderBy(F.desc("n"), "d").limit(params.lengths).collect()
    total, out, base = sum(r["n"] for r in sizes), {}, 0
    share = {r["d"]: r["n"] / total for r in sizes}
    wanted = {r["d"]: min(r["n"], int(params.sample * max(2, min(r["n"] // params.list_rows, params.lists * share[r["d"]]))),
                          int(params.sample_mb * 2 ** 20 * share[r["d"]] / (8 * r["d"]))) for r in sizes}
    if not sizes:
        return out
    chance = F.create_map(*[F.lit(x) for r in sizes for x in (r["d"], wanted[r["d"]] / r["n"])])[F.size("e")]
    drawn = F.pmod(F.xxhash64(F.lit(params.seed), "id", "u"), F.lit(1 << 30)) < F.coalesce(chance, F.lit(0.0)) * (1 << 30)
    taken = rows.filter(drawn).select("id", "u", "e").toArrow().sort_by([("id", "ascending"), ("u", "ascending")])
    sample = {d: x for d, _, x in _by_length(taken["e"].combine_chunks())} if len(taken) else {}
    for r in sizes:
        d, n = r["d"], r["n"]
        x = sample.get(d, np.zeros((0, d)))
        k = max(1, min(n // params.list_rows, int(params.lists * share[d]), len(x) // 8))
        if len(x) >= 8:
            rng = np.random.default_rng([params.seed, d])
            out[d] = Lists(base, _kmeans(_augmented(x, r["m2"]), k, params.rounds, rng), r["m2"])
            base += k
    return out


def _nearest(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """List and squared distance to its centroid of every (augmented) vector."""
    c = lists.centroids
    out, d2 = np.empty(len(x), np.int64), np.empty(len(x))
    for s in range(0, len(x), 1024):
        p = x[s:s + 1024]
        d = (p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * p @ c.T
        out[s:s + 1024] = d.argmin(1)
        d2[s:s + 1024] = d.min(1)
    return out, np.maximum(d2, 0)


def _assign(model: dict[int, Lists]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, r2 = np.empty(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for d, at, x in _by_length(batch.column(3)):
                lists = model.get(d)
                if lists is None:
                    g[at] = -d
                else:
                    near, r2[at] = _nearest(_augmented(x, lists.longest2), lists)
                    g[at] = lists.base + near
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(r2), *batch.columns], names=["g", "r2", "id", "u", "v", "e"])
    return run


_TAIL_Z = np.linspace(-8, 8, 1601)
_TAIL = np.array([0.5 * math.erfc(z / math.sqrt(2)) for z in _TAIL_Z])


def _visits(x: np.ndarray, bound: np.ndarray, lists: Lists, k: int, params: AdaptiveScanParams, first: bool) -> np.ndarray:
    """Which lists each query visits in this round (queries x lists).

    First round: the nearest `first` lists, and on until they hold k vectors.
    Second: the others, those with most expected hits first.  A vector of a list
    beats the bound if its residual, taken as normal with the list's mean squared
    radius spread over all directions, exceeds what the centroid leaves.
    """
    c = lists.centroids
    dot = x @ c[:, :-1].T
    order = np.argsort((c * c).sum(1) - 2 * dot, 1, kind="stable")
    held = np.cumsum(lists.size[order], 1)
    rank = np.arange(len(c))
    take = (rank < params.first) | (np.concatenate([np.zeros((len(x), 1)), held[:, :-1]], 1) < k)
    near = np.zeros(dot.shape, bool)
    np.put_along_axis(near, order, take, 1)
    if first:
        return near
    spread = np.sqrt(lists.radius2 / c.shape[1])[None, :] * np.sqrt((x * x).sum(1))[:, None]
    z = (bound[:, None] - dot) / np.maximum(spread, 1e-300)
    hits = np.where(near, 0, lists.size * np.interp(np.clip(z, -8, 8), _TAIL_Z, _TAIL))
    order = np.argsort(-hits, 1, kind="stable")
    left = np.cumsum(np.take_along_axis(hits, order, 1)[:, ::-1], 1)[:, ::-1]  # expected here and in all later lists
    out = np.zeros(dot.shape, bool)
    np.put_along_axis(out, order, left > params.miss * k, 1)
    return out & (lists.size > 0) & ~near


def _probe(model: dict[int, Lists], k: int, params: AdaptiveScanParams, first: bool):
    """(u, v, e, bound) -> one row per list to visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = batch.column(3).to_numpy()
            for d, at, x in _by_length(batch.column(2)):
                lists = model.get(d)
                for s in range(0, len(at), 256):
                    rows = at[s:s + 256]
                    if lists is not None:
                        q, l = np.nonzero(_visits(x[s:s + 256], bound[rows], lists, k, params, first))
                        rows, g = rows[q], lists.base + l
                    elif first:
                        g = np.full(len(rows), -d)
                    else:
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g.astype(np.int64)), *(batch.column(c).take(pa.array(rows)) for c in range(4))],
                        names=["g", "u", "v", "e", "bound"])
    return run


class _Segment:
    """Candidates of one list (or a part of it): ids, the original vectors, and the rotated ones in column blocks."""

    def __init__(self, id_, u, v, x: np.ndarray, params: AdaptiveScanParams):
        order = np.lexsort((v, u, id_))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(id_[order]) != 0) | (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)
        order = order[new]  # by id; a row that repeats another goes
        self.id, self.u, self.v, self.x, self.params = id_[order], u[order], v[order], x[order], params
        self.longest2 = float((self.x * self.x).sum(1).max())
        self.turn = _rotation(x.shape[1] + 1, params.seed)
        r = (_augmented(self.x, self.longest2) @ self.turn).astype(np.float32)
        self.edges = [*range(0, r.shape[1], params.block), r.shape[1]]
        self.blocks = [np.ascontiguousarray(r[:, a:b].T) for a, b in zip(self.edges, self.edges[1:])]
        self.norms = [(b * b).sum(0) for b in self.blocks]

    def scores(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Inner products on the original vectors, summed coordinate by coordinate."""
        out = np.zeros(len(i))
        for a in range(q.shape[1]):
            out += q[i, a] * self.x[j, a]
        return out

    def search(self, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of the k best per query whose score is at least the query's bound (ties: smaller id)."""
        i, j, s = [], [], []
        begin = min(len(self.id), max(64, 2 * k))  # scored whole, so that a query without a bound gets one
        if np.isneginf(bound).any():
            free = np.flatnonzero(np.isneginf(bound))
            p, c = np.repeat(free, begin), np.tile(np.arange(begin), len(free))
            t = self.scores(q, p, c)
            if begin >= k:
                bound = bound.copy()
                bound[free] = -np.sort(-t.reshape(len(free), begin), 1)[:, k - 1]
        tile = max(1, self.params.pairs // len(self.id))
        for lo in range(0, len(q), tile):
            a, b = self._survivors(q[lo:lo + tile], bound[lo:lo + tile])
            t = self.scores(q[lo:lo + tile], a, b)
            ok = t >= bound[lo:lo + tile][a]
            a, b, t = a[ok], b[ok], t[ok]
            order = np.lexsort((b, -t, a))
            a, b, t = a[order], b[order], t[order]
            ok = np.arange(len(a)) - np.searchsorted(a, a) < k
            i.append(a[ok] + lo)
            j.append(b[ok])
            s.append(t[ok])
        return np.concatenate(i), np.concatenate(j), np.concatenate(s)

    def _survivors(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scan: pairs that no hypothesis test abandons, blocks of all pairs while many are left, then of those left."""
        r = (np.concatenate([q, np.zeros((len(q), 1))], 1) @ self.turn).astype(np.float32)
        whole = r.shape[1]
        limit = (q * q).sum(1) + self.longest2 - 2 * bound  # squared distance at the bound
        limit = np.where(np.isneginf(bound), np.inf, np.maximum(limit, 0) + 1e-5 * ((q * q).sum(1) + self.longest2))
        part, i, j, alive = np.zeros((len(q), len(self.id)), np.float32), None, None, None
        for n, (lo, hi) in enumerate(zip(self.edges, self.edges[1:])):
            far = (limit * (1 + (self.params.epsilon / math.sqrt(hi) if hi < whole else 0)) ** 2 * hi / whole).astype(np.float32)
            if i is None:
                piece = r[:, lo:hi]
                part += (piece * piece).sum(1)[:, None] + self.norms[n][None, :] - 2 * piece @ self.blocks[n]
                now = part <= far[:, None]
                alive = now if alive is None else alive & now
                if hi == whole or np.count_nonzero(alive) < alive.size / 8:
                    i, j = np.nonzero(alive)
                    part = part[i, j]
            else:
                gap = self.blocks[n][:, j] - r[i, lo:hi].T
                part = part + (gap * gap).sum(0)
                ok = part <= far[i]
                i, j, part = i[ok], j[ok], part[ok]
        return i, j


_FOUND = "u long, v long, id long, iu long, iv long, score double"


def _scan(k: int, params: AdaptiveScanParams):
    """Rows sorted by list, segment and side (candidates first) -> the best of each query in each segment."""
    def one(seg: _Segment, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, at, q in _by_length(batch.column(6)):
            i, j, s = seg.search(q, batch.column(7).to_numpy(zero_copy_only=False)[at], k)
            rows = at[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(4).take(pa.array(rows)), batch.column(5).take(pa.array(rows)), pa.array(seg.id[j]),
                 pa.array(seg.u[j]), pa.array(seg.v[j]), pa.array(s)], names=["u", "v", "id", "iu", "iv", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, build, seg = None, [], None
        for batch in batches:
            g, s, side = (batch.column(c).to_numpy() for c in range(3))
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(g) != 0) | (np.diff(s) != 0) | (np.diff(side) != 0))))
            for lo, hi in zip(edge, [*edge[1:], len(g)]):
                if (g[lo], s[lo]) != at:
                    at, build, seg = (g[lo], s[lo]), [], None
                rows = batch.slice(lo, hi - lo)
                if side[lo] == 0:
                    x = next(_by_length(rows.column(6)))[2]
                    build.append((*(rows.column(c).to_numpy() for c in (3, 4, 5)), x))
                elif build or seg is not None:
                    if seg is None:
                        seg, build = _Segment(*(np.concatenate(c) for c in zip(*build)), params), []
                    yield from one(seg, rows)
    return run


def _search(index: DataFrame, parts: DataFrame, probes: DataFrame, k: int, params: AdaptiveScanParams) -> DataFrame:
    """The best of each probed segment.  parts: list -> number of segments, for lists of more than one."""
    name = F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1)))
    held = index.join(parts, "g", "left").select(
        "g", name.cast("long").alias("s"), F.lit(0).cast("byte").alias("side"), "id", "u", "v", "e",
        F.lit(0.0).alias("bound"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))
    asked = probes.join(parts, "g", "left").select(
        "g", every.alias("s"), F.lit(1).cast("byte").alias("side"), F.lit(None).cast("long").alias("id"), "u", "v", "e", "bound")
    return held.unionByName(asked).repartition("g", "s").sortWithinPartitions("g", "s", "side") \
        .mapInArrow(_scan(k, params), _FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, embedding: str = "embedding", key: str = "vec_id",
            params: AdaptiveScanParams = AdaptiveScanParams()) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k rows of `vectors` found nearest to each row of `queries`.

    Nearest is the largest inner product, in double precision over the
    original vectors in order of their coordinates; ties go to the smaller id.
    Ids are integers.  Vectors of another length than the query's are no
    candidates, nor is the query's own row (the same id and the same vector).
    Null and empty vectors, zero vectors, vectors with a null or non-finite
    component and rows without an id take no part on either side.  A row that
    repeats id and vector counts once; rows that repeat an id with another vector
    are rows of their own, so as queries they give a list each.  Of fewer than k
    candidates all are returned: the first round goes on until it has k.
    Answers are exact where a length has few vectors (one list); else they miss
    what unvisited lists and abandoned candidates hold.  Other columns are not read.
    """
    rows = _usable(vectors, embedding, key)
    asked = _usable(queries, embedding, key)
    found = _neighbours(rows, asked, k, params)
    best = found.groupBy("u", "v").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("minus"), "id", "iu", "iv"))).alias("a"))  # at most k + 1 each
    own = asked.select("id", "u", "v").distinct().withColumnsRenamed({"id": "query_id"}).join(best, ["u", "v"])
    others = F.filter("a", lambda x: (x["id"] != F.col("query_id")) | (x["iu"] != F.col("u")) | (x["iv"] != F.col("v")))
    return own.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "x")) \
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"),
                (F.lit(0.0) - F.col("x.minus")).alias("score"))


def _neighbours(rows: DataFrame, asked: DataFrame, k: int, params: AdaptiveScanParams) -> DataFrame:
    """Per distinct query vector (u, v) its k + 1 best candidates, the query's own row among them."""
    k = k + 1
    rows = _without_surplus(rows, k, params.broadcast)
    model = fit(rows, params)
    index = cut(rows.mapInArrow(_assign(model), "g long, r2 double, id long, u long, v long, e " + rows.schema["e"].dataType.simpleString()))
    numbered = {r["g"]: (r["n"], r["r2"]) for r in index.filter(F.col("g") >= 0).groupBy("g")
                .agg(F.count(F.lit(1)).alias("n"), F.avg("r2").alias("r2")).collect()}
    for d, lists in model.items():
        at = [numbered.get(lists.base + i, (0, 0.0)) for i in range(len(lists.centroids))]
        model[d] = Lists(lists.base, lists.centroids, lists.longest2, np.array([n for n, _ in at]), np.array([r for _, r in at]))
    room = F.greatest(F.lit(1), F.least(F.lit(params.segment), F.floor(F.lit(params.segment_mb * 2 ** 20) / (24 * F.first(F.size("e"))))))
    parts = cut(index.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / room).cast("long").alias("parts")).filter(F.col("parts") > 1))
    if parts.count() <= params.broadcast:
        parts = F.broadcast(parts)
    once = asked.groupBy("u", "v").agg(F.first("e").alias("e"))
    kind = "g long, u long, v long, e " + asked.schema["e"].dataType.simpleString() + ", bound double"
    probes = once.withColumn("bound", F.lit(float("-inf"))).mapInArrow(_probe(model, k, params, True), kind)
    top = Window.partitionBy("u", "v").orderBy(F.desc("score"), "id", "iu", "iv")
    one = cut(_search(index, parts, probes, k, params).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k))
    if all(len(lists.centroids) <= params.first for lists in model.values()):
        return one
    bound = one.groupBy("u", "v").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(float("-inf")).alias("bound"))
    more = once.join(bound, ["u", "v"]).select("u", "v", "e", "bound").mapInArrow(_probe(model, k, params, False), kind)
    two = _search(index, parts, more, k, params)
    return one.drop("r").unionByName(two).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k)


def exact_sql(every: int = 20, k: int = 20) -> str:
    """DuckDB SQL for the exact answer over the table embeddings, which `nearest` approximates; tests measure the recall."""
    return f"""
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on len(q.e) = len(c.e) and q.vec_id <> c.vec_id where q.vec_id % {every} = 0)
select query_id, (row_number() over w)::int as rank, vec_id, score from p
window w as (partition by query_id order by score desc, vec_id) qualify rank <= {k}
"""

