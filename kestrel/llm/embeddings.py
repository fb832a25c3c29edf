"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c are within squared distance 2 - 2c.  A fixed
random rotation spreads that distance evenly over the coordinates, which are
split into low-dimensional blocks; if a pair's distance is within the budget,
then in at least one block its squared distance is within the block's
proportional share.  So each block is a range join of its own: vectors meet
in the cells of a grid over the block's first coordinates, and pairs within
the block's budget are candidates.  The union of the candidates of all blocks
is verified by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, components, cut


@dataclass(frozen=True)
class NearVectorParams:
    """cosine: least cosine of a link.  block: coordinates per block.  grid:
    coordinates of a block that name its cells, twice the block's radius wide.
    group: most vectors of a cell that one task compares at once; a fuller
    cell is dealt out over several groups."""
    cosine: float = 0.98
    block: int = 8
    grid: int = 3
    group: int = 4096
    tile: int = 1024
    seed: int = 5


def rotation(dim: int, seed: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, params: NearVectorParams) -> list[tuple[int, int, float]]:
    """(first, end, squared-distance budget) per block; a hair of slack covers rounding."""
    whole = 2 - 2 * params.cosine
    edges = [*range(0, dim, params.block), dim]
    return [(a, b, whole * (b - a) / dim * (1 + 1e-5) + 1e-6) for a, b in zip(edges, edges[1:])]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(arr: pa.Array) -> list[np.ndarray]:
    off, values = arr.offsets.to_numpy(), arr.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return [values[a:b] for a, b in zip(off, off[1:])]


def _spread(params: NearVectorParams):
    """(cid, label key, embedding) -> per block one row in its own cell (side 0) and one in
    every cell within the block's radius (side 1)."""
    def cells(label: np.ndarray, dim: int, b: int, at: np.ndarray) -> np.ndarray:
        h = label.astype(np.int64).view(np.uint64) ^ np.uint64(dim * 1_000_003 + b * 7919 + 1)
        with np.errstate(over="ignore"):
            for k in range(at.shape[1]):
                h = (h ^ (at[:, k].astype(np.int64).view(np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vecs = _rows(batch.column(2))
            dims = np.array([len(v) for v in vecs])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _unit(np.stack([vecs[i] for i in at])) @ rotation(int(dim), params.seed)
                for b, (lo, hi, budget) in enumerate(blocks(int(dim), params)):
                    part, g = x[:, lo:hi], min(params.grid, hi - lo)
                    radius = np.sqrt(budget)
                    width = 2 * radius
                    low = np.floor((part[:, :g] - radius) / width).astype(np.int64)
                    high = np.floor((part[:, :g] + radius) / width).astype(np.int64)
                    coord = np.ascontiguousarray(part, np.float32)
                    home = np.floor(part[:, :g] / width).astype(np.int64)
                    yield _batch(cells(label[at], int(dim), b, home), 0, cid[at], coord)
                    for step in product((0, 1), repeat=g):
                        cell = low + np.array(step)
                        ok = (cell <= high).all(axis=1)
                        if ok.any():
                            yield _batch(cells(label[at][ok], int(dim), b, cell[ok]), 1, cid[at][ok], coord[ok])
    return run


def _batch(g: np.ndarray, side: int, cid: np.ndarray, coord: np.ndarray) -> pa.RecordBatch:
    width = coord.shape[1] * 4
    data = pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer(
        (np.arange(len(g) + 1) * width).astype(np.int32)), pa.py_buffer(coord.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), side, np.int8)), pa.array(cid), data],
                                      names=["g", "side", "cid", "x"])


_CELL = "g long, side byte, cid long, x binary"


def _range_join(params: NearVectorParams, whole: float):
    """Rows sorted by g and side -> candidate pairs; fuller cells pass through, marked hot.

    Holds one cell's side-0 rows (at most `group`) and one batch of side-1 rows.
    """
    def coords(x: pa.Array) -> np.ndarray:
        raw = x.to_pylist()
        return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)

    def out(hot, g, side, u, v, x) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), hot)), pa.array(g), pa.array(side),
                                           pa.array(u), pa.array(v), x], names=["hot", "g", "side", "u", "v", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, build, n_build, ready, hot = None, [], 0, None, False
        for batch in batches:
            g, side, cid = (batch.column(k).to_numpy() for k in range(3))
            x = batch.column(3)
            key = np.flatnonzero((np.diff(g, prepend=g[0] ^ 1) != 0) | (np.diff(side, prepend=side[0]) != 0))
            us, vs = [], []
            for lo, hi in zip(key, np.append(key[1:], len(g))):
                if g[lo] != at:
                    at, build, n_build, ready, hot = g[lo], [], 0, None, False
                rows = slice(lo, hi)
                if side[lo] == 0 and not hot:
                    build.append((cid[rows], x.slice(lo, hi - lo)))
                    n_build += hi - lo
                    if n_build > params.group:
                        hot = True
                        for c, xs in build:
                            z = np.zeros(len(c), np.int64)
                            yield out(True, np.full(len(c), at), np.zeros(len(c), np.int8), c, z, xs)
                        build = []
                    continue
                if hot:
                    yield out(True, g[rows], side[rows], cid[rows], np.zeros(hi - lo, np.int64), x.slice(lo, hi - lo))
                    continue
                if not build:
                    continue
                if ready is None:
                    ready = np.concatenate([c for c, _ in build]), np.concatenate([coords(xs) for _, xs in build])
                bc, bx = ready
                for s in range(lo, hi, params.tile):
                    e = min(s + params.tile, hi)
                    px = coords(x.slice(s, e - s))
                    if px.shape[1] != bx.shape[1]:
                        raise ValueError("blocks of different width in one cell")
                    budget = whole[px.shape[1]]
                    d = (px * px).sum(1)[:, None] + (bx * bx).sum(1)[None, :] - 2 * (px @ bx.T)
                    i, j = np.nonzero((d <= budget) & (bc[None, :] < cid[s:e, None]))
                    if len(i):
                        us.append(bc[j])
                        vs.append(cid[s:e][i])
            if us:
                u, v = np.concatenate(us), np.concatenate(vs)
                yield out(False, np.zeros(len(u), np.int64), np.zeros(len(u), np.int8), u, v,
                          pa.nulls(len(u), pa.binary()))
    return run


def _cosine():
    @F.arrow_udf("double")
    def cosine(parts: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in parts:
            out = []
            for x, y in zip(_rows(a), _rows(b)):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                out.append(float(x @ y / np.sqrt((x @ x) * (y @ y))))
            yield pa.array(out, pa.float64())
    return cosine


def _candidates(nodes: DataFrame, params: NearVectorParams) -> DataFrame:
    """Distinct pairs u < v of vectors within the budget of some block."""
    dims = [r[0] for r in nodes.select(F.size("e").alias("d")).distinct().limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("more than 1000 different vector lengths")
    budget: dict[int, float] = {}
    for d in dims:
        for lo, hi, share in blocks(d, params):
            budget[hi - lo] = max(budget.get(hi - lo, 0.0), share)
    rows = nodes.select("cid", F.xxhash64("label").alias("l"), "e").mapInArrow(_spread(params), _CELL)
    found = None
    while True:
        joined = cut(rows.repartition("g").sortWithinPartitions("g", "side").mapInArrow(
            _range_join(params, budget), "hot boolean, g long, side byte, u long, v long, x binary"))
        pairs = joined.filter("not hot").select("u", "v")
        found = pairs if found is None else found.unionByName(pairs)
        hot = joined.filter("hot")
        if hot.isEmpty():
            return found.distinct()
        # a full cell: its own rows are dealt out over groups, the searching rows go to all of them
        full = hot.filter("side = 0").groupBy("g").agg(F.ceil(2 * F.count(F.lit(1)) / params.group).cast("int").alias("n"))
        mine = F.array(F.pmod(F.xxhash64("u", "g"), F.col("n")).cast("int"))
        rows = hot.join(full, "g") \
            .withColumn("s", F.explode(F.when(F.col("side") == 0, mine).otherwise(F.sequence(F.lit(0), F.col("n") - 1)))) \
            .select(F.xxhash64("g", "s").alias("g"), "side", F.col("u").alias("cid"), "x")


def near_duplicates(vectors: DataFrame, embedding: str = "embedding", label: str = "label", key: str = "vec_id",
                    params: NearVectorParams = NearVectorParams()) -> DataFrame:
    """Columns key, n_links, component_id, kept for every row.

    Vectors link if their labels are equal and not null, their lengths are
    equal and their cosine in double precision is at least `cosine`.  Null,
    empty and zero vectors, and vectors with a null or non-finite component,
    link with nothing: 0 links, their own component.  Equal vectors of a label
    are one node: a row's links are the other copies and all rows of linked
    nodes, so copies are never expanded into pairs.  component_id is the
    smallest id reachable, kept tells whether that is the row's own.
    Repeated rows are vectors of their own; null ids are not smallest.  Other
    columns are not read.
    """
    rows = vectors.select(col(key).alias("id"), col(embedding).cast("array<double>").alias("e"), col(label).alias("label"))
    odd = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("e").isNotNull() & ~odd & F.exists("e", lambda v: v != 0)
    nodes = cut(rows.filter(usable).groupBy("label", "e").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
                .withColumn("cid", F.monotonically_increasing_id()))
    pairs = _candidates(nodes, params)
    side = nodes.select("cid", "label", "e")
    links = cut(pairs.join(side.toDF("u", "lu", "eu"), "u").join(side.toDF("v", "lv", "ev"), "v")
                .filter(F.col("lu") == F.col("lv"))
                .withColumn("c", _cosine()("eu", "ev")).filter(F.col("c") >= params.cosine).select("u", "v"))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(nodes.select(F.col("cid").alias("v"), "n"), "v").groupBy("u").agg(F.sum("n").alias("others"))
    roots = components(links)
    named = nodes.join(roots, F.col("cid") == F.col("node"), "left") \
        .join(degree, F.col("cid") == F.col("u"), "left") \
        .select("label", "e", "first", F.coalesce("root", "cid").alias("root"),
                (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("label", "e", "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.withColumn("label", F.when(usable, F.col("label"))).join(named, ["label", "e"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def oracle_sql(cosine: float = 0.98) -> str:
    """DuckDB SQL for `near_duplicates` over the table embeddings, by all pairs of a label."""
    return f"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as u, b.vec_id as v from v a join v b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= {cosine}),
r as (select u, v from l union select r.u, l.v from r join l on r.v = l.u),
m as (select u, least(u, min(v)) as component_id from r group by u),
n as (select u, count(*) as n_links from l group by u)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, coalesce(m.component_id, e.vec_id) as component_id,
       coalesce(m.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.u = e.vec_id left join m on m.u = e.vec_id
"""
