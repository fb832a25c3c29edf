"""SimHash near-dedup by a self-join of binary tries.

Distinct fingerprints form a binary trie over their bits.  The join walks
pairs of nodes of equal depth together, adds up the bits in which their paths
differ and drops a pair as soon as the sum exceeds the error budget.

To spread the trie over tasks it is cut by the pigeonhole principle: with
budget k the 64 bits are split into k + 2 blocks, and two fingerprints within
the budget agree on at least two whole blocks.  So each fingerprint goes to
one sub-trie per pair of blocks, named by its bits there, and the walk runs
inside every sub-trie.  A sub-trie larger than a task should hold is passed
on and split by pairs of its own nodes, as often as needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, components, cut, fresh, pieces
from kestrel.operators.ordered import global_rank

BITS = 64


@dataclass(frozen=True)
class SimHashParams:
    """shingle: words per shingle.  max_bits: most differing bits of a link.
    group: largest sub-trie joined in one piece; a larger one is split into
    runs of that size.  pairs: squared sizes of the sub-tries walked together.
    broadcast: most dropped rows that are broadcast (an id and its bits each); beyond, a join."""
    shingle: int = 4
    max_bits: int = 4
    seed: int = 42
    group: int = 2048
    pairs: int = 4_000_000
    broadcast: int = 500_000


# ------------------------------------------------------------ fingerprints
def fingerprint_of(text: bytes | None, shingle: int, seed: int, chunk: int = 1 << 16) -> int:
    """64-bit SimHash of a UTF-8 text: bit set if it is set in over half the shingles' XXH64."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    start = (end - size + 1)[:len(words) - shingle + 1].tolist()
    stop = end[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for lo in range(0, len(start), chunk):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start[lo:lo + chunk], stop[lo:lo + chunk])),
                        np.uint64)
        total += _bit_counts(h)
    out = 0
    for bit in np.flatnonzero(2 * total > len(start)):
        out |= 1 << int(bit)
    return out


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
        .sum(axis=0, dtype=np.int64)


def _udf_fingerprint(params: SimHashParams):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        fp = [fingerprint_of(t, params.shingle, params.seed) for at in pieces(texts) for t in texts.slice(*at).to_pylist()]
        return pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64())
    return fingerprint


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id",
                 params: SimHashParams = SimHashParams()) -> DataFrame:
    """Columns id, fp (the fingerprint's 64 bits as a long) for every row."""
    return docs.select(col(key).alias("id"), _udf_fingerprint(params)(col(text).cast("binary")).alias("fp"))


# ------------------------------------------------------------- trie join
def trie_pairs(group: np.ndarray, fp: np.ndarray, budget: int,
               limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of fingerprints of one group within `budget` bits, in pieces.

    `group` is sorted and `fp` (uint64, distinct in a group) is sorted inside
    each group, so every trie node is a range of positions.  All groups'
    tries are walked together, a level at a time, in stretches of at most
    `limit` node pairs; a pair of single leaves is settled at once by its
    remaining bits.
    """
    n = len(fp)
    if not n:
        return
    start = np.flatnonzero(np.diff(group, prepend=group[0] ^ 1))
    stop = np.append(start[1:], n)
    big = stop - start > 1
    a0, a1 = start[big], stop[big]
    stack = [(0, a0, a1, a0, a1, np.zeros(len(a0), np.int8))]
    ones: dict[int, np.ndarray] = {}                    # set bits before each position, by level
    while stack:
        level, a0, a1, b0, b1, dist = stack.pop()
        if not len(a0) or level == BITS:
            continue
        if len(a0) > limit:
            stack += [(level, *(x[k:k + limit] for x in (a0, a1, b0, b1, dist))) for k in range(0, len(a0), limit)]
            continue
        if level not in ones:
            bit = (fp >> np.uint64(BITS - 1 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        before = ones[level]
        am, bm = a1 - (before[a1] - before[a0]), b1 - (before[b1] - before[b0])
        cross = a0 != b0
        next_a0 = np.concatenate([a0, am, a0, am[cross]])
        next_a1 = np.concatenate([am, a1, am, a1[cross]])
        next_b0 = np.concatenate([b0, bm, bm, b0[cross]])
        next_b1 = np.concatenate([bm, b1, b1, bm[cross]])
        next_d = np.concatenate([dist, dist, dist + np.int8(1), dist[cross] + np.int8(1)])
        na, nb = next_a1 - next_a0, next_b1 - next_b0
        same = next_a0 == next_b0
        live = (na > 0) & (nb > 0) & (next_d <= budget) & ~(same & (na == 1))
        leaf = live & ~same & (na == 1) & (nb == 1)
        i, j = next_a0[leaf], next_b0[leaf]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= budget
        if ok.any():
            yield np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok])
        go = live & ~leaf
        stack.append((level + 1, next_a0[go], next_a1[go], next_b0[go], next_b1[go], next_d[go]))


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position over the links so far and the new ones."""
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        for side in (i, j, label[i], label[j]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join_groups(params: SimHashParams):
    """Walk the tries of rows (g, fp) sorted by g and fp.

    Out come links that connect what the pairs in budget connect (a forest
    per group, so a group of n gives fewer than n rows), and the rows of
    groups above `params.group`, marked hot, unjoined.
    """
    def links(g: np.ndarray, fp: np.ndarray) -> Iterator[tuple]:
        start = np.flatnonzero(np.diff(g, prepend=g[0] ^ 1))
        size = np.diff(np.append(start, len(g)))
        cost = np.cumsum(size * size)
        lo = 0
        while lo < len(start):                          # whole groups, so many that their pairs fit
            base = cost[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cost, base + params.pairs, "right")))
            s, e = start[lo], start[hi] if hi < len(start) else len(g)
            root = own = np.arange(e - s)
            for i, j in trie_pairs(g[s:e], fp[s:e], params.max_bits):
                root = _join_labels(root, i, j)
            at = np.flatnonzero(root != own)
            if len(at):
                yield fp[s:e][at], fp[s:e][root[at]]
            lo = hi

    def out(hot: bool, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), hot)), pa.array(u.view(np.int64)),
                                           pa.array(v.view(np.int64))], names=["hot", "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        hot_g = None                                    # the group being passed on
        for batch in batches:
            g, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            if hot_g is not None:
                k = int(np.searchsorted(g != hot_g, True)) if (g != hot_g).any() else len(g)
                if k:
                    yield out(True, g[:k], fp[:k])
                g, fp = g[k:], fp[k:]
                if not len(g):
                    continue
                hot_g = None
            held.append((g, fp))
            g, fp = (np.concatenate(x) for x in zip(*held))
            keep = int(np.searchsorted(g, g[-1]))       # the last group may go on in the next batch
            yield from _settle(g[:keep], fp[:keep])
            g, fp = g[keep:], fp[keep:]
            if len(g) > params.group:
                yield out(True, g, fp)
                hot_g, held = g[-1], []
            else:
                held = [(g, fp)]
        if held:
            yield from _settle(*(np.concatenate(x) for x in zip(*held)))

    def _settle(g: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(g):
            return
        start = np.flatnonzero(np.diff(g, prepend=g[0] ^ 1))
        size = np.repeat(np.diff(np.append(start, len(g))), np.diff(np.append(start, len(g))))
        many = size > params.group
        if many.any():
            yield out(True, g[many], fp[many])
        pick = (size > 1) & ~many
        if pick.any():
            gp, up = g[pick], fp[pick].view(np.uint64)
            order = np.lexsort((up, gp))
            for u, v in links(gp[order], up[order]):
                yield out(False, u, v)
    return run


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of max_bits + 2 blocks of nearly equal width."""
    n = max_bits + 2
    edge = [round(BITS * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def _subtries(fp: Column, max_bits: int) -> Column:
    """Names of the sub-tries a fingerprint belongs to, one per pair of blocks."""
    names = []
    for k, ((s1, w1), (s2, w2)) in enumerate(combinations(_blocks(max_bits), 2)):
        part1 = F.shiftrightunsigned(fp, s1).bitwiseAND(F.lit((1 << w1) - 1).cast("long"))
        part2 = F.shiftrightunsigned(fp, s2).bitwiseAND(F.lit((1 << w2) - 1).cast("long"))
        names.append(F.shiftleft(F.lit(k).cast("long"), w1 + w2).bitwiseOR(F.shiftleft(part1, w2)).bitwiseOR(part2))
    return F.array(*names)


def fingerprint_links(distinct: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """Columns u, v: links between distinct fingerprints (column fp) within max_bits.

    Every pair within the budget is found; what is returned is a set of links
    with the same connected components, never all pairs of a group.
    """
    rows = distinct.select(F.explode(_subtries(F.col("fp"), params.max_bits)).alias("g"), "fp")
    links, hot = _walk(rows, params)
    if not hot.isEmpty():
        more, _ = _walk(_split(hot, params), replace(params, group=2 * params.group))
        links = links.unionByName(more)
    return links.distinct()


def _walk(rows: DataFrame, params: SimHashParams) -> tuple[DataFrame, DataFrame]:
    """Links inside the groups of (g, fp), and the rows of groups that are too large."""
    joined = cut(rows.repartition("g").sortWithinPartitions("g", "fp")
                 .mapInArrow(_join_groups(params), "hot boolean, u long, v long"))
    return joined.filter("not hot").select("u", "v"), \
        joined.filter("hot").select(F.col("u").alias("g"), F.col("v").alias("fp"))


def _split(hot: DataFrame, params: SimHashParams) -> DataFrame:
    """Deal large sub-tries out by pairs of their own nodes.

    Ranked in trie order, a sub-trie is cut into runs of `group` fingerprints,
    each below one node: the common prefix of its first and last.  Two runs
    meet unless their prefixes already differ in more than the budget.  A task
    gets one pair of runs, so no group exceeds twice `group` and each pair of
    fingerprints in budget meets in some group.
    """
    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))    # unsigned order
    ranked = global_rank(hot.withColumn("o", order), ["o"], group=["g"]) \
        .select("g", "fp", "o", F.floor((F.col("rank") - 1) / params.group).alias("run"))
    ranked = cut(ranked)
    runs = ranked.groupBy("g", "run").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    a = runs.select("g", F.col("run").alias("a"), F.col("first").alias("fa"), _prefix("first", "last").alias("pa"))
    b = runs.select("g", F.col("run").alias("b"), F.col("first").alias("fb"), _prefix("first", "last").alias("pb"))
    shared = F.least("pa", "pb")
    differ = F.when(shared == 0, 0).otherwise(
        F.expr(f"bit_count(shiftrightunsigned(fa ^ fb, cast({BITS} - least(pa, pb) as int)))"))
    pairs = cut(a.join(b, "g").filter(F.col("a") <= F.col("b")).filter(differ <= params.max_bits).select("g", "a", "b"))
    members = pairs.select("g", "a", "b", F.col("a").alias("run")) \
        .unionByName(pairs.filter("a < b").select("g", "a", "b", F.col("b").alias("run")))
    return ranked.join(members, ["g", "run"]).select(F.xxhash64("g", "a", "b").alias("g"), "fp")


def _prefix(first: str, last: str) -> Column:
    """Leading bits that two numbers share."""
    return F.when(F.col(first) == F.col(last), BITS) \
        .otherwise(BITS - F.length(F.bin(F.col(first).bitwiseXOR(F.col(last)))))


def _rooted(fps: DataFrame, params: SimHashParams) -> DataFrame:
    """Columns fp, first (its smallest id), root (one fingerprint per component) for every distinct fingerprint."""
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(fingerprint_links(nodes.select("fp"), params))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    params: SimHashParams = SimHashParams()) -> DataFrame:
    """Columns key, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest id reachable over links of fingerprints
    within max_bits, the row's own included.  Texts without words (null,
    empty, only white space) have fingerprint zero and link like any other;
    texts with fewer words than a shingle are one shingle.  Equal fingerprints
    are one node, so copies cost one row each and never pairs.  Null ids are
    not smallest; a component of null ids only has a null component_id.
    Repeated rows come back as often as they were given.  Other columns are
    not read.
    """
    fps = cut(fingerprints(docs, text, key, params))
    named = _rooted(fps, params)
    linked = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = named.join(linked, "root").select("fp", "component_id")
    # a fingerprint that many documents share is a skewed key of the larger side, which AQE splits
    return fps.join(of_fp, "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0"))
                                        .alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                         params: SimHashParams = SimHashParams()) -> DataFrame:
    """One row of every component of `docs`: the one with the smallest id; all columns.

    Rows are told apart by id and fingerprint, so a repeated id stays in every
    component whose smallest it is, and of its fingerprints there the smallest
    stays.  Null ids are not smallest: a component with an id drops them, one
    without keeps one row.  Rows equal in id and fingerprint leave one row.
    """
    rows = cut(fingerprints(docs, text, key, params).groupBy("id", "fp").agg(F.count(F.lit(1)).alias("n")))
    stay = cut(_rooted(rows, params).groupBy("root")
               .agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("s"))
               .select(F.col("s.first").alias("i"), F.col("s.fp").alias("f")))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f"))
    gone = rows.join(stay, same, "left_anti")
    again = not rows.filter("n > 1").join(stay, same, "left_semi").isEmpty()
    # an id that comes with one fingerprint names its rows; only the others' fingerprints are taken again
    vague = not rows.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty()
    nulls = not rows.filter("id is null").isEmpty()
    k, b, f = fresh(docs, "gone"), fresh(docs, "gone_bits"), fresh(docs, "bits")

    def bits(id_: Column, fp: Column) -> Column:
        return fp if vague else F.when(id_.isNull(), fp).otherwise(F.lit(0).cast("long"))
    gone = cut(gone.select(F.col("id").alias(k), bits(F.col("id"), F.col("fp")).alias(b)))
    if gone.count() <= params.broadcast:
        gone = F.broadcast(gone)                        # the texts stay where they are read
    at = F.lit(0).cast("long")
    if vague or nulls:
        body = col(text) if vague else F.when(col(key).isNull(), col(text))
        at = bits(col(key), _udf_fingerprint(params)(body.cast("binary")))
    out = docs.withColumn(f, at).join(gone, col(key).eqNullSafe(F.col(k)) & (F.col(f) == F.col(b)), "left_anti")
    return (out.dropDuplicates([key, f]) if again else out).drop(f)
