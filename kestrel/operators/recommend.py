"""Neighbourhood recommendation (M1-M7) on (user, item, rating) triples.

The rating matrix is never densified.  `cosine_among`, `ubcf_topn` and
`ibcf_topn` serve a bounded set of users/items (a report set, the target
users): their ratings meet all ratings of the same item (or user), which costs
the targets' ratings times the raters of each.  What is needed for every user or item
goes through `cosine_neighbours`, a join pruned by rare keys and norms.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from kestrel.operators.relational import top_k_per_group
from kestrel.session import Scratch, ensure_checkpoint_dir, scratch_folder, shuffles_removed


def min_support_filter(r: DataFrame, user: str, item: str, min_item: int, min_user: int) -> DataFrame:
    """M1: keep ratings of items with >= min_item ratings and users with
    >= min_user ratings, both counted on the unfiltered data."""
    ic = r.groupBy(item).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_item).select(item)
    uc = r.groupBy(user).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_user).select(user)
    return r.join(ic, item, "left_semi").join(uc, user, "left_semi")


def zscore_by_user(r: DataFrame, user: str, rating: str) -> DataFrame:
    """Z-score of each rating within its user (n-1 sd); adds mu, sd, z.
    A constant user has sd 0 and z NULL."""
    st = r.groupBy(user).agg(F.avg(rating).alias("mu"), F.stddev_samp(rating).alias("sd"))
    return (r.join(st, user)
            .withColumn("z", F.when(F.col("sd") > 0, (F.col(rating) - F.col("mu")) / F.col("sd"))))


def cosine_among(r: DataFrame, key: str, other: str, value: str, members: DataFrame,
                 min_overlap: int = 1) -> DataFrame:
    """M2/M3: cosine similarity between the `key` values listed in `members`
    (a bounded set), over co-rated `other` values:
    sum(a*b) / sqrt(sum(a^2) * sum(b^2)).  Output: key_a, key_b, sim, overlap."""
    m = r.join(members.select(key), key, "left_semi").select(key, other, value)
    a = m.select(F.col(key).alias("key_a"), other, F.col(value).alias("va"))
    b = m.select(F.col(key).alias("key_b"), other, F.col(value).alias("vb"))
    p = a.join(b, other).filter(F.col("key_a") < F.col("key_b"))
    g = p.groupBy("key_a", "key_b").agg(
        F.sum(F.col("va") * F.col("vb")).alias("dot"), F.sum(F.col("va") * F.col("va")).alias("na"),
        F.sum(F.col("vb") * F.col("vb")).alias("nb"), F.count(F.lit(1)).alias("overlap"))
    return (g.filter(F.col("overlap") >= min_overlap)
            .select("key_a", "key_b", F.try_divide(F.col("dot"), F.sqrt(F.col("na") * F.col("nb"))).alias("sim"),
                    "overlap"))


def ubcf_topn(r: DataFrame, user: str, item: str, rating: str, targets: DataFrame,
              nn: int = 30, n: int = 5, min_overlap: int = 2) -> DataFrame:
    """M5/M7: user-based CF for the target users.  Ratings are z-scored per
    user; similarity is cosine over co-rated items (>= min_overlap); the nn
    most similar users are the neighbourhood; an unrated item scores
    sum(sim * z_neighbour) / sum(sim over the neighbourhood), de-normalised
    with the target's mean and sd; the top-n per target are returned."""
    z = zscore_by_user(r, user, rating).filter(F.col("z").isNotNull())
    tz = z.join(targets.select(user), user, "left_semi").select(
        F.col(user).alias("t"), item, F.col("z").alias("zt"))
    others = z.select(F.col(user).alias("v"), item, F.col("z").alias("zv"))
    pairs = tz.join(others, item).filter(F.col("t") != F.col("v"))
    sims = (pairs.groupBy("t", "v").agg(F.sum(F.col("zt") * F.col("zv")).alias("dot"),
                                        F.sum(F.col("zt") * F.col("zt")).alias("nt"),
                                        F.sum(F.col("zv") * F.col("zv")).alias("nv"),
                                        F.count(F.lit(1)).alias("overlap"))
            .filter((F.col("overlap") >= min_overlap) & (F.col("nt") > 0) & (F.col("nv") > 0))
            .select("t", "v", (F.col("dot") / F.sqrt(F.col("nt") * F.col("nv"))).alias("sim")))
    nbrs = top_k_per_group(sims, ["t"], [F.desc("sim"), F.asc("v")], nn, "row_number", "__rk").drop("__rk")
    wsum = nbrs.groupBy("t").agg(F.sum("sim").alias("wsum"))
    contrib = nbrs.join(others, "v").groupBy("t", item).agg(F.sum(F.col("sim") * F.col("zv")).alias("num"))
    rated = r.select(F.col(user).alias("t"), item)
    stats = z.select(F.col(user).alias("t"), "mu", "sd").distinct()
    pred = (contrib.join(rated, ["t", item], "left_anti").join(wsum, "t").join(stats, "t")
            .withColumn("pred", F.col("mu") + F.col("sd") * F.try_divide(F.col("num"), F.col("wsum"))))
    top = top_k_per_group(pred, ["t"], [F.desc("pred"), F.asc(item)], n, "row_number", "position")
    return top.select(F.col("t").alias(user), "position", item, "pred")


def ibcf_topn(r: DataFrame, user: str, item: str, rating: str, targets: DataFrame,
              k: int = 30, n: int = 5, min_overlap: int = 2) -> DataFrame:
    """M6: item-based CF for the target users.  Ratings are z-scored per
    user; an unrated item i is scored from the k items the target rated that
    are most similar to i (cosine over co-rating users):
    sum(sim * z_target) / sum(|sim|), de-normalised; top-n per target."""
    z = zscore_by_user(r, user, rating).filter(F.col("z").isNotNull())
    tz = z.join(targets.select(user), user, "left_semi").select(F.col(user).alias("t"), F.col(item).alias("j"),
                                                                 F.col("z").alias("zt"))
    # items rated by the targets, and every user's ratings of them
    tj = tz.select("j").distinct()
    zj = z.join(tj.withColumnRenamed("j", item), item, "left_semi").select(user, F.col(item).alias("j"),
                                                                            F.col("z").alias("zj"))
    zi = z.select(user, F.col(item).alias("i"), F.col("z").alias("zi"))
    pairs = zj.join(zi, user).filter(F.col("i") != F.col("j"))
    sims = (pairs.groupBy("i", "j").agg(F.sum(F.col("zi") * F.col("zj")).alias("dot"),
                                        F.sum(F.col("zi") * F.col("zi")).alias("ni"),
                                        F.sum(F.col("zj") * F.col("zj")).alias("nj"),
                                        F.count(F.lit(1)).alias("overlap"))
            .filter((F.col("overlap") >= min_overlap) & (F.col("ni") > 0) & (F.col("nj") > 0))
            .select("i", "j", (F.col("dot") / F.sqrt(F.col("ni") * F.col("nj"))).alias("sim")))
    cand = tz.join(sims, "j").join(r.select(F.col(user).alias("t"), F.col(item).alias("i")), ["t", "i"], "left_anti")
    nb = top_k_per_group(cand, ["t", "i"], [F.desc("sim"), F.asc("j")], k, "row_number", "__rk")
    sc = nb.groupBy("t", "i").agg(F.try_divide(F.sum(F.col("sim") * F.col("zt")), F.sum(F.abs("sim"))).alias("score"))
    stats = z.select(F.col(user).alias("t"), "mu", "sd").distinct()
    pred = sc.join(stats, "t").withColumn("pred", F.col("mu") + F.col("sd") * F.col("score"))
    top = top_k_per_group(pred, ["t"], [F.desc("pred"), F.asc("i")], n, "row_number", "position")
    return top.select(F.col("t").alias(user), "position", F.col("i").alias(item), "pred")


# ------------------------------------------- neighbours of all users or items
def rounded9(x: Column) -> Column:
    """x at nine decimals by IEEE steps that other engines share, so that equal values compare equal."""
    return F.floor(x * F.lit(1e9) + F.lit(0.5)).cast("double") / F.lit(1e9)


def unit_vectors(rows: DataFrame, by: list[str], id_: str, key: str, value: str) -> DataFrame:
    """by..., id, key, x: sparse vectors (id over keys) scaled to length one; zeros and zero vectors go."""
    norm = rows.groupBy(*by, id_).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("__n")).filter(F.col("__n") > 0)
    return rows.filter(F.col(value) != 0).join(norm, [*by, id_]) \
        .select(*by, F.col(id_).alias("id"), F.col(key).alias("key"), (F.col(value) / F.col("__n")).alias("x"))


#: Products that one group of vectors sums at once; elements of one key that travel in one row; products of one pass
#: at least, whose shuffle files go before the next pass; vectors with keys of lower classes only are not pruned.
_PRODUCTS, _RUN, _PASS, _CHEAP = 2_000_000, 4096, 100_000_000, 8


def _best(n: int, vector: np.ndarray, other: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the n highest scores of each vector (ties: smaller other).  vector ascends."""
    ends = np.flatnonzero(np.diff(vector, append=-1)) + 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    able = np.ones(len(vector), dtype=bool)
    for at in np.flatnonzero(ends - starts > 4 * n):            # long ones are cut at their n-th score before they are sorted
        mine = score[starts[at]:ends[at]]
        able[starts[at]:ends[at]] = mine >= np.partition(mine, len(mine) - n)[len(mine) - n]
    able = np.flatnonzero(able)
    order = able[np.lexsort((other[able], -score[able], vector[able]))]
    of = vector[order]
    return order[np.arange(len(order)) - np.searchsorted(of, of) < n]


def _places(others: pa.Array, ids: pa.Array, vectors: int) -> tuple[np.ndarray, np.ndarray, int, Callable]:
    """Numbers in the order of the values for `others` and `ids` (-1: not among the others), their bound, and the way back."""
    if pa.types.is_integer(others.type) and len(others):
        low, high = others.to_numpy().min(), others.to_numpy().max()
        if (int(high) - int(low) + 1) * vectors < 2**62:
            own = ids.cast(pa.int64()).to_numpy()
            inside = (own >= low) & (own <= high)
            return others.to_numpy().astype(np.int64) - int(low), np.where(inside, own - int(low), -1), int(high) - int(low) + 1, \
                lambda o: pa.array((o + int(low)).astype(others.type.to_pandas_dtype()))
    coded = others.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    names, place = coded.dictionary.take(pa.array(order)), np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], pc.index_in(ids, names).fill_null(-1).to_numpy(), max(1, len(order)), \
        lambda o: names.take(pa.array(o))


def _vectors(t: pa.Table, ids: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of every vector, and the number of each row's vector."""
    code = np.zeros(len(t), dtype=np.int64)
    for c in ids:
        d = pa.chunked_array(t[c].chunks).combine_chunks().dictionary_encode()
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy()
    _, first, vector = np.unique(code, return_index=True, return_inverse=True)
    return first, vector.astype(np.int64)


def _pair_sums(t: pa.Table, first: np.ndarray, vector: np.ndarray, terms: Callable):
    """Of the elements x of vectors and their lists (others, ys): vector * count + number of the other of each pair, ascending, the
    vectors' own numbers, count, the way from numbers to others, and the sums of each of terms(x, y) per pair."""
    lists = t["others"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy().astype(np.int64)
    others, own, count, names = _places(lists.flatten(), t["id"].combine_chunks().take(pa.array(first)), len(first))
    pair = np.repeat(vector, size) * count + others
    order = np.argsort(pair)
    pair = pair[order]
    new = np.flatnonzero(np.diff(pair, prepend=-1))
    each = terms(np.repeat(t["x"].to_numpy(), size), t["ys"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
    return pair[new], own, count, names, [np.add.reduceat(e[order], new) if len(new) else e.astype(float) for e in each]


def _lists(rows: DataFrame, keys: list[str], other: str, y: str, run: int) -> DataFrame:
    """keys..., others, ys: the elements of each key in lists of about `run` at most."""
    often = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__f"))
    part = F.pmod(F.xxhash64(other), F.ceil(F.col("__f") / run)).alias("__part")
    return rows.join(often, keys).groupBy(*keys, "__f", part).agg(F.collect_list(F.struct(F.col(other).alias("o"), F.col(y).alias("y"))).alias("__e")) \
        .select(*keys, "__f", F.col("__e.o").alias("others"), F.col("__e.y").alias("ys"))


def _packed(rows: DataFrame, right: DataFrame, by: list[str], run: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The elements of a key on both sides in one row (by..., key, mine, others, ys; mine: ids..., x), so that passes need no join.

    Keys with at most `run` elements on the right have one list of them, beside every `run` elements of the left.  Of
    keys with more, `rows` and the lists of the right stay apart (by..., key, id, x and by..., key, others, ys), to be joined;
    they are the second result, if there are any."""
    keys = [*by, "key"]
    lists = scratch.keep(_lists(right, keys, "other", "y", run).withColumn("many", F.col("__f") > run))
    common = lists.filter("many").select(*keys).distinct()
    few, many = rows, None
    if common.limit(1).count():
        few = rows.join(common, keys, "left_anti")
        many = scratch.keep(rows.join(common, keys, "left_semi"))
    size = few.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("__n") / run)).alias("__part")
    mine = few.join(size, keys).groupBy(*keys, part).agg(F.collect_list(F.struct("id", "x")).alias("mine"))
    return scratch.keep(mine.join(lists.filter("not many"), keys).select(*keys, "mine", "others", "ys")), \
        None if many is None else (many, lists.filter("many").select(*keys, "others", "ys"))


def _sums(packs: DataFrame, apart: tuple[DataFrame, DataFrame] | None, weights: DataFrame | None, by: list[str], dealt: Column, buckets: int,
          types: StructType, keep: Callable) -> DataFrame:
    """by..., id, other, dot: the products of the elements of the vectors that are `dealt` with those of their keys, summed
    per pair.  packs, apart: see `_packed`; weights: ids..., t, l (0 if None).  keep(vector, other, dot, t, l) gives the places of the pairs that stay.

    All products of a vector meet in one group of vectors: lists are shuffled, pairs are not.  t and l come as rows of their own."""
    ids = [*by, "id"]
    schema = StructType([*[types[c] for c in ids], StructField("other", types["id"].dataType), StructField("dot", DoubleType())])
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in ids]), F.lit(buckets)).alias("__bucket")
    none = F.lit(None).cast("double")
    met = packs.select(*by, F.inline("mine"), "others", "ys").filter(dealt).select(bucket, *ids, "x", none.alias("t"), none.alias("l"), "others", "ys")
    if apart is not None:
        met = met.unionByName(apart[0].filter(dealt).join(apart[1], [*by, "key"]).select(
            bucket, *ids, "x", none.alias("t"), none.alias("l"), "others", "ys"))
    if weights is not None:
        empty = [F.array().cast(met.schema[c].dataType).alias(c) for c in ("others", "ys")]
        met = met.unionByName(weights.filter(dealt).select(bucket, *ids, none.alias("x"), "t", "l", *empty))

    def summed(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        first, vector = _vectors(t, ids)
        bounds = np.zeros((2, len(first)))
        told = np.flatnonzero(pc.is_valid(t["t"]).to_numpy())
        for row, c in zip(bounds, ("t", "l")):
            row[vector[told]] = t[c].to_numpy()[told]
        pairs, own, count, names, (dot,) = _pair_sums(t, first, vector, lambda x, y: [x * y])
        v, o = pairs // count, pairs % count
        apart = own[v] != o
        v, o, dot = v[apart], o[apart], dot[apart]
        stay = keep(v, o, dot, bounds[0][v], bounds[1][v])
        out = t.select(ids).take(pa.array(first[v[stay]]))
        return pa.table([*out.columns, names(o[stay]), pa.array(dot[stay])], names=[*ids, "other", "dot"])
    return met.groupBy("__bucket").applyInArrow(summed, schema)


def in_passes(make: Callable[[Column], DataFrame], ids: list[str], passes: int, spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The union of make(condition on ids) over passes that deal all ids, each written to `folder` or a new one in the
    checkpoint folder; the shuffle files of a pass are removed at its end."""
    folder = folder or scratch_folder(spark, "passes")
    deal = F.pmod(F.xxhash64(F.lit("pass"), *[F.col(c) for c in ids]), F.lit(passes))
    with shuffles_removed(spark):
        for k in range(passes):
            make(deal == k if passes > 1 else F.lit(True)).write.option("compression", "zstd").parquet(f"{folder}/{k}")
    return spark.read.parquet(*[f"{folder}/{k}" for k in range(passes)])


def cosine_neighbours(left: DataFrame, right: DataFrame, by: list[str], k: int = 30, seed: int = 16,
                      work: list | None = None, cheap: int = _CHEAP, products: int = _PRODUCTS, run: int = _RUN,
                      pass_size: int = _PASS, into: Scratch | None = None) -> DataFrame:
    """by..., id, other, sim: for every vector of `left` its k nearest of `right` within `by` (cosine at nine
    decimals above 0, missing elements count 0; ties: smaller other).  Exact.  Both sides come from
    `unit_vectors`; a pair with equal ids is left out.

    A key shared by many vectors makes many pairs and tells little, so vectors
    meet on their rare keys.  Keys are classed by the power of two of the vectors that have them.
    A vector whose keys are all below the class `cheap` meets others on all of them.  For the rest, first,
    every left vector meets others on its rarest classes (until they hold `seed`
    keys); the best 2 k of these pairs are computed in full, and the k-th
    similarity among them is the vector's bound t.  Then it meets others on all classes
    but the most frequent ones whose part of the vector is shorter than t: who
    shares no other key with it cannot reach t.  A pair goes on if its sum so
    far and that length reach t; only those meet the frequent keys.

    Vectors meet by lists: the elements of right that have a key, up to `run` of them, stand in one row beside those of left
    (`_packed`), and the pairs of a vector are summed and cut to its best where they meet (`_sums`), so no pair that
    fails is shuffled or written.  More than `pass_size` products, and more than twice the elements, are worked through in passes
    over the left vectors, so that the files of a pass are of the input's size.  A vector with more than `products`
    products meets others row by row instead: nothing here needs all rows of a key or a vector in one task.
    What is written on the way goes at the end; the neighbours stay, in `into` if given.

    `work`, if given, gets the rows of the joins: all co-occurrences, those of
    the two rounds, and the pairs computed in full in the second."""
    spark = left.sparkSession
    scratch, unit, result = Scratch(spark, "neighbours"), Scratch(spark, "unit"), into or Scratch(spark, "nearest")
    ids, pair, same = [*by, "id"], [*by, "id", "other"], left is right
    right = (unit if same else scratch).keep(right.select(*by, F.col("id").alias("other"), "key", F.col("x").alias("y")))
    often = right.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("f"))
    if same:
        left = right.select(*by, F.col("other").alias("id"), "key", F.col("y").alias("x"))
    left = scratch.keep(left.join(often, [*by, "key"]).select(*ids, "key", "x", "f", F.floor(F.log2("f")).cast("int").alias("class")))
    if same:
        right = left.select(*by, F.col("id").alias("other"), "key", F.col("x").alias("y"))
        unit.drop()
    classes = left.groupBy(*ids, "class").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum("f").alias("w"))
    rare = Window.partitionBy(*ids).orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    frequent = Window.partitionBy(*ids).orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, 0)
    classes = scratch.keep(classes.withColumn("before", F.coalesce(F.sum("c").over(rare), F.lit(0)))
                           .withColumn("above", F.sum("q").over(frequent))
                           .withColumn("pruned", F.max("class").over(Window.partitionBy(*ids)) >= cheap))
    size = max(pass_size, 2 * left.count())

    def met(rows, weights, keep, rule, folder, bounded):
        """Pairs of the elements in `rows` that pass: keep in `_sums`, `rule` of a table of pairs by rows, and if there are such.
        weights: ids..., t, l, w (products of the vector); bounded: t and l are not all 0."""
        total, heavy = weights.agg(F.sum("w"), F.count_if(F.col("w") > products)).first()
        total = total or 0
        passes = max(1, math.ceil(total / size))
        buckets = max(1, math.ceil(total / passes / products))
        large, light = weights.filter(F.col("w") > products), weights.filter(F.col("w") <= products)
        packs, apart = _packed(rows.join(large, ids, "left_anti") if heavy else rows, right, by, run, scratch)
        found = in_passes(lambda dealt: _sums(packs, apart, light if bounded else None, by, dealt, buckets, left.schema, keep),
                          ids, passes, spark, folder)
        if not heavy:
            return found, total, False
        many = rows.join(large, ids).join(right, [*by, "key"]) \
            .filter(~F.col("id").eqNullSafe(F.col("other"))) \
            .groupBy(*pair).agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.first("t").alias("t"), F.first("l").alias("l"))
        return found.unionByName(scratch.keep(rule(many).select(*pair, "dot"))), total, True

    def in_full(pairs, missing):
        """dot plus the products of the keys in `missing` (rows of left)."""
        more = pairs.select(*pair).join(missing.select(*ids, "key", "x"), ids).join(right, [*by, "other", "key"]) \
            .select(*pair, (F.col("x") * F.col("y")).alias("dot"))
        return pairs.select(*pair, "dot").unionByName(more).groupBy(*pair).agg(F.sum("dot").alias("dot"))

    def some(condition):
        return left.join(classes.filter(condition).select(*ids, "class"), [*ids, "class"], "left_semi").select(*ids, "key", "x")
    first_round, at = 0, classes.withColumn("t", F.lit(0.0)).withColumn("rest", F.lit(False))
    pruned = bool(classes.filter("pruned").limit(1).count())
    if pruned:
        seeded = F.col("pruned") & (F.col("before") < seed)
        weights = classes.filter(seeded).groupBy(*ids).agg(F.lit(0.0).alias("t"), F.lit(0.0).alias("l"), F.sum("w").alias("w"))
        few, first_round, _ = met(some(seeded), weights, lambda v, o, dot, t, l: _best(2 * k, v, o, dot),
                                  lambda d: top_k_per_group(d, ids, [F.desc("dot"), F.asc("other")], 2 * k, "row_number", "__r"), scratch.path(), False)
        few = top_k_per_group(in_full(few, some(F.col("pruned") & (F.col("before") >= seed))), ids, [F.desc("dot"), F.asc("other")], k,
                              "row_number", "__r")
        bound = few.groupBy(*ids).agg(F.count(F.lit(1)).alias("__c"), F.min("dot").alias("t")) \
            .filter((F.col("__c") == k) & (F.col("t") > 0)).select(*ids, (F.col("t") - 1e-9).alias("t"))
        at = classes.join(bound, ids, "left").withColumn("t", F.greatest(F.coalesce("t", F.lit(0.0)), F.lit(0.0))) \
            .withColumn("rest", F.sqrt("above") * (1 + 1e-12) < F.col("t"))
        at = classes = scratch.keep(at)
    limit = at.groupBy(*ids).agg(F.max("t").alias("t"), F.coalesce(F.sqrt(F.sum(F.when(F.col("rest"), F.col("q")))), F.lit(0.0)).alias("l"),
                                 F.coalesce(F.sum(F.when(~F.col("rest"), F.col("w"))), F.lit(0)).alias("w"))

    def open_pairs(v, o, dot, t, l):
        """Of vectors without a frequent part the k best, whose sums are complete; of others what can reach t."""
        sim = np.floor(dot * 1e9 + 0.5) / 1e9
        done = np.flatnonzero((l == 0) & (sim > 0))
        return np.concatenate([done[_best(k, v[done], o[done], sim[done])], np.flatnonzero((l > 0) & (dot + l + 1e-9 >= t))])
    if pruned:
        need = left.join(at.filter(~F.col("rest")).select(*ids, "class"), [*ids, "class"], "left_semi").select(*ids, "key", "x")
    else:
        need = left.select(*ids, "key", "x")
    open_, second_round, heavy = met(need, limit, open_pairs, lambda d: d.filter(F.col("dot") + F.col("l") + 1e-9 >= F.col("t")),
                                     scratch.path() if pruned else result.path(), pruned)
    if work is not None:
        every = left.agg(F.sum("f")).first()[0]
        open_ = scratch.keep(open_) if pruned or heavy else open_
        work += [("co_occurrences", every or 0), ("first_round", first_round), ("second_round", second_round), ("in_full", open_.count())]
    if pruned:
        frequent_part = left.join(at.filter("rest").select(*ids, "class"), [*ids, "class"], "left_semi")
        open_ = in_full(open_, frequent_part)
    sims = open_.select(*pair, rounded9(F.col("dot")).alias("sim")).filter(F.col("sim") > 0)
    if pruned or heavy:                                         # else every vector's best were found at one place
        sims = result.keep(top_k_per_group(sims, ids, [F.desc("sim"), F.asc("other")], k, "row_number", "__r").select(*ids, "other", "sim"))
    scratch.drop()
    return sims


def _scores(rows: DataFrame, lists: DataFrame, key: str, by: list[str], buckets: int, packed: bool) -> DataFrame:
    """by..., id, item, score: sum(x y) / w over the elements of rows (by..., id, key, x, w) with the lists of their keys, null
    if no product is known; where w is null it is sum(y).  packed: by..., id, items, scores, a row per id.

    As in `_sums`, lists are shuffled and the scores of an id are made at one place."""
    ids = [*by, "id"]
    schema = StructType([*[rows.schema[c] for c in ids], StructField("items", ArrayType(lists.schema["others"].dataType.elementType)),
                         StructField("scores", ArrayType(DoubleType()))])
    bucket = F.pmod(F.xxhash64(F.lit("score"), *[F.col(c) for c in ids]), F.lit(buckets)).alias("__bucket")

    def scored(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        first, vector = _vectors(t, ids)
        pairs, _, count, names, (s, y, n) = _pair_sums(t, first, vector, lambda x, y: [
            np.nan_to_num(x * y), np.nan_to_num(y), (~np.isnan(x * y)).astype(float)])
        v = pairs // count
        w = t["w"].to_numpy()[first][v]
        score = np.floor(s / np.where(np.isnan(w), y, w) * 1e9 + 0.5) / 1e9      # rounded9
        ends = np.concatenate(([0], np.cumsum(np.bincount(v, minlength=len(first))))).astype(np.int32)
        return pa.table([*t.select(ids).take(pa.array(first)).columns, pa.ListArray.from_arrays(pa.array(ends), names(pairs % count)),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(score, mask=n == 0))], names=schema.names)
    out = rows.join(lists, [*by, key]).select(bucket, *ids, "x", "w", "others", "ys").groupBy("__bucket").applyInArrow(scored, schema)
    return out if packed else out.select(*ids, F.inline(F.arrays_zip(F.col("items").alias("item"), F.col("scores").alias("score"))))


def user_scores(neighbours: DataFrame, rows: DataFrame, by: list[str], buckets: int = 200, packed: bool = False) -> DataFrame:
    """by..., id, item, score of the items that a user's neighbours rated: sum(sim * z) / sum(sim of all
    neighbours).  rows: by..., other, item, z.  buckets, packed: see `_scores`."""
    total = neighbours.groupBy(*by, "id").agg(F.sum("sim").alias("w"))
    near = neighbours.join(total, [*by, "id"]).select(*by, "id", "other", F.col("sim").alias("x"), "w")
    return _scores(near, _lists(rows, [*by, "other"], "item", "z", _RUN), "other", by, buckets, packed)


def item_scores(model: DataFrame, rows: DataFrame, by: list[str], buckets: int = 200, packed: bool = False) -> DataFrame:
    """by..., id, item, score of the items with a neighbour among the user's own: sum(sim * z) / sum(sim).
    model: by..., id (item), other, sim; rows: by..., id (user), item, z.  buckets, packed: see `_scores`."""
    near = model.select(*by, F.col("id").alias("item"), F.col("other").alias("__j"), "sim")
    own = rows.select(*by, "id", F.col("item").alias("__j"), F.col("z").alias("x"), F.lit(None).cast("double").alias("w"))
    return _scores(own, _lists(near, [*by, "__j"], "item", "sim", _RUN), "__j", by, buckets, packed)


def held_out_ranks(scores: DataFrame, own: DataFrame, held: DataFrame, by: list[str], buckets: int = 200) -> DataFrame:
    """by..., id, item, good, given, scored, rank for the one item held out of each user.

    rank is counted: one more than the unrated items with a better score (ties:
    smaller item); null if the item has no score.  No list of items is made, and scores are shuffled once: `buckets` groups
    of users are ranked together.  scores may be packed.  own: by..., id, item (the ratings that are known); held: by..., id, item, good."""
    ids = [*by, "id"]
    if "items" not in scores.columns:
        scores = scores.select(*ids, F.array("item").alias("items"), F.array("score").alias("scores"))
    bucket = F.pmod(F.xxhash64(F.lit("rank"), *[F.col(c) for c in ids]), F.lit(buckets)).alias("__bucket")
    none = [F.lit(None).cast("boolean").alias("good"), F.array().cast(scores.schema["scores"].dataType).alias("scores")]
    rows = scores.select(bucket, *ids, "items", none[0], "scores", F.lit(0).alias("kind")) \
        .unionByName(own.select(bucket, *ids, F.array("item").alias("items"), *none, F.lit(1).alias("kind"))) \
        .unionByName(held.select(bucket, *ids, F.array("item").alias("items"), "good", none[1], F.lit(2).alias("kind")))
    schema = StructType([*[rows.schema[c] for c in ids], held.schema["item"], rows.schema["good"],
                         *[StructField(c, LongType()) for c in ("given", "scored", "rank")]])

    def ranked(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        first, of_row = _vectors(t, ids)
        lists = t["items"].combine_chunks()
        size, items = pc.list_value_length(lists).to_numpy(), lists.flatten()
        row, vector, kind = np.repeat(np.arange(len(t)), size), np.repeat(of_row, size), np.repeat(t["kind"].to_numpy(), size)
        place, _, count, _ = _places(items, items.slice(0, 0), len(first))
        pair, score = vector * count + place, np.full(len(vector), np.nan)
        score[kind == 0] = t["scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        known, mine, of = pair[kind == 1], np.flatnonzero(kind == 2), np.flatnonzero(kind == 0)
        given = np.bincount(vector[kind == 1], minlength=len(first))
        told = of[np.argsort(pair[of])]                         # the scores in the order of users and items
        at = np.minimum(np.searchsorted(pair[told], pair[mine]), max(0, len(told) - 1))
        has = pair[told][at] == pair[mine] if len(told) else np.zeros(len(mine), dtype=bool)
        own_score, own_place = np.full(len(first), np.nan), np.full(len(first), -1)
        own_score[vector[mine[has]]], own_place[vector[mine]] = score[told[at[has]]], place[mine]
        new = of[~np.isin(pair[of], known)]
        v, s = vector[new], score[new]
        better = (s > own_score[v]) | ((s == own_score[v]) & (place[new] < own_place[v]))
        scored, above = np.bincount(v, minlength=len(first)), np.bincount(v[better], minlength=len(first))
        v = vector[mine]
        out = t.select([*ids, "good"]).take(pa.array(row[mine]))
        rank = pa.array(above[v] + 1, pa.int64(), mask=np.isnan(own_score[v]))
        return pa.table([*out.columns[:-1], items.take(pa.array(mine)), out.columns[-1], pa.array(given[v], pa.int64()),
                         pa.array(scored[v], pa.int64()), rank], names=schema.names)
    return rows.groupBy("__bucket").applyInArrow(ranked, schema)


def topn_table(ranks: DataFrame, items: int | Column, ns: list[int], group: list[str]) -> DataFrame:
    """Group..., n, users, tp, fp, fn, tn, tpr, fpr for lists of n: what is recommended is the n best
    scored unrated items; the held-out item is relevant if it is good."""
    def one(n):
        hit = (F.col("good") & (F.col("rank") <= n)).cast("long")
        listed = F.least(F.lit(n), F.col("scored"))
        miss = F.col("good").cast("long") - F.coalesce(hit, F.lit(0))
        return F.struct(F.lit(n).alias("n"), F.coalesce(hit, F.lit(0)).alias("tp"), (listed - F.coalesce(hit, F.lit(0))).alias("fp"),
                        miss.alias("fn"), ((items if isinstance(items, Column) else F.lit(items)) - F.col("given") - listed - miss).alias("tn"))
    each = ranks.select(*group, F.explode(F.array(*[one(n) for n in ns])).alias("e")).select(*group, "e.*")
    total = each.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("users"), *[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])
    return total.withColumn("tpr", F.try_divide("tp", F.col("tp") + F.col("fn"))) \
        .withColumn("fpr", F.try_divide("fp", F.col("fp") + F.col("tn")))
