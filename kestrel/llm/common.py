"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: an eager checkpoint in the shared folder of `spark.checkpoint.dir`."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder name of its own under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or the first of `name_1`, `name_2`, ... that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out, k = name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def col(name: str) -> Column:
    """A column by its plain name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo `modulus`; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def pieces(arr: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, length) of slices of a text array of about `limit` bytes each, so
    what a function makes of its texts never grows with the batch."""
    end = np.cumsum(pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(arr):
        base = end[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, base + limit, "right")))
        yield lo, hi - lo
        lo = hi


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: columns node, root (the smallest node it reaches).

    Alternating large-star and small-star steps: every node is linked to the
    smallest node of its neighbourhood until the graph is a forest of stars,
    in O(log^2 n) rounds.  Each step is a map-side-combined minimum and an
    equi-join whose unique side is the minimum, so a hub's edges can be split
    over tasks.  Every round is checkpointed in the shared folder; only a
    count and a checksum reach the driver.  Nodes without an edge are absent.
    """
    e = cut(edges.filter(F.col(u) != F.col(v))
            .select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).distinct())
    state = _checksum(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")) \
            .select("hi", F.least("hi", "m").alias("m"))
        large = both.filter(F.col("lo") > F.col("hi")).join(least, "hi") \
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo")) \
            .filter(F.col("hi") != F.col("lo")).distinct()
        near = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(near, "hi")
        small = small.filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")) \
            .unionByName(near.select("hi", F.col("m").alias("lo"))).distinct()
        e = cut(small)
        new = _checksum(e)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")),
                       F.bit_xor(F.xxhash64("lo", "hi"))).first())
