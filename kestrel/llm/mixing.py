"""Mixing sources to target weights by weighted fair queueing.

Every source has a target number of words.  Its documents queue up in a
shuffled order; a document's virtual finish time is the words of its source up
to and with it, divided by the source's target.  All queues are then merged by
virtual finish time with a global range sort, and the merge is cut at the
total budget, so every source is served in proportion to its target.  A
document may be served in several rounds (repeats): round r's finish time
counts r whole rounds of its source before it.

Everything is DataFrame work.  Running totals over all rows never use one
task or one source's rows in one window: rows are range partitioned, a
partition's start comes from the totals of the partitions before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import col, cut, fresh
from kestrel.operators.ordered import prefix_sums


@dataclass(frozen=True)
class MixParams:
    """weights: given to the sources in code-point order (null last), over and
    over.  budget: words of the mix over words of the input.  repeats: most
    times a document, and hence a source, may be served.  salt: shuffle seed.
    broadcast_sources: most sources whose targets are broadcast, not joined."""
    weights: tuple[int, ...] = (5, 2, 1)
    budget: float = 1.5
    repeats: int = 2
    salt: str = "mix"
    broadcast_sources: int = 100_000


def size_of(text: Column) -> Column:
    """Words: maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Columns source, place, weight, source_size, target from source, source_size.

    Shares of the budget go by weight; a target stops at `repeats` times its
    source's size and the excess is shared again by weight.  The end of that
    resharing is a water level: sources in order of the level that fills them
    (cap / weight) are full as long as the level left by the ones before them
    reaches theirs.  One row per source is all this looks at.
    """
    w = F.array(*[F.lit(int(x)).cast("long") for x in params.weights])
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("place", F.row_number().over(by_name).cast("long")) \
        .withColumn("weight", F.element_at(w, (F.pmod(F.col("place") - 1, F.lit(len(params.weights))) + 1).cast("int"))) \
        .withColumn("cap", F.col("source_size") * params.repeats)
    full = F.col("cap") / F.col("weight")
    before = Window.orderBy(full, "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(full, "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.lit(params.budget) * F.sum("source_size").over(everything)) \
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))) \
        .withColumn("weight_from", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), F.lit(0))) \
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    # the first source whose own filling level is above the level left sets the final level for all after it
    final = F.min(F.when(full > F.col("level"), F.struct("cap_before", "weight_from", "level"))).over(everything)["level"]
    s = s.withColumn("final", final)
    target = F.when(F.col("final").isNull() | (full <= F.col("final")), F.col("cap").cast("double")) \
        .otherwise(F.col("final") * F.col("weight"))
    return s.select("source", "place", "weight", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        params: MixParams = MixParams()) -> DataFrame:
    """Columns key, size, source_size, target, taken for every row.

    taken counts the words the mix serves of the row, repeats included: 0 to
    `repeats` times its size.  The mix is the longest run of the merged queue
    within the total budget; a source misses its target by no more than the
    documents at the cut, and what a long one leaves open goes to the others.  The shuffle is md5 of the key with the salt:
    reruns agree.  Null and empty texts have size 0 and take 0.  A null source
    is a source of its own, after all others.  Repeated rows are documents of
    their own.  Other columns are not read.  An empty table gives an empty
    result.
    """
    return _queued(docs, text, source, key, params).select(F.col("id").alias(key), "size", "source_size", "target", "taken")


def _shuffled(key: str, params: MixParams) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(col(key).cast("string"), F.lit("")), F.lit(params.salt)))


def _queued(docs: DataFrame, text: str, source: str, key: str, params: MixParams) -> DataFrame:
    """What `mix` returns, with the source and the place in its queue: mixed, then id."""
    base = cut(docs.select(col(key).alias("id"), col(source).cast("string").alias("source"),
                           size_of(col(text)).alias("size"), _shuffled(key, params).alias("mixed")))
    goal = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), params)
               .withColumn("ahead", F.coalesce(F.sum("source_size").over(
                   Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # words of the source up to each document: a running total over (source, shuffle), less the sources ahead
    queue = prefix_sums(base, [F.col("source").isNull(), F.col("source"), "mixed", "id", "size"], ["size"])
    few = goal.count() <= params.broadcast_sources
    side = goal.withColumnRenamed("source", "of")
    queue = queue.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("of"))) \
        .withColumn("own", F.col("cum_size") - F.col("ahead"))

    def turn(r: Column) -> Column:
        """Place in the merged queue of round r: finish time, then a fixed order of ties."""
        finish = (F.col("own") + r * F.col("source_size")) / F.col("target")
        return F.struct(finish.alias("finish"), "place", "mixed", "id", r.cast("int").alias("round"))

    rounds = range(params.repeats)
    served = queue.filter("size > 0 and target > 0") \
        .select("size", F.explode(F.array(*[turn(F.lit(r)) for r in rounds])).alias("turn"))
    merged = prefix_sums(served, ["turn"], ["size"])
    total = goal.agg(F.sum("source_size") * min(float(params.budget), float(params.repeats))).scalar()
    last = cut(merged.filter(F.col("cum_size") <= total).agg(F.max("turn").alias("last"))).scalar()
    taken = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (turn(F.lit(r)) <= last), F.col("size"))
                 .otherwise(F.lit(0)) for r in rounds), F.lit(0))
    return queue.select("source", "mixed", "id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
              params: MixParams = MixParams(), name: str = "round") -> DataFrame:
    """The mixed corpus: every row of `docs` once per round it is served in, with the round as a column.

    Rows repeated under one key in one source are served alike, as often as the
    most served of them.  Rows that are not served, those without words among
    them, go.  Of every source a round serves the front of its queue, so
    what is needed of the mix is the last place served per source and round: a
    row per source, which meets the documents where they are read.
    """
    served = _queued(docs, text, source, key, params).filter("taken > 0") \
        .select("source", F.struct("mixed", "id").alias("at"), F.explode(F.sequence(F.lit(1), F.floor(F.col("taken") / F.col("size")).cast("int"))).alias("r"))
    ends = cut(served.groupBy("source", "r").agg(F.max("at").alias("last")).groupBy("source")
               .agg(F.collect_list("last").alias("ends")))               # at most `repeats` each
    o, e = fresh(docs, "served_source"), fresh(docs, "served_ends")
    side = ends.select(F.col("source").alias(o), F.col("ends").alias(e))
    if ends.count() <= params.broadcast_sources:
        side = F.broadcast(side)
    out = docs.join(side, col(source).cast("string").eqNullSafe(F.col(o))).filter(size_of(col(text)) > 0)
    at = F.struct(_shuffled(key, params).alias("mixed"), col(key).alias("id"))
    rounds = F.size(F.filter(col(e), lambda last: at <= last))
    n = fresh(docs, "served_n")
    out = out.withColumn(n, rounds).filter(F.col(n) > 0)
    return out.select(*[col(c) for c in docs.columns],
                      F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(fresh(docs, name)))


def oracle_sql(params: MixParams = MixParams(), table: str = "documents") -> str:
    """DuckDB SQL for `mix` over a table of documents."""
    case = " ".join(f"when {i} then {w}" for i, w in enumerate(params.weights))
    return f"""
with base as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5(concat_ws(':', coalesce(doc_id::varchar, ''), '{params.salt}')) as mixed
  from {table}),
src as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source is null, source) as place from base group by source),
w as (
  select *, case (place - 1) % {len(params.weights)} {case} end as weight, {params.repeats} * source_size as cap from src),
f as (select *, cap::double / weight as full_at from w),
l as (
  select *, {float(params.budget)} * (sum(source_size) over ())::double as total,
         coalesce(sum(cap) over o, 0)::double as cap_before,
         (sum(weight) over () - coalesce(sum(weight) over o, 0))::double as weight_from
  from f window o as (order by full_at, place rows between unbounded preceding and 1 preceding)),
lv as (select *, (total - cap_before) / weight_from as level from l),
fin as (select arg_min(level, cap_before) as final from lv where full_at > level),
goal as (
  select source, place, source_size,
         case when final is null or full_at <= final then cap::double else final * weight end as target
  from lv, fin),
queue as (
  select b.*, g.place, g.source_size, g.target,
         sum(b.size) over (partition by g.place order by b.mixed, b.doc_id, b.size
                           rows between unbounded preceding and current row)::bigint as own
  from base b join goal g on b.source is not distinct from g.source),
turns as (
  select doc_id, size, place, mixed, round, (own + round * source_size)::double / target as finish
  from queue, (select unnest(range({params.repeats})) as round) r where size > 0 and target > 0),
merged as (
  select *, sum(size) over (order by finish, place, mixed, doc_id, round
                            rows between unbounded preceding and current row) as cum from turns),
kept as (
  select doc_id, mixed, sum(size)::bigint as taken from merged
  where cum <= (select sum(source_size) * {min(float(params.budget), float(params.repeats))} from src)
  group by doc_id, mixed)
select q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0)::bigint as taken
from queue q left join kept k on q.doc_id is not distinct from k.doc_id
"""
