"""Beer-review recommendation: support filtering, rating-matrix statistics,
cosine similarity of the first users/items, user- and item-based CF for the
most active users.  Stand-in: `ratings` (customer x part, 0-5 stars)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.operators.ordered import exact_percentiles
from kestrel.operators.recommend import (
    cosine_among, cosine_neighbours, held_out_ranks, ibcf_topn, in_passes, item_scores, min_support_filter, topn_table, ubcf_topn, unit_vectors,
    user_scores, zscore_by_user,
)
from kestrel.operators.relational import count_of_counts, group_count, top_k_per_group
from kestrel.plans import standins as S
from kestrel.plans.registry import query
from kestrel.session import Scratch, ensure_checkpoint_dir

MIN_ITEM, MIN_USER = 30, 30
N_FIRST = 10          # similarity report over the first ten users / items
N_TARGETS = 3         # users served by the recommenders
NN, TOP_N, MIN_OVERLAP = 30, 5, 2

FR_SQL = f"""fr AS (
  SELECT * FROM ratings
  WHERE beer_beerid IN (SELECT beer_beerid FROM ratings GROUP BY 1 HAVING count(*) >= {MIN_ITEM})
    AND user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= {MIN_USER}))"""

Z_SQL = FR_SQL + """,
z AS (SELECT fr.*, mu, sd, CASE WHEN sd > 0 THEN (review_overall - mu) / sd END AS z
      FROM fr JOIN (SELECT user_id, avg(review_overall) AS mu, stddev_samp(review_overall) AS sd FROM fr GROUP BY 1) s
      USING (user_id)),
targets AS (SELECT user_id FROM fr GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT """ + str(N_TARGETS) + ")"


def filtered(spark: SparkSession, d: str) -> DataFrame:
    return min_support_filter(S.ratings(spark, d), "user_id", "beer_beerid", MIN_ITEM, MIN_USER)


def kept_filtered(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    """beer_beerid, user_id, review_overall of `filtered`, written once: what is learnt from it reads it many times."""
    whole = Scratch(spark, "ratings")
    r = whole.keep(S.ratings(spark, d).select("beer_beerid", "user_id", "review_overall"))
    fr = scratch.keep(min_support_filter(r, "user_id", "beer_beerid", MIN_ITEM, MIN_USER))
    whole.drop()
    return fr


def targets(fr: DataFrame) -> DataFrame:
    """The most active users (ties: smallest id): a top-k report set."""
    return fr.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(N_TARGETS)


@query("min_support_filter", ["ratings"], FR_SQL + "\nSELECT beer_beerid, user_id, review_overall FROM fr")
def min_support_filter_q(spark: SparkSession, d: str) -> DataFrame:
    """M1: items with >= 30 reviews and users with >= 30 reviews."""
    return filtered(spark, d).select("beer_beerid", "user_id", "review_overall")


@query("rating_distribution", ["ratings"], FR_SQL + "\nSELECT review_overall, count(*) AS frequency_rating FROM fr GROUP BY 1")
def rating_distribution(spark: SparkSession, d: str) -> DataFrame:
    """M4: how often each rating value occurs."""
    return group_count(filtered(spark, d), ["review_overall"], "frequency_rating")


@query("count_of_counts", ["ratings"], """
SELECT group_size, count(*) AS n_beers FROM (SELECT beer_beerid, count(*) AS group_size FROM ratings GROUP BY 1) GROUP BY 1""")
def count_of_counts_q(spark: SparkSession, d: str) -> DataFrame:
    """Number of beers by number of reviews."""
    return count_of_counts(S.ratings(spark, d), "beer_beerid", "n_beers")


@query("join_inner_diff_keys", ["ratings"], """
SELECT r.beer_beerid, r.user_id, c.n_reviews FROM ratings r
JOIN (SELECT beer_beerid AS beer_id, count(*) AS n_reviews FROM ratings GROUP BY 1) c ON r.beer_beerid = c.beer_id""")
def join_inner_diff_keys(spark: SparkSession, d: str) -> DataFrame:
    """Join on differently named keys (beer_beerid = beer_id)."""
    r = S.ratings(spark, d)
    c = r.groupBy(F.col("beer_beerid").alias("beer_id")).agg(F.count(F.lit(1)).alias("n_reviews"))
    return r.join(c, r.beer_beerid == c.beer_id).select("beer_beerid", "user_id", "n_reviews")


@query("rating_matrix_stats", ["ratings"], FR_SQL + """
SELECT user_id, avg(review_overall) AS row_mean, count(*) AS row_count FROM fr GROUP BY 1""")
def rating_matrix_stats(spark: SparkSession, d: str) -> DataFrame:
    """rowMeans / rowCounts of the rating matrix."""
    return filtered(spark, d).groupBy("user_id").agg(F.avg("review_overall").alias("row_mean"),
                                                     F.count(F.lit(1)).alias("row_count"))


@query("zscore_by_user", ["ratings"], Z_SQL + "\nSELECT user_id, beer_beerid, round(z, 6) AS z FROM z")
def zscore_by_user_q(spark: SparkSession, d: str) -> DataFrame:
    """Z-score normalisation within each user."""
    z = zscore_by_user(filtered(spark, d), "user_id", "review_overall")
    return z.select("user_id", "beer_beerid", F.round("z", 6).alias("z"))


@query("avg_rating_distribution", ["ratings"], FR_SQL + """,
a AS (SELECT beer_beerid, avg(review_overall) AS avg_rating FROM fr GROUP BY 1)
SELECT round(min(avg_rating), 6) AS min, round(quantile_cont(avg_rating, 0.25), 6) AS q1,
       round(quantile_cont(avg_rating, 0.5), 6) AS median, round(avg(avg_rating), 6) AS mean,
       round(quantile_cont(avg_rating, 0.75), 6) AS q3, round(max(avg_rating), 6) AS max FROM a""")
def avg_rating_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of per-beer average ratings (summary of averages)."""
    ensure_checkpoint_dir(spark)
    a = filtered(spark, d).groupBy("beer_beerid").agg(F.avg("review_overall").alias("avg_rating")).checkpoint(eager=True)
    q = exact_percentiles(a, "avg_rating", [0.25, 0.5, 0.75])
    qs = q.agg(*[F.max(F.when(F.col("p") == p, F.round("value", 6))).alias(c) for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    ends = a.agg(F.struct(F.round(F.min("avg_rating"), 6).alias("min"), F.round(F.avg("avg_rating"), 6).alias("mean"),
                          F.round(F.max("avg_rating"), 6).alias("max"))).scalar()
    return qs.select(ends["min"].alias("min"), "q1", "median", ends["mean"].alias("mean"), "q3", ends["max"].alias("max"))


def _cos_sql(key: str, other: str) -> str:
    return FR_SQL + f""",
m AS (SELECT * FROM fr WHERE {key} IN (SELECT DISTINCT {key} FROM fr ORDER BY 1 LIMIT {N_FIRST})),
p AS (SELECT a.{key} AS key_a, b.{key} AS key_b, a.review_overall AS va, b.review_overall AS vb
      FROM m a JOIN m b ON a.{other} = b.{other} AND a.{key} < b.{key})
SELECT key_a, key_b, round(CASE WHEN sum(va * va) * sum(vb * vb) > 0
                                THEN sum(va * vb) / sqrt(sum(va * va) * sum(vb * vb)) END, 6) AS sim, count(*) AS overlap
FROM p GROUP BY 1, 2"""


def _first(fr: DataFrame, key: str) -> DataFrame:
    return fr.select(key).distinct().orderBy(key).limit(N_FIRST)


@query("user_cosine", ["ratings"], _cos_sql("user_id", "beer_beerid"))
def user_cosine(spark: SparkSession, d: str) -> DataFrame:
    """M2: cosine similarity of the first ten users (co-rated beers)."""
    fr = filtered(spark, d)
    c = cosine_among(fr, "user_id", "beer_beerid", "review_overall", _first(fr, "user_id"))
    return c.select("key_a", "key_b", F.round("sim", 6).alias("sim"), "overlap")


@query("item_cosine", ["ratings"], _cos_sql("beer_beerid", "user_id"))
def item_cosine(spark: SparkSession, d: str) -> DataFrame:
    """M3: cosine similarity of the first ten beers (co-rating users)."""
    fr = filtered(spark, d)
    c = cosine_among(fr, "beer_beerid", "user_id", "review_overall", _first(fr, "beer_beerid"))
    return c.select("key_a", "key_b", F.round("sim", 6).alias("sim"), "overlap")


@query("ubcf_topn", ["ratings"], Z_SQL + f""",
zz AS (SELECT * FROM z WHERE z IS NOT NULL),
tz AS (SELECT user_id AS t, beer_beerid, z AS zt FROM zz WHERE user_id IN (SELECT user_id FROM targets)),
sims AS (SELECT t, o.user_id AS v, sum(zt * o.z) / sqrt(sum(zt * zt) * sum(o.z * o.z)) AS sim
         FROM tz JOIN zz o USING (beer_beerid) WHERE o.user_id <> t GROUP BY t, o.user_id
         HAVING count(*) >= {MIN_OVERLAP} AND sum(zt * zt) > 0 AND sum(o.z * o.z) > 0),
nbrs AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY t ORDER BY sim DESC, v) <= {NN}),
ws AS (SELECT t, sum(sim) AS wsum FROM nbrs GROUP BY t),
contrib AS (SELECT t, o.beer_beerid, sum(sim * o.z) AS num FROM nbrs JOIN zz o ON o.user_id = v GROUP BY ALL),
st AS (SELECT DISTINCT user_id AS t, mu, sd FROM zz),
pred AS (SELECT c.t, c.beer_beerid, mu + sd * num / wsum AS pred FROM contrib c JOIN ws USING (t) JOIN st USING (t)
         WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.user_id = c.t AND fr.beer_beerid = c.beer_beerid))
SELECT t AS user_id, CAST(row_number() OVER (PARTITION BY t ORDER BY pred DESC, beer_beerid) AS INTEGER) AS position,
       beer_beerid, round(pred, 6) AS pred
FROM pred QUALIFY position <= {TOP_N}""")
def ubcf_topn_q(spark: SparkSession, d: str) -> DataFrame:
    """M5/M7: top-5 unrated beers for the three most active users (UBCF,
    Z-score, cosine, 30 neighbours)."""
    fr = filtered(spark, d)
    out = ubcf_topn(fr, "user_id", "beer_beerid", "review_overall", targets(fr), NN, TOP_N, MIN_OVERLAP)
    return out.select("user_id", "position", "beer_beerid", F.round("pred", 6).alias("pred"))


@query("ibcf_topn", ["ratings"], Z_SQL + f""",
zz AS (SELECT * FROM z WHERE z IS NOT NULL),
tz AS (SELECT user_id AS t, beer_beerid AS j, z AS zt FROM zz WHERE user_id IN (SELECT user_id FROM targets)),
zj AS (SELECT user_id, beer_beerid AS j, z AS zj FROM zz WHERE beer_beerid IN (SELECT j FROM tz)),
sims AS (SELECT i.beer_beerid AS i, zj.j, sum(i.z * zj) / sqrt(sum(i.z * i.z) * sum(zj * zj)) AS sim
         FROM zj JOIN zz i USING (user_id) WHERE i.beer_beerid <> zj.j GROUP BY 1, 2
         HAVING count(*) >= {MIN_OVERLAP} AND sum(i.z * i.z) > 0 AND sum(zj * zj) > 0),
cand AS (SELECT tz.t, s.i, s.j, s.sim, tz.zt FROM tz JOIN sims s USING (j)
         WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.user_id = tz.t AND fr.beer_beerid = s.i)),
nb AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY t, i ORDER BY sim DESC, j) <= {NN}),
sc AS (SELECT t, i, sum(sim * zt) / sum(abs(sim)) AS score FROM nb GROUP BY 1, 2),
st AS (SELECT DISTINCT user_id AS t, mu, sd FROM zz),
pred AS (SELECT t, i, mu + sd * score AS pred FROM sc JOIN st USING (t))
SELECT t AS user_id, CAST(row_number() OVER (PARTITION BY t ORDER BY pred DESC, i) AS INTEGER) AS position,
       i AS beer_beerid, round(pred, 6) AS pred
FROM pred QUALIFY position <= {TOP_N}""")
def ibcf_topn_q(spark: SparkSession, d: str) -> DataFrame:
    """M6/M7: top-5 unrated beers for the same users (IBCF, Z-score, cosine,
    30 most similar rated items)."""
    fr = filtered(spark, d)
    out = ibcf_topn(fr, "user_id", "beer_beerid", "review_overall", targets(fr), NN, TOP_N, MIN_OVERLAP)
    return out.select("user_id", "position", "beer_beerid", F.round("pred", 6).alias("pred"))


# ------------------------------------------------------- evaluation schemes
EVAL_SEED, TRAIN_SHARE, EVAL_FOLDS, GOOD_RATING = 42, 8000, 5, 4


@query("eval_scheme", ["ratings"], FR_SQL + f""",
h AS (SELECT *, CAST('0x' || substr(md5('{EVAL_SEED}|' || user_id), 1, 8) AS BIGINT) AS u,
             row_number() OVER (PARTITION BY user_id ORDER BY md5('{EVAL_SEED}|' || user_id || '|' || beer_beerid), beer_beerid) AS nth
      FROM fr)
SELECT user_id, beer_beerid, u % 10000 < {TRAIN_SHARE} AS is_train, CAST(u % {EVAL_FOLDS} AS INTEGER) AS fold, nth = 1 AS held_out,
       review_overall >= {GOOD_RATING} AS is_good FROM h""")
def eval_scheme(spark: SparkSession, d: str) -> DataFrame:
    """M8: 80/20 split and five folds of the users, and the one rating held
    out of each user (all-but-one), by md5; ratings of 4 and more are good.
    The held-out rating is a map-side-combined minimum per user."""
    return _scheme(filtered(spark, d)).drop("review_overall")


def _scheme(fr: DataFrame) -> DataFrame:
    """Every rating with its part in the evaluation."""
    seed = F.lit(str(EVAL_SEED))
    user, item = F.col("user_id").cast("string"), F.col("beer_beerid").cast("string")
    u = F.conv(F.substring(F.md5(F.concat_ws("|", seed, user)), 1, 8), 16, 10).cast("long")
    pick = F.min(F.struct(F.md5(F.concat_ws("|", seed, user, item)), F.col("beer_beerid")))["beer_beerid"]
    held = fr.groupBy("user_id").agg(pick.alias("held_item"))
    return fr.join(held, "user_id").select(
        "user_id", "beer_beerid", (u % 10000 < TRAIN_SHARE).alias("is_train"), (u % EVAL_FOLDS).cast("int").alias("fold"),
        (F.col("beer_beerid") == F.col("held_item")).alias("held_out"), (F.col("review_overall") >= GOOD_RATING).alias("is_good"), "review_overall")


# ------------------------------------------- model of all items, evaluation
LIST_LENGTHS = [1, 3, 5, 10, 15, 20]


def _r9(x: str) -> str:
    return f"floor({x} * 1e9::DOUBLE + 0.5) / 1e9::DOUBLE"


def _neighbours_sql(name: str, left: str, right: str, vec: str, key: str, run: bool = False) -> str:
    """CTE of `cosine_neighbours` by all pairs: tables of (run,) {vec}, {key}, z."""
    r, on = ("run, ", " AND a.run = b.run") if run else ("", "")
    return f"""
{name}_n AS (SELECT {r}{vec}, sqrt(sum(z * z)) AS n FROM {left} GROUP BY ALL),
{name}_m AS (SELECT {r}{vec}, sqrt(sum(z * z)) AS n FROM {right} GROUP BY ALL),
{name}_p AS (SELECT {"a.run, " if run else ""}a.{vec} AS id, b.{vec} AS other, sum((a.z / x.n) * (b.z / y.n)) AS dot
  FROM {left} a JOIN {right} b ON a.{key} = b.{key}{on} AND a.{vec} <> b.{vec}
  JOIN {name}_n x ON x.{vec} = a.{vec}{" AND x.run = a.run" if run else ""} JOIN {name}_m y ON y.{vec} = b.{vec}{" AND y.run = b.run" if run else ""}
  WHERE x.n > 0 AND y.n > 0 GROUP BY ALL),
{name} AS (SELECT {r}id, other, {_r9("dot")} AS sim FROM {name}_p WHERE {_r9("dot")} > 0
  QUALIFY row_number() OVER (PARTITION BY {r}id ORDER BY {_r9("dot")} DESC, other) <= {NN})"""


@query("item_neighbours", ["ratings"], Z_SQL + """,
zz AS (SELECT user_id, beer_beerid, z FROM z WHERE z IS NOT NULL),""" + _neighbours_sql("nb", "zz", "zz", "beer_beerid", "user_id") + """
SELECT id AS beer_beerid, other AS neighbour, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS INTEGER) AS position,
       sim FROM nb""")
def item_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """M3/M6: the 30 most similar beers of every beer (cosine of z-scored ratings over all raters): the model of an
    item-based recommender, by a join pruned with rare users and norms."""
    scratch = Scratch(spark, "ratings")
    m = _item_model(_z(kept_filtered(spark, d, scratch)))
    scratch.drop()
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return m.select(F.col("id").alias("beer_beerid"), F.col("other").alias("neighbour"), F.row_number().over(w).alias("position"), "sim")


def _z(r: DataFrame, by: list[str] = []) -> DataFrame:
    """by..., user_id, beer_beerid, z of users whose ratings differ."""
    st = r.groupBy(*by, "user_id").agg(F.avg("review_overall").alias("mu"), F.stddev_samp("review_overall").alias("sd"))
    return r.join(st.filter(F.col("sd") > 0), [*by, "user_id"]) \
        .select(*by, "user_id", "beer_beerid", ((F.col("review_overall") - F.col("mu")) / F.col("sd")).alias("z"))


def _item_model(z: DataFrame, by: list[str] = [], work: list | None = None, into: Scratch | None = None) -> DataFrame:
    v = unit_vectors(z, by, "beer_beerid", "user_id", "z")
    return cosine_neighbours(v, v, by, NN, work=work, into=into)


@query("ibcf_model_topn", ["ratings"], Z_SQL + """,
zz AS (SELECT user_id, beer_beerid, z FROM z WHERE z IS NOT NULL),""" + _neighbours_sql("nb", "zz", "zz", "beer_beerid", "user_id") + f""",
sc AS (SELECT t.user_id, nb.id AS beer_beerid, {_r9("sum(sim * t.z) / sum(sim)")} AS score
       FROM zz t JOIN nb ON nb.other = t.beer_beerid WHERE t.user_id IN (SELECT user_id FROM targets) GROUP BY ALL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, beer_beerid) AS INTEGER) AS position, beer_beerid, score
FROM sc WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.user_id = sc.user_id AND fr.beer_beerid = sc.beer_beerid)
QUALIFY position <= {TOP_N}""")
def ibcf_model_topn(spark: SparkSession, d: str) -> DataFrame:
    """M6/M7: top-5 unrated beers of the most active users from the model of all beers (30 neighbours each, as the
    item-based recommender keeps them), by score in units of the user's spread."""
    fr = kept_filtered(spark, d, Scratch(spark, "ratings"))     # the scores below read it
    z = _z(fr)
    t = targets(fr).select(F.col("user_id").alias("id"))
    own = fr.select(F.col("user_id").alias("id"), F.col("beer_beerid").alias("item")).join(t, "id", "left_semi")
    mine = z.select(F.col("user_id").alias("id"), F.col("beer_beerid").alias("item"), "z").join(t, "id", "left_semi")
    s = item_scores(_item_model(z), mine, []).join(own, ["id", "item"], "left_anti")
    top = top_k_per_group(s, ["id"], [F.desc("score"), F.asc("item")], TOP_N, "row_number", "position")
    return top.select(F.col("id").alias("user_id"), "position", F.col("item").alias("beer_beerid"), "score")


#: Ratings behind the scores of one pass over the test users, at least.
SCORED = 40_000_000


def _evaluated(fr: DataFrame, tested: Column, runs: list[int], scratch: Scratch) -> DataFrame:
    """algorithm, run and `held_out_ranks` of both recommenders.  tested: the run of `runs` that tests the users of a row of
    `_scheme`; it learns from all others.

    One run after the other, and what a run writes goes at its end; so several runs take the disk of one.  The z-scores
    of a user who is learnt from are the same in every run and are made once."""
    scheme = scratch.keep(_scheme(fr).select("user_id", "beer_beerid", "review_overall", "held_out", "is_good", tested.alias("tested")))
    z = scratch.keep(_z(fr).join(scheme.select("user_id", "tested").distinct(), "user_id"))
    ranks = [_run_ranks(scheme.filter(F.col("tested") == run), z.filter(F.col("tested") != run)).withColumn("run", F.lit(run)) for run in runs]
    return reduce(DataFrame.unionByName, ranks)


def _run_ranks(test: DataFrame, train: DataFrame) -> DataFrame:
    """algorithm and `held_out_ranks` of the users of test (rows of the scheme), in passes over these.  train: user_id,
    beer_beerid, z of the others."""
    scratch = Scratch(test.sparkSession, "run")
    known = test.filter("not held_out")
    mine = scratch.keep(_z(known))
    users = cosine_neighbours(unit_vectors(mine, [], "user_id", "beer_beerid", "z"),
                              unit_vectors(train, [], "user_id", "beer_beerid", "z"), [], NN, into=scratch)
    model = _item_model(train, into=scratch)
    rows = train.select(F.col("user_id").alias("other"), F.col("beer_beerid").alias("item"), "z")
    own = mine.select(F.col("user_id").alias("id"), F.col("beer_beerid").alias("item"), "z")
    algorithms = F.explode(F.array(F.lit("UBCF"), F.lit("IBCF"))).alias("algorithm")
    given = known.select(algorithms, F.col("user_id").alias("id"), F.col("beer_beerid").alias("item"))
    held = test.filter("held_out").select(algorithms, F.col("user_id").alias("id"), F.col("beer_beerid").alias("item"),
                                          F.col("is_good").alias("good"))

    scored = 2 * NN * own.count()                               # about the ratings that make the scores
    passes = max(1, math.ceil(scored / max(SCORED, rows.count())))
    buckets = max(8, math.ceil(scored / passes / 1_000_000))

    def ranks(dealt):
        of_users = user_scores(users.filter(dealt), rows, [], buckets, packed=True)
        of_items = item_scores(model, own.filter(dealt), [], buckets, packed=True)
        both = of_users.withColumn("algorithm", F.lit("UBCF")).unionByName(of_items.withColumn("algorithm", F.lit("IBCF")))
        return held_out_ranks(both, given.filter(dealt), held.filter(dealt), ["algorithm"], buckets)
    out = in_passes(ranks, ["id"], passes, test.sparkSession)
    scratch.drop()
    return out


def _eval_sql(runs: str, group: str) -> str:
    """Oracle of the evaluation: every similarity by all pairs, lists by window.  runs: FROM clause that gives sch."""
    return FR_SQL + f""",
h AS (SELECT *, CAST('0x' || substr(md5('{EVAL_SEED}|' || user_id), 1, 8) AS BIGINT) AS u,
             row_number() OVER (PARTITION BY user_id ORDER BY md5('{EVAL_SEED}|' || user_id || '|' || beer_beerid), beer_beerid) = 1 AS held
      FROM fr),
sch AS ({runs}),
zt AS (SELECT run, user_id, beer_beerid, (review_overall - mu) / sd AS z FROM sch JOIN
       (SELECT run, user_id, avg(review_overall) AS mu, stddev_samp(review_overall) AS sd FROM sch WHERE tr GROUP BY ALL) s USING (run, user_id)
       WHERE tr AND sd > 0),
zm AS (SELECT run, user_id, beer_beerid, (review_overall - mu) / sd AS z FROM sch JOIN
       (SELECT run, user_id, avg(review_overall) AS mu, stddev_samp(review_overall) AS sd FROM sch WHERE NOT tr AND NOT held GROUP BY ALL) s
       USING (run, user_id) WHERE NOT tr AND NOT held AND sd > 0),""" + \
        _neighbours_sql("un", "zm", "zt", "user_id", "beer_beerid", True) + "," + \
        _neighbours_sql("im", "zt", "zt", "beer_beerid", "user_id", True) + f""",
us AS (SELECT run, id, beer_beerid AS item, {_r9("s / w")} AS score FROM
       (SELECT un.run, id, beer_beerid, sum(sim * z) AS s FROM un JOIN zt ON zt.run = un.run AND zt.user_id = un.other GROUP BY ALL) a
       JOIN (SELECT run, id, sum(sim) AS w FROM un GROUP BY ALL) b USING (run, id)),
its AS (SELECT zm.run, zm.user_id AS id, im.id AS item, {_r9("sum(sim * z) / sum(sim)")} AS score
        FROM zm JOIN im ON im.run = zm.run AND im.other = zm.beer_beerid GROUP BY ALL),
sc AS (SELECT 'UBCF' AS algorithm, * FROM us UNION ALL SELECT 'IBCF', * FROM its),
new AS (SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM sch WHERE sch.run = sc.run AND sch.user_id = sc.id AND sch.beer_beerid = sc.item
                                           AND NOT sch.held)),
pos AS (SELECT *, row_number() OVER (PARTITION BY algorithm, run, id ORDER BY score DESC, item) AS rank,
               count(*) OVER (PARTITION BY algorithm, run, id) AS scored FROM new),
te AS (SELECT run, user_id AS id, max(beer_beerid) FILTER (WHERE held) AS item, bool_or(held AND review_overall >= {GOOD_RATING}) AS good,
              count(*) FILTER (WHERE NOT held) AS given FROM sch WHERE NOT tr GROUP BY ALL),
al AS (SELECT te.*, a.algorithm, p.rank, coalesce(c.scored, 0) AS scored FROM te CROSS JOIN (VALUES ('UBCF'), ('IBCF')) a(algorithm)
       LEFT JOIN pos p ON p.algorithm = a.algorithm AND p.run = te.run AND p.id = te.id AND p.item = te.item
       LEFT JOIN (SELECT algorithm, run, id, max(scored) AS scored FROM pos GROUP BY ALL) c
         ON c.algorithm = a.algorithm AND c.run = te.run AND c.id = te.id),
en AS (SELECT *, coalesce(CAST(good AND rank <= n AS BIGINT), 0) AS hit, least(n, scored) AS listed
       FROM al, (VALUES {", ".join(f"({n})" for n in LIST_LENGTHS)}) l(n)),
t AS (SELECT {group}, CAST(n AS INTEGER) AS n, count(*) AS users, CAST(sum(hit) AS BIGINT) AS tp, CAST(sum(listed - hit) AS BIGINT) AS fp,
             CAST(sum(good::INT - hit) AS BIGINT) AS fn,
             CAST(sum((SELECT count(DISTINCT beer_beerid) FROM fr) - given - listed - (good::INT - hit)) AS BIGINT) AS tn FROM en GROUP BY ALL)
SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS tpr, fp / nullif(fp + tn, 0)::DOUBLE AS fpr FROM t"""


@query("topn_eval", ["ratings"], _eval_sql(f"SELECT 0 AS run, *, u % 10000 < {TRAIN_SHARE} AS tr FROM h", "algorithm"))
def topn_eval(spark: SparkSession, d: str) -> DataFrame:
    """True and false positives, TPR and FPR of lists of 1 to 20 beers, user- and item-based, over all
    test users of the 80/20 split, one rating held out of each.  The held-out beer's rank is counted; no lists."""
    scratch = Scratch(spark, "ratings")
    fr = kept_filtered(spark, d, scratch)
    items = fr.agg(F.count_distinct("beer_beerid")).first()[0]
    ranks = _evaluated(fr, F.when(F.col("is_train"), -1).otherwise(0), [0], scratch)
    scratch.drop()
    return topn_table(ranks, items, LIST_LENGTHS, ["algorithm"])


@query("topn_eval_cv", ["ratings"], _eval_sql(
    f"SELECT CAST(run AS INTEGER) AS run, h.*, u % {EVAL_FOLDS} <> run AS tr FROM h, range({EVAL_FOLDS}) r(run)", "algorithm, run"))
def topn_eval_cv(spark: SparkSession, d: str) -> DataFrame:
    """The same table for every fold of the 5-fold scheme (each fold's users tested, the others learnt from)."""
    scratch = Scratch(spark, "ratings")
    fr = kept_filtered(spark, d, scratch)
    items = fr.agg(F.count_distinct("beer_beerid")).first()[0]
    ranks = _evaluated(fr, F.col("fold"), list(range(EVAL_FOLDS)), scratch)
    scratch.drop()
    return topn_table(ranks, items, LIST_LENGTHS, ["algorithm", "run"])
