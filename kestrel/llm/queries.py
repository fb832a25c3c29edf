"""The queries of this subpackage: one per operator, over whole tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import (
    ann, decontaminate, embeddings, html, infill, langid, linededup, mixing, periodic, quality, simhash,
    toxicity, warc,
)
from kestrel.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from folds 0 and 2 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 3).isin(0, 2))
    return langid.predict(docs, model).withColumn("held_out", fold("doc_id", 3) == 1) \
        .select("doc_id", "held_out", "lang_pred", "score", "code_bits")


_LINE_DEDUP_SQL = r"""
with l as (
  select doc_id, u.i, u.line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)),
                                             lambda x, i: {'i': i, 'line': x})) as u from documents)),
c as (
  select k, max(doc_id) as last from l where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
j as (select l.*, c.last is not null and c.last <> doc_id as dropped from l left join c on l.k = c.k)
select doc_id, count(*) as n_lines, sum(dropped::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from j group by doc_id
"""


@query("op2_line_dedup", _LINE_DEDUP_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated in three or more documents stay in the last of them only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                              F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op3_mixing", mixing.oracle_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of 150 % of all words at weights 5, 2, 1."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op4_decontamination", decontaminate.oracle_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its containment."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from positive and unlabelled rows of folds 1 to 4 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) > 0)
    return toxicity.with_score(docs, model).withColumn("held_out", fold("doc_id", 5) == 0) \
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels of folds 1 to 4 of 5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) > 0)
    return quality.with_score(docs, model).withColumn("held_out", fold("doc_id", 5) == 0) \
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every document and the smallest document reachable over links of up to 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_embedding_neardup", embeddings.oracle_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels and cosine of at least 0.98."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_html_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_text(table(spark, sf_dir, "pages"))


@query("op10_warc", warc.ORACLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one in ten with a repeated tail, and digests of all runs and the text without them."""
    docs = periodic.repeat_tail(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic.with_runs(docs).select("doc_id", "periodic.*").withColumn("top", periodic.longest(F.col("runs")))

    def digest(c):
        return F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
                      F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
                      digest(periodic.listing(F.col("runs"))).alias("runs_sha256"),
                      digest(F.col("collapsed")).alias("collapsed_sha256"))


@query("op12_nearest_neighbours")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


@query("op13_fill_in_middle", infill.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-the-middle form of every document, and its text rebuilt from the form."""
    docs = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 output="output", form="form", units="n")
    prefix, middle, _ = infill.parts("output", "form")

    def digest(c):
        return F.sha2(c.cast("binary"), 256)
    return docs.select("doc_id", "n", "form", F.length(prefix).cast("long").alias("prefix_chars"),
                       F.length(middle).cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"),
                       digest(infill.restored("output", "form")).alias("restored_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
