"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept and returns a DataFrame; `run` writes each stage's result as Parquet in
the shared folder of `spark.checkpoint.dir` and reads it again as the next
one's docs, so a lost executor costs at most the stage at hand.  All stages
but the last return the columns of documents; `mixing` adds `round`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import decontaminate, linededup, mixing, quality, simhash
from kestrel.llm.common import col, fold, fresh, scratch_path, table

#: Documents below this probability of good quality are rejected.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is below LEAST_QUALITY; labels of folds 1 to 4 of 5 are learnt."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) > 0)
    s = fresh(docs, "score")
    return quality.with_score(docs, model, name=s).filter(F.col(s) >= LEAST_QUALITY).drop(s)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops long lines that three or more documents share from all but the last; n_chars follows the text.

    A text may become empty; its document goes on.
    """
    a, b = fresh(docs, "lines"), fresh(docs, "dropped")
    out = linededup.dedup_lines(docs, n_lines=a, n_dropped=b).drop(a, b)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(col("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[col(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every SimHash component (4-word shingles, 4 bits)."""
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item (0.8 of its 5-word shingles)."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and round in which the mix serves it (weights 5, 2, 1; 150 % of the words)."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: The quality and SimHash stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is the last stage's, read from its Parquet."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
