"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir); all but the last give back the columns of documents, the last says how many words the
mix takes from each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklake.llm.decontaminate import drop_contaminated
from risklake.llm.line_dedup import dedup_lines
from risklake.llm.mixing import mix
from risklake.llm.near_dup import near_keep
from risklake.llm.quality import fit_field, quality_keep
from risklake.session import materialise, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line field is fitted on the labelled rows of this input."""
    return quality_keep(docs.select(*COLUMNS), fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that an earlier document or line has; ``n_chars`` follows the text."""
    out = dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: documents are linked by SimHash (op1: 2 or fewer of 64 bits differ) or by a 5-word Jaccard similarity of 0.8 or more."""
    return near_keep(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i}")
    return docs
