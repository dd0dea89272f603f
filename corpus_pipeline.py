"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import decontaminate, mixing, nearcopies, quality, secrets
from meshwork.llm.common import table
from meshwork.plans.scratch import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the standard policy."""
    led = quality.with_ledger(docs)
    return led.where(quality.passes(quality.STANDARD, F.col(led.columns[-1])["fail_bits"])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by sets of five-word shingles of Jaccard similarity 0.8 or more.

    SimHash links at four bits give the first candidates; near copies that lie further apart than that are
    found by their rarest shingles. Whole sets decide.
    """
    return nearcopies.one_of_each(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew where the text changed."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.contains("text", F.lit("[secret]")), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate; ``copy`` counts a document's copies from 0."""
    return mixing.emit(docs, null_keys_by_text=True)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
]

#: Token efficiency has no form in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
