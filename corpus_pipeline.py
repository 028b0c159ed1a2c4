"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

Quality classifier (rejected documents go), line dedup (repeated passages go), MinHash near-dedup (one document
of each group stays), secret scans (credentials that are not widely copied examples are masked), packing.

Defined cases: a null or empty text is rejected by the first stage; rows that repeat a doc_id leave one row after
near-dedup (of several texts under one id, one that is kept); a row without an id stays on its own; ties go to the
smallest doc_id; texts of any length go through whole, and a long one is packed in pieces; extra columns stay up to
the packing, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import line_dedup, near_dup, quality, secret_scan
from corpusloom.llm.common import materialise
from corpusloom.llm.queries import packed, secrets


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` again, after a stage that changes texts."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(line_dedup.dedup_lines(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secret_scan.redact(docs, secrets(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scorer, near-duplicate components and tokens have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None
