"""A corpus pipeline: quality rules, exact dedup, near dedup, secret redaction and packing of `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rangelake.llm.common import folder, remove, table
from rangelake.llm.exact_dedup import drop_exact_duplicates
from rangelake.llm.minhash import drop_near_duplicates
from rangelake.llm.packing import pack_documents
from rangelake.llm.quality_rules import fit_quality_rules, quality_rules
from rangelake.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go; the trees are fitted on `labels`."""
    model = fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules(docs, model).filter("kept").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, and one row of those that repeat it."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: five-word shingles, a similarity of 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars follows."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of sequences: a piece each."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("secret scans", secrets), ("best-fit packing", packing)]

#: Trees and token packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.

    What each stage keeps is written to the folder of spark.checkpoint.dir and read again; it goes when the
    next stage is done, and the last one's rows go when the session ends.
    """
    at = folder(spark, "corpus_pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        remove(spark, f"{at}/{k - 1}")
    return docs
