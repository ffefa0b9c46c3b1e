"""Corpus pipeline: quality filter, exact dedup, near dedup, secret removal, packing.

Every stage works on all rows that the one before kept, and returns the columns of
``documents``, but for the last, which returns the packed pieces.  SQL cannot express
the classifier, the forest and the packing, so there is no oracle; the tests compare
the stages with brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm.common import documents, written
from tablecheck.llm.exact_dedup import drop_exact_copies
from tablecheck.llm.jaccard import jaccard_components
from tablecheck.llm.packing import pack_documents
from tablecheck.llm.quality import fit_quality, keep_by_quality
from tablecheck.llm.queries import QUALITY_THRESHOLD, tokenizer_file
from tablecheck.llm.secrets import redact_secrets

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above."""
    model = fit_quality(docs, documents(spark, sf_dir, "labels"))
    return keep_by_quality(docs, model, QUALITY_THRESHOLD)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return drop_exact_copies(docs).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each near-duplicate component."""
    kept = jaccard_components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), 1024, end_id=2)


STAGES = [("quality classifier", good_quality), ("exact dedup", without_copies),
          ("n-gram Jaccard join", without_near_copies), ("secret scan", without_secrets),
          ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline {name}".replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
