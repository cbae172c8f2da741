"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Works on the table ``documents`` and counts as part of the subpackage ``moneytrail.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moneytrail.llm.common import table
from moneytrail.llm.line_dedup import without_repeated_lines
from moneytrail.llm.minhash import without_near_duplicates
from moneytrail.llm.mixing import mixed_documents
from moneytrail.llm.packing import pack, tokenizer_definition
from moneytrail.llm.quality import keep_good, train_classifier
from moneytrail.session import materialize, tune


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels`` and these documents."""
    return keep_good(docs, train_classifier(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in the one with the largest id only."""
    return without_repeated_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one per source may be cut."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return pack(docs, tokenizer_definition())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# SQL has no classifier and no tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns lies in the scratch folder until the end."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
