"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the stage before kept. All but the last return the
columns of ``documents``: toxic documents go, one document of each group of near
duplicates stays, documents that hold benchmark passages go, secrets are masked
in place, and the last stage packs what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.llm.common import documents, materialize
from toolweave.llm.decontaminate import drop_contaminated
from toolweave.llm.neardup import drop_near_duplicates
from toolweave.llm.packing import pack_documents
from toolweave.llm.secrets import redact_secrets
from toolweave.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; null and empty texts stay; without labels of both kinds all stay."""
    return drop_toxic(docs, train_toxicity(docs, documents(spark, sf_dir, "labels"), F.lit(True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: SimHash trie join, five-word shingles, similarity of 0.8 or more."""
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a segment of a benchmark item go; null and empty texts stay; without items all stay."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, secrets masked and n_chars brought up to date; a null text stays null."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece and its place; a null or empty text is the end id alone; rows that repeat are packed as often."""
    return pack_documents(docs, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Trained scores and tokenised packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and read again; an empty table runs through and gives no rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
