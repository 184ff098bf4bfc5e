"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.llm.common import documents, fold
from toolweave.llm.decontaminate import benchmark_matches
from toolweave.llm.htmltext import extract_text, train_weights
from toolweave.llm.jaccard import jaccard_components
from toolweave.llm.langid import identify_language, train_language
from toolweave.llm.lattice import score_documents
from toolweave.llm.media import media_digest
from toolweave.llm.packing import pack_documents
from toolweave.llm.prefixtrie import conversation_trie
from toolweave.llm.queries_sql import JACCARD_SQL, TRIE_SQL
from toolweave.llm.repeats import repeated_passages
from toolweave.llm.secrets import secret_digest
from toolweave.llm.simhash import fingerprint_text, simhash_components
from toolweave.llm.toxicity import score_toxicity, train_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per document; null and empty texts score 0, repeated rows alike, an empty table gives none; without labels of both kinds all score 0."""
    docs = documents(spark, sf_dir)
    model = train_toxicity(docs, documents(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row and benchmark item of which it holds a segment; null and empty texts hold none; no items or no documents give none."""
    return benchmark_matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per passage of 50 words or more that another document has too, with its first copy; null, short and empty texts and rows without an id have none."""
    return repeated_passages(documents(spark, sf_dir), length=50)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null and empty texts are the end symbol alone; without training documents every count is 0; an empty table gives none."""
    out = score_documents(documents(spark, sf_dir), fold("doc_id", 7) != 2)
    return out.withColumn("held_out", fold("doc_id", 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page row; null and empty pages have an empty text; without a page to learn from the fixed weights hold."""
    pages = documents(spark, sf_dir, "pages")
    return extract_text(pages, weights=train_weights(pages))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null, empty and blank texts have fingerprint zero and link; a row without an id takes its component from the others."""
    out = simhash_components(documents(spark, sf_dir), shingle=3, budget=2)
    return out.select("doc_id", fingerprint_text("fp").alias("fingerprint"), "component_id")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null and empty texts are one frame of zero bytes; equal texts give equal values."""
    return media_digest(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece; null and empty texts are the end id alone; repeated rows are packed as often; an empty table gives none."""
    return pack_documents(documents(spark, sf_dir), capacity=2048)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null and empty texts have no spans and the digest of the empty text; repeated rows alike."""
    return secret_digest(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; und with score 0 for null and for texts without a letter; equal scores go to the first language by name."""
    docs = documents(spark, sf_dir)
    model = train_language(docs, fold("doc_id", 3) != 1)
    out = identify_language(docs, model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.col("accepted"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document row; null, empty and blank texts have an empty set and link with nothing, very long texts count whole, repeated rows alike; an empty table gives none."""
    return jaccard_components(documents(spark, sf_dir), shingle=4, percent=85)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per node; null roles and texts are empty, null turns come first, rows without a conversation id are left out; an empty table has no node."""
    return conversation_trie(documents(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_html_extraction": op5_html_extraction,
        "op6_simhash": op6_simhash,
        "op7_media_columns": op7_media_columns,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_secret_scan": op9_secret_scan,
        "op10_language_id": op10_language_id,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_prefix_trie": op12_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_jaccard_join": JACCARD_SQL, "op12_prefix_trie": TRIE_SQL}
