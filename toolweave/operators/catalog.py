"""Function catalogues: building, name resolution, qrels, resume filters, taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.operators.order import dense_index

# The category taxonomy, group to categories.
TAXONOMY = {
    "special": ["special_incomplete", "special_error_param", "special_irrelevant"],
    "single_turn": ["normal_single_turn_single_function", "normal_single_turn_parallel_function"],
    "multi_turn": ["normal_multi_turn_user_adjust", "normal_multi_turn_user_switch"],
    "atom": ["normal_atom_bool", "normal_atom_enum", "normal_atom_number", "normal_atom_list", "normal_atom_object_short", "normal_atom_object_deep"],
    "similar_api": ["normal_similar_api"],
    "preference": ["normal_preference"],
    "agent": ["agent_multi_turn", "agent_multi_step"],
}


def build_catalog(rows: DataFrame, key: list[str], order: list[str], body: str) -> DataFrame:
    """(key, docid, body): one entry per key at its first position with its last body; docids are dense from 0."""
    at = F.struct(*order)
    once = rows.groupBy(*key).agg(F.min(at).alias("__first"), F.max_by(body, at).alias(body))
    return dense_index(once, ["__first"], "docid").select(*key, "docid", body)


def resolve_by_suffix(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(gt, docid): the exact entry, else the first whose last dotted part is ``gt``, else null."""
    exact = catalog.groupBy(F.col("name").alias("gt")).agg(F.min("docid").alias("exact"))
    suffix = catalog.filter(F.col("name").contains(".")).groupBy(F.element_at(F.split("name", r"\."), -1).alias("gt")).agg(F.min("docid").alias("suffix"))
    return names.select("gt").distinct().join(exact, "gt", "left").join(suffix, "gt", "left").select("gt", F.coalesce("exact", "suffix").alias("docid"))


def resolve_by_prefix(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(gt, docid): the first entry that equals ``gt`` or whose last dotted part does, either taken whole, without a
    trailing number, or up to its first underscore; null if none. A union of equi joins, no theta join.
    """
    gt = names.select("gt").distinct()
    forms = gt.select("gt", F.explode(F.array(F.struct(F.lit(0).alias("step"), F.col("gt").alias("form")), F.struct(F.lit(1).alias("step"), F.regexp_replace("gt", r"_\d+$", "").alias("form")), F.struct(F.lit(2).alias("step"), F.substring_index("gt", "_", 1).alias("form")))).alias("f")).select("gt", "f.*").filter("form <> ''")
    entry = catalog.select("docid", F.explode(F.array_distinct(F.array(F.col("name"), F.element_at(F.split("name", r"\."), -1)))).alias("form"))
    first = entry.groupBy("form").agg(F.min("docid").alias("docid"))
    # whole names and prefixes compete by position in the catalogue; the stripped form ranks before the prefix
    whole = forms.join(first, "form").groupBy("gt").agg(F.min(F.when(F.col("step") < 2, F.col("docid"))).alias("near"), F.min("docid").alias("any"))
    return gt.join(whole, "gt", "left").select("gt", F.coalesce(F.col("near"), F.col("any")).alias("docid"))


def qrels(judgements: DataFrame, query: str, doc: str, relevant: str) -> DataFrame:
    """(qid, head, docid, tail): one row per distinct relevant pair, with the format's constants."""
    pairs = judgements.filter(F.col(relevant) == 1).select(F.col(query).alias("qid"), F.col(doc).alias("docid")).distinct()
    return pairs.select("qid", F.lit(0).alias("head"), "docid", F.lit(1).alias("tail"))


def remaining(cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cases whose key is not among the finished ones."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(g, c) for g, cs in TAXONOMY.items() for c in cs]
    rows += [("test_all", c) for cs in TAXONOMY.values() for c in cs]
    rows += [("normal", c) for g in ("single_turn", "multi_turn", "atom", "similar_api", "preference") for c in TAXONOMY[g]]
    return spark.createDataFrame(rows, "group_name string, category string")


def expand_categories(names: DataFrame) -> DataFrame:
    """(name, category): a group's categories; an unknown name stands for itself."""
    groups = taxonomy(names.sparkSession)
    return names.join(F.broadcast(groups), names["name"] == groups["group_name"], "left").select("name", F.coalesce("category", "name").alias("category"))


def category_of(column: str):
    """Category of a result id: without its last part, or its last two for multi-turn ids."""
    c = F.col(column)
    multi = c.contains("normal_multi_turn")
    return F.when(multi, F.regexp_replace(c, r"(_[^_]*){2}$", "")).otherwise(F.regexp_replace(c, r"_[^_]*$", ""))
