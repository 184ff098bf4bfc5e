"""From category scores to the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.operators.catalog import TAXONOMY
from toolweave.operators.metrics import percent

# Weights of the summary.
WEIGHTS = {"special": 0.2676, "normal": 0.578, "agent": 0.1545}
NORMAL = [c for g in ("single_turn", "multi_turn", "atom", "similar_api", "preference") for c in TAXONOMY[g]]
ROLLUPS = {"special": TAXONOMY["special"], "normal": NORMAL, "agent": TAXONOMY["agent"], "atom": TAXONOMY["atom"], "single_turn": TAXONOMY["single_turn"], "multi_turn": TAXONOMY["multi_turn"]}


def rollup(categories: list[str]) -> Column:
    """Mean over the categories' columns, a missing one as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in categories), F.lit(0.0)) / len(categories)


def weighted_summary(parts: dict[str, Column]) -> Column:
    return sum((parts[g] * w for g, w in WEIGHTS.items()), F.lit(0.0))


def leaderboard(scores: DataFrame, closed_models: list[str] | None = None) -> DataFrame:
    """(model, categories..., rollups..., summary, summary_pct), closed models first, each part by the rounded summary."""
    every = [c for cs in TAXONOMY.values() for c in cs]
    wide = scores.groupBy("model").pivot("category", every).agg(F.max("accuracy"))
    out = wide.select("model", *every, *[rollup(cs).alias(f"{g}_mean") for g, cs in ROLLUPS.items()])
    out = out.withColumn("summary", weighted_summary({g: F.col(f"{g}_mean") for g in WEIGHTS}))
    out = out.withColumn("is_closed", F.col("model").isin(closed_models or [""])).withColumn("summary_pct", percent(F.col("summary")))
    return out.orderBy(F.desc("is_closed"), F.desc(F.round("summary", 4)), "model")


def failures(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Failed rows with their cases, joined by id."""
    return results.filter(~F.col("valid")).join(cases, "id")
