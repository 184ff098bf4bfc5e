"""Evaluation of recorded model outputs: from results and answers to scores and failures.

Inputs are tables, joined by id: ``cases`` (id, functions_json), ``results``
(id, result) and ``answers`` (id, alternatives as JSON list of lists of calls
``{name: arguments}``). A case without a result counts as unreadable output; a
result without a case is reported by ``unmatched``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.functions.calls import CALLS, as_json, decode_output
from toolweave.functions.checker import check_calls, check_states
from toolweave.functions.text import classify_special, without_white_space
from toolweave.operators import metrics
from toolweave.operators.catalog import category_of

# The phrases that answers to special cases must hold.
SPECIAL_PHRASES = {"incomplete": "Missing necessary parameters", "error_param": "There is incorrect value", "irrelevant": "the limitations of the function"}


def alternatives_of(ground_truth: str) -> list[list[tuple[str, dict]]]:
    """A golden answer as alternatives: an object of calls, or a list of such objects; key order is kept."""
    read = json.loads(ground_truth)
    return [list(a.items()) for a in (read if isinstance(read, list) else [read])]


@F.pandas_udf(T.ArrayType(CALLS))
def read_answers(texts: pd.Series) -> pd.Series:
    """Golden JSON as arrays of calls; null where it can't be read."""

    def one(text):
        try:
            return None if text is None else [[{"func": f, "args_json": as_json(a)} for f, a in alt] for alt in alternatives_of(text)]
        except (ValueError, AttributeError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def unmatched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids of either side that the other lacks."""
    miss = lambda a, b, side: a.select("id").join(b, "id", "left_anti").withColumn("only_in", F.lit(side))
    return miss(left, right, "left").unionAll(miss(right, left, "right"))


def evaluate_calls(cases: DataFrame, results: DataFrame, answers: DataFrame, model: str = "", strict: bool = False) -> DataFrame:
    """(id, category, valid, error_type, result): each case's calls against its alternative answers."""
    rows = cases.join(answers, "id").join(results, "id", "left")
    decoded = decode_output(without_white_space(F.col("result")), F.lit(model))
    verdict = check_calls(F.col("functions_json"), decoded, read_answers(F.col("ground_truth")), strict, category_of("id"))
    return rows.withColumn("verdict", verdict).select("id", category_of("id").alias("category"), "verdict.valid", "verdict.error_type", "result")


def single_turn_scores(checked: DataFrame) -> DataFrame:
    """(category, accuracy, correct_count, total_count); the accuracy is rounded to five."""
    right = F.col("valid").cast("int")
    return checked.groupBy("category").agg(F.round(F.avg(right.cast("double")), 5).alias("accuracy"), F.sum(right).alias("correct_count"), F.count("*").alias("total_count"))


def multi_turn_scores(checked: DataFrame) -> DataFrame:
    """Session accuracy and process per category; session and turn are the last two parts of the id."""
    parts = F.split("id", "_")
    rows = checked.withColumn("session", F.element_at(parts, -2))
    return metrics.session_accuracy(rows, ["session"], ["category"])


def run_scores(checked: DataFrame) -> DataFrame:
    """As ``multi_turn_scores``, but a session is a run of equal session numbers in result order (``ordinal``)."""
    rows = metrics.islands(checked.withColumn("session", F.element_at(F.split("id", "_"), -2)), "category", ["ordinal"], "session")
    return metrics.session_accuracy(rows, ["island"], ["category"])


def evaluate_special(results: DataFrame, answers: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """(id, kind, valid, error_type) of special cases from ``answers`` (id, kind, name, values)."""
    rows = answers.join(results, "id", "left")
    error = classify_special(F.coalesce("result", F.lit("")), F.col("kind"), phrases or SPECIAL_PHRASES, F.col("name"), F.transform("values", lambda v: F.trim(v)))
    return rows.select("id", "kind", error.isNull().alias("valid"), error.alias("error_type"))


def evaluate_agents(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, valid, process): final states, and the best milestone share over alternatives; a right end state has share 1.

    ``results`` (id, state_json, process) and ``answers`` (id, state_json, milestones: array of arrays).
    """
    rows = answers.select("id", F.col("state_json").alias("want"), "milestones").join(results, "id", "left")
    rows = rows.withColumn("valid", F.coalesce(check_states(F.col("state_json"), F.col("want")), F.lit(False)))
    trace = F.coalesce("process", F.array().cast("array<string>"))
    best = F.array_max(F.transform("milestones", lambda stones: metrics.milestone_share(trace, stones)))
    return rows.select("id", "valid", F.when(F.col("valid"), 1.0).otherwise(F.coalesce(best, F.lit(1.0))).alias("process"))


def agent_scores(checked: DataFrame) -> DataFrame:
    return checked.groupBy(category_of("id").alias("category")).agg(F.round(F.avg(F.col("valid").cast("int").cast("double")), 5).alias("accuracy"), F.round(F.avg("process"), 5).alias("process_accuracy"), F.count("*").alias("total_count"))


def special_answers(golden: DataFrame) -> DataFrame:
    """(id, kind, name, values) per function or parameter of the golden answers (id, category, ground_truth) of special cases."""
    kind = F.when(F.col("category").contains("incomplete"), "incomplete").when(F.col("category").contains("error"), "error_param").otherwise("irrelevant")
    named = golden.withColumn("kind", kind).filter("kind <> 'irrelevant'").select("id", "kind", F.explode(F.from_json("ground_truth", "map<string,array<string>>")).alias("name", "values"))
    plain = golden.withColumn("kind", kind).filter("kind = 'irrelevant'").select("id", "kind", F.lit("").alias("name"), F.array().cast("array<string>").alias("values"))
    return named.unionAll(plain)


def checked_special(golden: DataFrame, results: DataFrame) -> DataFrame:
    """(id, category, valid, error_type, result) of special cases; all that a golden answer names must be right."""
    parts = evaluate_special(results.select("id", "result"), special_answers(golden)).groupBy("id").agg(F.bool_and("valid").alias("valid"), F.max("error_type").alias("error_type"))
    return golden.select("id", "category").join(parts, "id", "left").join(results.select("id", "result"), "id", "left").select("id", "category", F.coalesce("valid", F.lit(True)).alias("valid"), "error_type", "result")


def merged_states(states: Column) -> Column:
    """A list of objects of classes, or one such object, as one JSON object; of a class that repeats the last counts."""
    listed = F.when(F.ltrim(states).startswith("["), states).otherwise(F.concat(F.lit("["), states, F.lit("]")))
    pairs = F.flatten(F.transform(F.from_json(listed, "array<map<string,string>>"), F.map_entries))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda p: F.concat(F.lit('"'), p["key"], F.lit('": '), p["value"])), ", "), F.lit("}"))


def checked_agents(golden: DataFrame, results: DataFrame) -> DataFrame:
    """(id, category, valid, process, error_type, result) of agent cases: ``golden`` (id, category, ground_truth, mile_stone), ``results`` (id, result, process)."""
    nested = F.from_json("mile_stone", "array<array<string>>")
    flat = F.from_json("mile_stone", "array<string>")
    stones = F.when(F.regexp_like("mile_stone", F.lit(r"^\s*\[\s*\[")), nested).otherwise(F.array(flat))
    want = golden.select("id", merged_states(F.col("ground_truth")).alias("state_json"), F.coalesce(stones, F.array(F.array().cast("array<string>"))).alias("milestones"))
    have = results.select("id", merged_states(F.col("result")).alias("state_json"), F.from_json("process", "array<string>").alias("process"))
    error = F.when(~F.col("valid"), "wrong_end_state")
    return golden.select("id", "category").join(evaluate_agents(have, want), "id").join(results.select("id", "result"), "id", "left").select("id", "category", "valid", "process", error.alias("error_type"), "result")


def failed_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col("valid"))


def case_table(cases: DataFrame, answers: DataFrame, checked: DataFrame) -> DataFrame:
    """One row per case for reading: case, golden answer, result and error, joined by id; results are optional."""
    return cases.join(answers, "id", "left").join(checked.select("id", "valid", "error_type", "result"), "id", "left")
