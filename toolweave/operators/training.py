"""Supervised tool-call data: explode, candidate strings, difference, filtering."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.functions.calls import NotReadable, decode, same_calls
from toolweave.functions.checker import TYPES, Enumerated
from toolweave.operators.prompts import between_tags

FUNCTIONS = "array<struct<name:string,description:string>>"


def read_functions(rows: DataFrame, marker: str, system: str = "system") -> DataFrame:
    """Rows whose system text ends, after the marker, in a JSON list; with it as ``functions_json``."""
    text = F.substring_index(F.col(system), marker, -1)
    return rows.withColumn("functions_json", text).filter(F.col(system).contains(marker) & F.try_parse_json("functions_json").isNotNull())


def single_functions(rows: DataFrame) -> DataFrame:
    """Each function of a row becomes a row: ``function_at`` and ``function_json``."""
    bodies = F.from_json("functions_json", "array<string>")
    return rows.select("*", F.posexplode(bodies).alias("function_at", "function_json"))


def candidate_string(calls: Column) -> Column:
    """The calls with arguments, each without its outer brackets, as one bracketed list."""
    bare = F.transform(calls, lambda c: F.regexp_replace(F.trim(c), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(F.filter(bare, lambda c: F.contains(c, F.lit("="))), ", "), F.lit("]"))


def valid_functions(functions: Column, names: Column) -> Column:
    """Functions whose name is among the valid calls' names."""
    return F.filter(functions, lambda f: F.array_contains(names, f["name"]))


def difference(pred: str, answer: str, functions: list[dict]) -> dict | None:
    """Missing and redundant functions; per shared function missing, redundant, wrong-valued and wrong-typed parameters.

    None if either text or a parameter's declaration can't be read.
    """
    try:
        a, b = dict(decode(pred)), dict(decode(answer))
    except NotReadable:
        return None
    out: dict = {"redundant": sorted(a.keys() - b.keys()), "missing": sorted(b.keys() - a.keys()), "params": {}}
    known = {f["name"]: ((f.get("parameters") or f.get("arguments") or {}).get("properties") or {}) for f in functions}
    for name in sorted(a.keys() & b.keys()):
        got, want = a[name], b[name]
        if name not in known or any(p not in known[name] for p in got):
            return None
        kinds = {p: TYPES.get(str(known[name][p].get("type"))) for p in got}
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        part = {
            "redundant": sorted(got.keys() - want.keys()),
            "missing": sorted(want.keys() - got.keys()),
            "value": sorted(p for p in got.keys() & want.keys() if number(got[p]) and number(want[p]) and got[p] != want[p]),
            "type": sorted(p for p, t in kinds.items() if t not in (None, Enumerated) and type(got[p]) is not t and not (t is float and type(got[p]) is int)),
        }
        if any(part.values()):
            out["params"][name] = part
    return out


@F.pandas_udf(T.StringType())
def reflection(preds: pd.Series, answers: pd.Series, functions: pd.Series) -> pd.Series:
    """The difference as JSON; null where it can't be told."""
    read = {f: json.loads(f) for f in set(functions) if f is not None}
    rows = [difference(p, a, read[f]) if None not in (p, a, f) else None for p, a, f in zip(preds, answers, functions, strict=True)]
    return pd.Series([None if r is None else json.dumps(r) for r in rows], dtype=object)


@F.pandas_udf(T.BooleanType())
def calls_equal(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and same_calls(x, y) for x, y in zip(a, b, strict=True)])


def split_correct(rows: DataFrame, pred: str, answer: str, tag: str = "tool_call", thought: str = "reflection") -> DataFrame:
    """``rows`` with ``correct``: tags are there and the tagged call equals the answer."""
    call = between_tags(F.col(pred), tag)
    has = (call != "") & (between_tags(F.col(pred), thought) != "")
    return rows.withColumn("correct", has & calls_equal(call, F.col(answer)))
