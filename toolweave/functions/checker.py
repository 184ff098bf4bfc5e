"""Typed checking of decoded calls against golden answers.

``check_calls`` follows a fixed order of tests and reports the first that fails.
By default numbers, booleans and enums are checked for type alone, as in the
scores that the results are compared with; ``strict`` compares them too.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



class Enumerated:
    """The type of a declared enum, which no value has."""


# Declared types and the value types they accept; declared types whose elements have a type too.
TYPES: dict[str, type] = {"string": str, "integer": int, "int": int, "number": int, "float": float, "boolean": bool, "array": list, "tuple": list, "list": list, "list(string)": list, "list(enum)": list, "dict": dict, "object": dict, "objectArray": list, "enum": Enumerated, "any": str}
NESTED = {"array", "tuple", "list(string)", "list(enum)", "object", "objectArray"}
IGNORED = re.compile(r"[ ,./\-_*^]")
VERDICT = T.StructType().add("valid", T.BooleanType()).add("error_type", T.StringType())

Call = tuple[str, dict[str, Any]]


@dataclass(frozen=True)
class Verdict:
    valid: bool
    error: str | None = None


OK = Verdict(True)


def plain(text: str) -> str:
    return IGNORED.sub("", text).lower().replace("'", '"')


def _plain(value: Any) -> Any:
    return plain(value) if isinstance(value, str) else value


def properties_of(function: dict) -> tuple[dict, list[str], bool]:
    """(properties, required, whether the function takes no parameters at all)."""
    schema = function.get("parameters", function.get("arguments")) or {}
    return schema.get("properties", {}) or {}, schema.get("required", []) or [], schema == {}


def item_type(declared: str, spec: dict) -> type | None:
    """The type of a nested type's elements: declared, or told by the type's name, else an object."""
    if declared not in NESTED:
        return None
    items = spec.get("items")
    inner = items.get("type") if isinstance(items, dict) else None
    if inner is None:
        inner = next((k for k in ("string", "enum") if k in declared), "dict")
    return TYPES.get(str(inner), Enumerated)


def coerced(value: Any) -> Any:
    """The words true and false as truth values."""
    return value == "true" if isinstance(value, str) and value in ("true", "false") else value


def parts_of(answer: Any) -> list:
    """What an answer is made of: a list's elements, an object's keys, a text's characters."""
    return list(answer) if isinstance(answer, (list, dict, str)) else []


def type_verdict(value: Any, answer: Any, expected: type, nested: type | None) -> tuple[bool, bool]:
    """(type accepted, value taken as a variable and not compared).

    Elements are looked at only where a part of the answer is a list itself; an
    answer without parts accepts no nested value.
    """
    value = coerced(value)
    variable = answer != "" and type(answer) is not expected
    refused = False
    if type(value) is expected:
        if nested is None:
            return True, variable
        for part in parts_of(answer):
            if not isinstance(part, list) or all(type_verdict(v, part, nested, None)[0] for v in value):
                return True, variable
        refused = True
    if answer != "" and (type(value) is type(answer) or value == answer):
        return not refused, True
    return False, variable


def dict_verdict(output: Any, answer: Any) -> Verdict:
    if not isinstance(output, dict) or not isinstance(answer, dict) or len(output) != len(answer):
        return Verdict(False, "value_error")
    for key, got in output.items():
        if key not in answer:
            return Verdict(False, "value_error")
        got, want = coerced(got), answer[key]
        if isinstance(want, dict):
            inner = dict_verdict(got, want)
            if not inner.valid:
                return inner
        elif str(_plain(want)) not in str(_plain(got)):
            return Verdict(False, "value_error")
    return OK


def dict_list_verdict(output: Any, answer: Any) -> Verdict:
    if not isinstance(output, list) or not isinstance(answer, list) or len(output) != len(answer):
        return Verdict(False, "value_error:list_dict_count")
    return next((v for x, a in zip(output, answer, strict=True) if not (v := dict_verdict(x, a)).valid), OK)


def value_verdict(value: Any, answer: Any, expected: type, nested: type | None, strict: bool, exact: bool) -> Verdict:
    """The comparison that the declared type asks for; texts by containment, or wholly where ``exact``."""
    if expected is dict:
        return dict_verdict(value, answer)
    if expected is list and nested is dict:
        return dict_list_verdict(value, answer)
    if expected is list:
        return OK if [_plain(v) for v in value] == [_plain(a) for a in answer] else Verdict(False, "value_error:list/tuple")
    if expected is str:
        got, want = plain(str(value)), plain(str(answer))
        return OK if got == want or not exact and want in got else Verdict(False, "value_error:string")
    if strict and value != answer:
        return Verdict(False, "value_error")
    return OK


def call_verdict(function: dict | None, output: Call, name: str, answer: dict[str, Any], strict: bool = False, exact: bool = False) -> Verdict:
    """One output call against one answer."""
    func, args = output
    properties, required, bare = properties_of(function or {})
    if not args or bare:
        return OK if not args and bare else Verdict(False, "wrong_param")
    if answer == properties:
        return OK
    if not answer:
        return Verdict(False, "wrong_param")
    if func != name:
        return Verdict(False, "wrong_function_name")
    if any(p not in args for p in required):
        return Verdict(False, "lack_args")
    for param, raw in args.items():
        if param not in properties or param not in answer:
            return Verdict(False, "addition_args")
        declared = str(properties[param].get("type"))
        if declared not in TYPES:
            return Verdict(False, "type_error")
        value = float(raw) if declared == "float" and type(raw) is int else raw
        expected, nested = TYPES[declared], item_type(declared, properties[param])
        accepted, variable = type_verdict(value, answer[param], expected, nested)
        if not accepted:
            return Verdict(False, "type_error")
        if not variable and not (v := value_verdict(coerced(value), answer[param], expected, nested, strict, exact)).valid:
            return v
    return OK


def calls_verdict(functions: list[dict], output: list[Call], answers: list[Call], strict: bool = False, exact: bool = False) -> Verdict:
    """All output calls against all answers, whose names may carry the number of a repeated call.

    One output call may satisfy several answers. The error kept is that of the
    last call tried for the first answer that none satisfies.
    """
    if len(output) != len(answers):
        return Verdict(False, "wrong functions number")
    names = sorted(re.sub(r"_\d+$", "", n) for n, _ in answers)
    if sorted(f for f, _ in output) != names:
        return Verdict(False, "function_mismatch")
    for key, answer in answers:
        name = re.sub(r"_\d+$", "", key)
        function = next((f for f in functions if f.get("name", "") in key), None)
        last = OK
        for call in output:
            last = call_verdict(function, call, name, answer, strict, exact) if call[0] == name else Verdict(False, "simple_function_checker:unclear")
            if last.valid:
                break
        if not last.valid:
            return last
    return OK


def any_answer(functions: list[dict], output: list[Call] | None, alternatives: list[list[Call]], strict: bool = False, exact: bool = False) -> Verdict:
    """Right if one of the alternative answers is met; else the last one's error."""
    if output is None:
        return Verdict(False, "wrong_output_format")
    last = Verdict(False, "wrong functions number")
    for answers in alternatives:
        last = calls_verdict(functions, output, answers, strict, exact)
        if last.valid:
            return OK
    return last


def _calls(rows) -> list[Call] | None:
    return None if rows is None else [(r["func"], json.loads(r["args_json"])) for r in rows]


def check_calls(functions_json: Column, output: Column, answers: Column, strict: bool = False, category: Column | None = None) -> Column:
    """(valid, error_type) from a JSON list of functions, decoded output calls and alternative lists of answer calls.

    In categories of agents texts must be equal as a whole (after the ignored
    characters are gone); elsewhere the answer's text must occur in the output's.
    """

    @F.pandas_udf(VERDICT)
    def run(functions: pd.Series, outputs: pd.Series, golden: pd.Series, exact: pd.Series) -> pd.DataFrame:
        read: dict[str, list[dict]] = {}
        rows = []
        for text, out, alternatives, whole in zip(functions, outputs, golden, exact, strict=True):
            if text not in read:
                read[text] = json.loads(text) if text else []
            v = any_answer(read[text], _calls(out), [_calls(a) for a in alternatives] if alternatives is not None else [], strict, whole)
            rows.append((v.valid, v.error))
        return pd.DataFrame(rows, columns=["valid", "error_type"])

    agent = F.lit(False) if category is None else F.coalesce(F.contains(category, F.lit("agent")), F.lit(False))
    return run(functions_json, output, answers, agent)


def state_matches(output: dict[str, dict], answer: dict[str, dict]) -> bool:
    """Final states by class: every class of the answer is there, and all attributes that the output has agree.

    An answer that is an object is compared by its own keys only. A class that
    the answer lacks is a mismatch.
    """

    def same(got: Any, want: Any) -> bool:
        if isinstance(want, dict) and isinstance(got, dict):
            return all(k in got and same(got[k], v) for k, v in want.items())
        return got == want

    if len(output) != len(answer):
        return False
    return all(c in answer and all(a in answer[c] and same(v, answer[c][a]) for a, v in attributes.items()) for c, attributes in output.items())


@F.pandas_udf(T.BooleanType())
def check_states(outputs: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([o is not None and a is not None and state_matches(json.loads(o), json.loads(a)) for o, a in zip(outputs, answers, strict=True)])
