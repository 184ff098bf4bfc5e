"""Decoding of generated function calls: strict, JSON and lenient.

Model output is parsed, never evaluated: arithmetic is limited to numbers and
the four operations. Decoded calls are (func, args_json), with argument order
kept. Anything that can't be read is null (strict) or left out (lenient).
"""

from __future__ import annotations

import ast
import json
import operator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
CALLS = T.ArrayType(T.StructType().add("func", _TEXT).add("args_json", _TEXT))
LENIENT = T.ArrayType(T.StructType().add("func", _TEXT).add("args_json", _TEXT).add("kwargs_json", _TEXT))
_OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_LIMIT = 10**15


class NotReadable(ValueError):
    """The text is no list of calls."""


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def dotted(node: ast.expr) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}"
    raise NotReadable(f"no function name: {ast.dump(node)[:80]}")


def value_of(node: ast.expr) -> Any:
    """A literal value; names are text, calls are {name: arguments}, subscripts their source."""
    match node:
        case ast.Constant(value=v):
            if v is Ellipsis:
                return "..."
            if isinstance(v, (bytes, complex)):
                raise NotReadable("a value of this type has no JSON form")
            return v
        case ast.UnaryOp(op=op, operand=inner):
            v = value_of(inner)
            if isinstance(op, ast.Not) and isinstance(v, bool):
                return not v
            if _number(v) and isinstance(op, (ast.USub, ast.UAdd)):
                return -v if isinstance(op, ast.USub) else v
        case ast.List(elts=items) | ast.Tuple(elts=items):
            return [value_of(i) for i in items]
        case ast.Dict(keys=keys, values=values):
            if all(k is not None for k in keys):
                return {k if isinstance(k := value_of(key), str) else json.dumps(k): value_of(v) for key, v in zip(keys, values, strict=True)}
        case ast.Name(id=name):
            return name
        case ast.Attribute():
            return dotted(node)
        case ast.Call():
            return dict([call_of(node)])
        case ast.Subscript():
            return ast.unparse(node)
        case ast.BinOp(left=left, op=op, right=right):
            a, b = value_of(left), value_of(right)
            if type(op) in _OPERATIONS and _number(a) and _number(b) and abs(a) < _LIMIT and abs(b) < _LIMIT and (b or not isinstance(op, ast.Div)):
                return _OPERATIONS[type(op)](a, b)
    raise NotReadable(f"no literal: {ast.dump(node)[:80]}")


def call_of(node: ast.Call) -> tuple[str, dict[str, Any]]:
    """(name, keyword arguments); positional arguments have no name and are left out."""
    return dotted(node.func), {k.arg: value_of(k.value) for k in node.keywords if k.arg}


def parsed(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
        raise NotReadable(str(e)) from e


def decode(text: str) -> list[tuple[str, dict[str, Any]]]:
    """The calls of a bracketed list of calls."""
    body = parsed(text)
    if not isinstance(body, ast.List) or not all(isinstance(c, ast.Call) for c in body.elts):
        raise NotReadable("not a list of calls")
    return [call_of(c) for c in body.elts]


def decode_json(text: str) -> list[tuple[str, dict[str, Any]]]:
    """The calls of a JSON list of {name: arguments}, arguments an object or its text."""
    try:
        rows = json.loads(text)
        out = [(name, json.loads(args) if isinstance(args, str) else args) for row in rows for name, args in row.items()]
    except (ValueError, AttributeError, TypeError) as e:
        raise NotReadable(str(e)) from e
    if not all(isinstance(a, dict) for _, a in out):
        raise NotReadable("arguments must be objects")
    return out


def parse_lenient(text: str) -> list[tuple[str, list[Any], dict[str, Any]]]:
    """(name, positional, keyword) of each readable call of a list or a single call; literals only."""
    try:
        body = parsed(text)
    except NotReadable:
        return []
    out = []
    for c in body.elts if isinstance(body, (ast.List, ast.Tuple)) else [body]:
        if isinstance(c, ast.Call):
            try:
                args = [ast.literal_eval(a) for a in c.args]
                kwargs = {k.arg: ast.literal_eval(k.value) for k in c.keywords if k.arg}
                json.dumps([args, kwargs])
                out.append((dotted(c.func), args, kwargs))
            except (ValueError, TypeError, NotReadable, RecursionError):
                continue
    return out


def as_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def _series(texts: pd.Series, read) -> pd.Series:
    def one(text):
        if text is None:
            return None
        try:
            return [{"func": f, "args_json": as_json(a)} for f, a in read(text)]
        except (NotReadable, ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(CALLS)
def decode_calls(texts: pd.Series) -> pd.Series:
    return _series(texts, decode)


@F.pandas_udf(CALLS)
def decode_json_calls(texts: pd.Series) -> pd.Series:
    return _series(texts, decode_json)


@F.pandas_udf(LENIENT)
def parse_calls(texts: pd.Series) -> pd.Series:
    rows = [[{"func": f, "args_json": as_json(a), "kwargs_json": as_json(k)} for f, a, k in parse_lenient(t)] if t is not None else [] for t in texts]
    return pd.Series(rows, dtype=object)


def decode_output(text: Column, model: Column) -> Column:
    """JSON decoding for models whose name holds ``FC``, else the strict form."""
    return F.when(model.contains("FC"), decode_json_calls(text)).otherwise(decode_calls(text))


def is_empty(calls: Column) -> Column:
    """Unreadable, no calls, or nothing but one call without a name."""
    return calls.isNull() | (F.size(calls) == 0) | ((F.size(calls) == 1) & (calls[0]["func"] == ""))


def python_text(value: Any) -> str:
    """A value in the calls' syntax."""
    return repr(value)


def print_calls(calls: list[tuple[str, dict[str, Any]]]) -> str:
    """The list that ``decode`` reads back."""
    return "[" + ", ".join(f"{f}({', '.join(f'{k}={python_text(v)}' for k, v in a.items())})" for f, a in calls) + "]"


@F.pandas_udf(T.ArrayType(_TEXT))
def print_answers(texts: pd.Series) -> pd.Series:
    """A golden JSON answer (an object of calls, or a list of them) as ``name(k=v, ...)`` texts."""

    def one(text):
        if text is None:
            return None
        read = json.loads(text)
        return [print_calls([call])[1:-1] for a in (read if isinstance(read, list) else [read]) for call in a.items()]

    return pd.Series([one(t) for t in texts], dtype=object)


def same_calls(a: str, b: str) -> bool:
    """Whether both parse to the same names and keyword arguments; the last call of a name counts."""
    x, y = ({f: k for f, _, k in parse_lenient(t)} for t in (a, b))
    return x == y
