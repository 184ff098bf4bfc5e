"""Decoding and checking of calls."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toolweave.functions import calls, checker

FUNCTIONS = [
    {"name": "f", "parameters": {"properties": {"s": {"type": "string"}, "n": {"type": "integer"}, "x": {"type": "float"}, "b": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "string"}}, "d": {"type": "object"}, "o": {"type": "objectArray"}, "e": {"type": "enum"}, "a": {"type": "any"}}, "required": ["s"]}},
    {"name": "pkg.g", "arguments": {"properties": {"q": {"type": "number"}}, "required": ["q"]}},
    {"name": "none", "parameters": {}},
]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[f(s='a b', n=-3)]", [("f", {"s": "a b", "n": -3})]),
        ("[f(n=+1)]", [("f", {"n": 1})]),
        ("[a.b.c(x=(1, 2))]", [("a.b.c", {"x": [1, 2]})]),
        ("[f('positional', s=true)]", [("f", {"s": "true"})]),
        ("[f(x=g(y=1))]", [("f", {"x": {"g": {"y": 1}}})]),
        ("[f(x=...)]", [("f", {"x": "..."})]),
        ("[f(x=m['k'])]", [("f", {"x": "m['k']"})]),
        ("[f(x=2*3+1)]", [("f", {"x": 7})]),
        ("[f(d={'b': 1, 'a': [None]})]", [("f", {"d": {"b": 1, "a": [None]}})]),
        ("[]", []),
    ],
)
def test_decode(text, want):
    assert calls.decode(text) == want


@pytest.mark.parametrize("text", ["f(s=1)", "[f(s=1, s=2)]", "[f(", "[1]", "", "[f(x=__import__('os').system('true'))]", "[f(x=2**9999)]", "[f(x=1/0)]", "[f(x=[1 for _ in y])]"])
def test_decode_refuses(text):
    try:
        out = calls.decode(text)
    except calls.NotReadable:
        return
    # a nested call stays data: nothing of it is run
    assert all(isinstance(json.dumps(a), str) for _, a in out)


def test_lenient_parse_skips_bad_calls():
    assert calls.parse_lenient("[f(1, s='x'), g(y=z), h()]") == [("f", [1], {"s": "x"}), ("h", [], {})]
    assert calls.parse_lenient("f(s=1)") == [("f", [], {"s": 1})]
    assert calls.parse_lenient("no call") == []


def test_json_decode():
    assert calls.decode_json('[{"f": "{\\"a\\": 1}"}, {"g": {}}]') == [("f", {"a": 1}), ("g", {})]
    with pytest.raises(calls.NotReadable):
        calls.decode_json("{")


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=8), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=6)


@settings(deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["f", "a.b"]), st.dictionaries(st.sampled_from(["s", "n", "zz"]), values, max_size=3)), max_size=3))
def test_printed_calls_read_back(made):
    assert calls.decode(calls.print_calls(made)) == made


@pytest.mark.parametrize(
    ("output", "answer", "want"),
    [
        ([("f", {"s": "The Cat!"})], [("f", {"s": "the cat"})], None),
        ([], [("f", {"s": "a"})], "wrong functions number"),
        ([("g", {"s": "a"})], [("f", {"s": "a"})], "function_mismatch"),
        ([("f", {"n": 1})], [("f", {"s": "a", "n": 1})], "lack_args"),
        ([("f", {"s": "a", "zz": 1})], [("f", {"s": "a"})], "addition_args"),
        ([("f", {"s": "a", "n": 1})], [("f", {"s": "a"})], "addition_args"),
        ([("f", {"s": "a", "n": "x"})], [("f", {"s": "a", "n": 1})], "type_error"),
        ([("f", {"s": "b"})], [("f", {"s": "a"})], "value_error:string"),
        ([("f", {"s": "a", "l": ["x", "y"]})], [("f", {"s": "a", "l": ["y", "x"]})], "value_error:list/tuple"),
        ([("f", {"s": "a", "l": ["X-y"]})], [("f", {"s": "a", "l": ["xy"]})], None),
        ([("f", {"s": "a", "d": {"k": 1}})], [("f", {"s": "a", "d": {"k": 1, "m": 2}})], "value_error"),
        ([("f", {"s": "a", "d": {"k": "true"}})], [("f", {"s": "a", "d": {"k": True}})], None),
        ([("f", {"s": "a", "o": [{"k": 1}]})], [("f", {"s": "a", "o": [{"k": 1}, {"k": 2}]})], "value_error:list_dict_count"),
        ([("f", {"s": "a", "x": 2})], [("f", {"s": "a", "x": 3.5})], None),
        ([("f", {"s": "a", "n": 5})], [("f", {"s": "a", "n": 6})], None),
        ([("f", {"s": "a", "b": "true"})], [("f", {"s": "a", "b": False})], None),
        ([("f", {"s": "a"})], [("f", {"s": "a", "n": 1})], None),
        ([("none", {})], [("none", {})], None),
        ([("f", {})], [("f", {"s": "a"})], "wrong_param"),
        ([("f", {"s": "a"}), ("f", {"s": "b"})], [("f_1", {"s": "a"}), ("f_2", {"s": "b"})], None),
        ([("pkg.g", {"q": 1})], [("pkg.g", {"q": 2})], None),
    ],
)
def test_verdicts(output, answer, want):
    verdict = checker.calls_verdict(FUNCTIONS, output, answer)
    assert (verdict.valid, verdict.error) == (want is None, want)


SHAPES = [{"name": "h", "parameters": {"properties": {"bare": {"type": "array"}, "texts": {"type": "array", "items": {"type": "string"}}, "rows": {"type": "array", "items": {"type": "object"}}, "o": {"type": "object"}, "d": {"type": "dict"}, "l": {"type": "list"}, "ls": {"type": "list(string)"}, "le": {"type": "list(enum)"}, "oa": {"type": "objectArray"}, "t": {"type": "tuple"}, "s": {"type": "string"}, "e": {"type": "enum"}}, "required": []}}]


@pytest.mark.parametrize(
    ("output", "answer", "want"),
    [
        ({"bare": ["x"]}, {"bare": ["x"]}, "value_error"),  # an array without items holds objects
        ({"bare": [{"k": 1}]}, {"bare": [{"k": 1}]}, None),
        ({"bare": [{"k": 1}]}, {"bare": [{"k": 1}, {"k": 2}]}, "value_error:list_dict_count"),
        ({"rows": [{"k": "A b"}, {"k": {"m": [1]}}]}, {"rows": [{"k": "ab"}, {"k": {"m": [1]}}]}, None),
        ({"rows": [{"k": 1}]}, {"rows": [{"m": 1}]}, "value_error"),
        ({"texts": ["a", "B"]}, {"texts": ["a", "b"]}, None),
        ({"texts": ["a"]}, {"texts": [["a"], ["b"]]}, "value_error:list/tuple"),
        ({"texts": [1]}, {"texts": [["a"]]}, "type_error"),
        ({"texts": []}, {"texts": []}, "type_error"),
        ({"texts": "a"}, {"texts": ["a"]}, "type_error"),
        ({"texts": ["a"]}, {"texts": "variable"}, None),
        ({"texts": "variable"}, {"texts": "variable"}, None),
        ({"o": {"k": 1}}, {"o": {}}, "type_error"),
        ({"o": {"k": "x1"}}, {"o": {"k": "x"}}, None),
        ({"o": {"k": "true"}}, {"o": {"k": True}}, None),
        ({"d": {"k": 1}}, {"d": {}}, "value_error"),
        ({"d": {}}, {"d": {}}, None),
        ({"l": []}, {"l": []}, None),
        ({"l": [{"k": 1}]}, {"l": [{"k": 1}]}, None),
        ({"ls": ["x"]}, {"ls": ["x"]}, None),
        ({"le": ["x"]}, {"le": ["y"]}, "value_error:list/tuple"),
        ({"oa": [{"k": 1}]}, {"oa": [{"k": 1}]}, None),
        ({"oa": [{"k": 2}]}, {"oa": [{"k": 1}]}, "value_error"),
        ({"t": [1, 2]}, {"t": [1, 2]}, "value_error"),
        ({"s": "true"}, {"s": "true"}, "type_error"),
        ({"e": "a"}, {"e": "b"}, None),
        ({"e": 1}, {"e": "b"}, "type_error"),
    ],
)
def test_nested_types(output, answer, want):
    verdict = checker.calls_verdict(SHAPES, [("h", output)], [("h", answer)])
    assert (verdict.valid, verdict.error) == (want is None, want)


def test_agents_need_equal_texts(spark):
    out, answer = [("f", {"s": "the cat"})], [("f", {"s": "cat"})]
    assert checker.calls_verdict(FUNCTIONS, out, answer).valid
    assert checker.calls_verdict(FUNCTIONS, out, answer, exact=True).error == "value_error:string"
    df = spark.createDataFrame([("normal_x", "[f(s='the cat')]"), ("agent_x", "[f(s='the cat')]"), ("agent_x", "[f(s='C-A-T')]")], "category string, text string")
    verdicts = checker.check_calls(F.lit(json.dumps(FUNCTIONS)), calls.decode_calls("text"), F.array(calls.decode_calls(F.lit("[f(s='cat')]"))), category=F.col("category"))
    assert [(r.v.valid, r.v.error_type) for r in df.select(verdicts.alias("v")).collect()] == [(True, None), (False, "value_error:string"), (True, None)]


def test_strict_compares_numbers():
    out, answer = [("f", {"s": "a", "n": 5})], [("f", {"s": "a", "n": 6})]
    assert checker.calls_verdict(FUNCTIONS, out, answer).valid
    assert not checker.calls_verdict(FUNCTIONS, out, answer, strict=True).valid


def test_alternatives_and_unreadable_output():
    right, wrong = [("f", {"s": "a"})], [("f", {"s": "zzz"})]
    assert checker.any_answer(FUNCTIONS, right, [wrong, right]).valid
    assert checker.any_answer(FUNCTIONS, None, [right]).error == "wrong_output_format"


def test_states():
    assert checker.state_matches({"A": {"x": {"k": 1, "more": 2}}}, {"A": {"x": {"k": 1}, "y": 3}})
    assert not checker.state_matches({"A": {"x": 1}}, {"B": {"x": 1}})
    assert not checker.state_matches({"A": {"z": 1}}, {"A": {"x": 1}})


def test_columns(spark):
    df = spark.createDataFrame([("[f(s='a')]", "m"), ('[{"f": {"s": "a"}}]', "x-FC"), ("bad(", "m"), (None, "m")], "text string, model string")
    got = [r[0] for r in df.select(calls.decode_output(df.text, df.model)).collect()]
    assert [None if g is None else [(c.func, json.loads(c.args_json)) for c in g] for g in got] == [[("f", {"s": "a"})], [("f", {"s": "a"})], None, None]
