"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that comparison ignores.
IGNORED = " ,./-_*^"


def standardize(text: Column) -> Column:
    """Lower case, without the ignored characters, single quotes as double quotes."""
    return F.replace(F.translate(F.lower(text), IGNORED, ""), F.lit("'"), F.lit('"'))


def contains_answer(output: Column, answer: Column) -> Column:
    """Whether the standardized answer occurs in the standardized output."""
    return F.contains(standardize(output), standardize(answer))


def python_literals(text: Column) -> Column:
    """JSON words as Python ones: ``=true``, ``=false`` and ``null`` anywhere; trimmed."""
    for old, new in (("=true", "=True"), ("=false", "=False"), ("null", "None")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_white_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def function_names(text: Column, candidates: Column | None = None) -> Column:
    """All word-and-dot runs outside brackets and commas; only those among ``candidates``, if given."""
    names = F.regexp_extract_all(F.regexp_replace(text, r"[\[\],]", " "), F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0))
    return names if candidates is None else F.filter(names, lambda n: F.array_contains(candidates, n))


def without_call_number(key: Column) -> Column:
    """An answer key without the number of a repeated call."""
    return F.regexp_replace(key, r"_\d+$", "")


def missing_parameters(text: Column) -> Column:
    """(group, group) pairs of two parenthesised parts that follow each other."""
    return F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)[^()]*\(([^()]*)\)"), F.lit(1))


def unwrap_single(values: Column) -> Column:
    """A map of arrays with each one-element array as its element."""
    return F.transform_values(values, lambda _, v: F.when(F.size(v) == 1, v[0]))


def argument_difference(given: Column, declared: Column, required: Column) -> tuple[Column, Column]:
    """(missing, redundant) parameter names, sorted."""
    return F.array_sort(F.array_except(required, given)), F.array_sort(F.array_except(given, declared))


def classify_special(result: Column, kind: Column, phrases: dict[str, str], name: Column, values: Column) -> Column:
    """Error type of a special case: null if right, ``error_detection`` if the phrase is missing, else ``error_correction``.

    incomplete needs its phrase, the function's name and each value; error_param
    its phrase and each value; irrelevant its phrase.
    """
    everything = F.forall(values, lambda v: F.contains(result, v))
    out = F.lit(None).cast("string")
    for k, phrase in phrases.items():
        has = F.contains(result, F.lit(phrase))
        rest = {"incomplete": F.contains(result, name) & everything, "error_param": everything}.get(k, F.lit(True))
        out = F.when(kind == k, F.when(~has, "error_detection").when(~rest, "error_correction")).otherwise(out)
    return out


def answer_type(json_text: Column) -> Column:
    """The type of a JSON value; null for the empty string."""
    return F.when(json_text != '""', F.schema_of_variant(F.try_parse_json(json_text)))


def document_text(*fields: Column) -> Column:
    """The fields of an API document as one text; a missing field is empty."""
    return F.concat_ws(", ", *[F.coalesce(f, F.lit("")) for f in fields])
