"""Message and prompt building, and reading of model answers' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.operators.retrieval import small


def build_messages(turns: DataFrame, case: str, order: str, role: str = "role", text: str = "text", base: str = "") -> DataFrame:
    """(case, system, user): base and all system texts in order, and the last user text."""
    sorted_turns = F.array_sort(F.collect_list(F.struct(order, F.col(role).alias("role"), F.col(text).alias("text"))))
    m = turns.groupBy(case).agg(sorted_turns.alias("m"))
    of = lambda who: F.transform(F.filter("m", lambda x: x["role"] == who), lambda x: x["text"])
    return m.select(case, F.concat(F.lit(base), F.array_join(of("system"), "")).alias("system"), F.try_element_at(of("user"), F.lit(-1)).alias("user"))


def flatten_question(turns: DataFrame, case: str, order: str, text: str = "text") -> DataFrame:
    """(case, question): all contents in order, line feeds removed, trimmed, joined by spaces."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.trim(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(""))).alias("text"))))
    return turns.groupBy(case).agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("question"))


def fill_template(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places filled; a null value fills as the empty string."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt_kind(id_col: str) -> Column:
    """special, preference or normal, by the case id."""
    c = F.col(id_col)
    return F.when(c.contains("special"), "special").when(c.contains("preference"), "preference").otherwise("normal")


def build_prompts(cases: DataFrame, templates: DataFrame, id_col: str = "id", long_time: int = 0) -> DataFrame:
    """Cases (id, lang, functions, question, time, profile) with ``prompt`` from the template of their (lang, kind).

    ``templates`` (lang, kind, template) is sent to all tasks if it is counted to be small. Time is used
    only if longer than ``long_time`` characters.
    """
    time = F.when(F.length("time") > long_time, F.col("time"))
    joined = cases.withColumn("kind", prompt_kind(id_col)).join(small(templates), ["lang", "kind"], "left")
    filled = F.col("template")
    for name, value in {"functions": F.col("functions"), "question": F.col("question"), "time": time, "profile": F.col("profile")}.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return joined.withColumn("prompt", filled).drop("template")


def chat_format(turns: Column, tags: dict[str, tuple[str, str]]) -> Column:
    """Role-tagged concatenation of an array of (role, content)."""
    one = lambda t: F.concat(*[F.when(t["role"] == r, F.concat(F.lit(a), t["content"], F.lit(b))).otherwise("") for r, (a, b) in tags.items()])
    return F.array_join(F.transform(turns, one), "")


def without_thoughts(text: Column) -> Column:
    """What follows the last closing thought tag, where both tags are present."""
    both = text.contains("<think>") & text.contains("</think>")
    return F.when(both, F.element_at(F.split(text, "</think>\n\n"), -1)).otherwise(text)


def between_tags(text: Column, tag: str) -> Column:
    """The text between the first opening tag and the next closing one; empty if absent."""
    return F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)


def retained_functions(functions: Column, names: Column) -> Column:
    """Bodies of the distinct valid names in order, each the first function of that name."""
    body = lambda n: F.try_element_at(F.filter(functions, lambda f: f["name"] == n), F.lit(1))
    return F.filter(F.transform(F.array_distinct(names), body), lambda f: f.isNotNull())


def find_description(functions: Column, key: Column) -> Column:
    """The first function whose name the key contains; null if none."""
    return F.try_element_at(F.filter(functions, lambda f: F.contains(key, f["name"])), F.lit(1))
