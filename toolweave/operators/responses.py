"""The boundary to language models: their answers are a column of data.

A response source is a table (case, group, phase, text) or any pandas function
from prompts to texts. ``stub`` answers deterministically, so that every
pipeline can be run and tested without a model.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sampling settings of the generation step.
SAMPLING = {"temperature": 0.0, "top_p": 0.9, "max_tokens": 2048}


def from_table(prompts: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """``prompts`` with the recorded ``text``; null where none is recorded."""
    return prompts.join(responses, keys, "left")


def generate(prompts: DataFrame, answer: Callable[[pd.Series], pd.Series], prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``text`` by a batch function; Spark's task retry replaces a client's."""
    return prompts.withColumn("text", F.pandas_udf(answer, "string")(F.col(prompt)))


def stub(prompts: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else f"[answer_{zlib.crc32(p.encode()) % 97}()]" for p in prompts], dtype=object)


def completion_text(response: str):
    """The text of a chat response's first choice."""
    return F.get_json_object(response, "$.choices[0].message.content")


def embedding_of(response: str):
    """The vector of an embedding response."""
    return F.from_json(F.get_json_object(response, "$.data[0].embedding"), "array<double>")
