"""What the jobs share: a config file read through Spark, and a log of what was read and written."""

from __future__ import annotations

import json
import logging
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

C = TypeVar("C")
log = logging.getLogger("toolweave.jobs")


def read_config(spark: SparkSession, kind: type[C], path: str | None) -> C:
    """A config of ``kind`` from a JSON file, the defaults where it says nothing; unknown settings are an error."""
    given = json.loads(spark.read.option("wholetext", True).text(path).first()[0]) if path else {}
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings in {path}: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def start_log() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
