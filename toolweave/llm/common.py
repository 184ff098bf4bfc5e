"""Shared plumbing of the training-data operators.

Every operator takes a DataFrame plus column names and returns a DataFrame.
Text columns may be null (read as the empty string unless an operator says
otherwise), ids may be null, rows may repeat, tables may be empty and may carry
further columns under any name: operators select only the columns they are told
about, so nothing can clash.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.sources.shared import materialize, shared_dir

__all__ = ["documents", "fold", "lower_words", "map_batches", "materialize", "shared_dir", "texts_of"]

#: Batches are worked on in parts of about so many bytes.
PART_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the input folder; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about PART_BYTES, so that what is made from one stays small."""
    rows = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, PART_BYTES))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Hand free memory back to the system; a worker process outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Apply a batch function that ``start`` builds once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in parts_of(batch):
                if (out := work(part)) is not None and out.num_rows:
                    yield out
        del work
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """The strings of a column, null as the empty string."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def lower_words(text: str) -> list[bytes]:
    """UTF-8 words between runs of 0x20 and 0x09-0x0D, with A-Z lowered.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, as the contracts ask.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()
