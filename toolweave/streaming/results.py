"""Results as a stream: JSON-lines files that arrive, each id once, scored per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RESULT_SCHEMA = "id string, result string, ts timestamp"


def result_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """New result rows of a folder, the first of each id within the watermark."""
    rows = spark.readStream.schema(RESULT_SCHEMA).json(path)
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def minute_counts(stream: DataFrame, width: str = "1 minute") -> DataFrame:
    """Results per tumbling window."""
    return stream.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"))


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Score each batch and append it; a batch that is replayed replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
