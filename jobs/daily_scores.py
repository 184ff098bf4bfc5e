"""Scoring job: results that arrive as files become accuracies per day, model and category.

    python -m jobs.daily_scores --source S --output O --checkpoint C [--config C]

Each run takes the files that are new since the last one (a file stream with
``availableNow`` and a checkpoint) and ends. A batch is written to ``results``,
under its number and the day of its rows; then the days it touches are scored
from all their results and replaced in ``scores``, which is partitioned by day.
A batch that is replayed after a failure replaces what it had written, so both
tables are the same as after one clean run.

A result is a row (event_id, ts, user_id, event_type, value): its id, time, model,
category and points; it is correct above ``threshold`` points. Rows without an id,
time or category are left out and logged; an id counts once a day, in the row with
the smallest time, then model, category and points; null models are -1, null
points are wrong.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, start_log
from toolweave.operators.metrics import weighted_accuracy

RESULTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, batch bigint, day date"
SCORES = "model bigint, category string, correct bigint, total bigint, accuracy double, day date"


@dataclass(frozen=True)
class Config:
    threshold: float = 50.0
    files_per_batch: int = 1000


def write_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace the partitions of ``path`` that ``df`` has rows for."""
    df.write.partitionBy(*columns).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def scores(results: DataFrame, threshold: float) -> DataFrame:
    """(model, category, correct, total, accuracy, day) of ``results``, each id once a day."""
    row = F.struct("ts", F.coalesce("user_id", F.lit(-1)).alias("model"), F.col("event_type").alias("category"), "value")
    once = results.groupBy("day", "event_id").agg(F.min(row).alias("r")).select("day", "r.*")
    right = F.coalesce((F.col("value") > threshold).cast("long"), F.lit(0))
    out = once.groupBy("day", "model", "category").agg(F.sum(right).alias("correct"), F.count("*").alias("total"))
    return out.select("model", "category", "correct", "total", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"), "day")


def put(batch: DataFrame, number: int, output: str, config: Config) -> None:
    """Write a batch's results and score the days it touches."""
    spark = batch.sparkSession
    good = batch.filter("event_id is not null and ts is not null and event_type is not null")
    rows = good.select("event_id", "ts", "user_id", "event_type", "value", F.lit(number).cast("long").alias("batch"), F.to_date("ts").alias("day"))
    # a day's rows of a batch go to a few files, whatever their share
    write_partitions(rows.repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(4))), f"{output}/results", "batch", "day")
    results = spark.read.schema(RESULTS).parquet(f"{output}/results")
    mine = results.filter(F.col("batch") == number)
    # at most one row a day of the calendar
    days = sorted(r["day"] for r in mine.select("day").distinct().collect())
    if days:
        touched = results.filter(F.col("day").isin(days))
        write_partitions(scores(touched, config.threshold).repartition("day"), f"{output}/scores", "day")
    log.info("batch %d: read %d rows, wrote %d results on %d days", number, batch.count(), mine.count(), len(days))


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: Config | None = None) -> DataFrame:
    """Take what is new in ``source``; the scores of all days as they stand."""
    config = config or Config()
    # so that there is a table before there are results
    spark.createDataFrame([], SCORES).write.partitionBy("day").mode("append").parquet(f"{output}/scores")
    spark.createDataFrame([], RESULTS).write.partitionBy("batch", "day").mode("append").parquet(f"{output}/results")
    # a pattern that only ``source`` matches: file streams take a single file as a pattern alone
    only = source.rstrip("/")
    only = f"{only[:-1]}[{only[-1]}]"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(only)
    query = stream.writeStream.foreachBatch(lambda batch, number: put(batch, number, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(SCORES).parquet(f"{output}/scores")
    log.info("read %d rows from %s in this run; %s has %d rows", sum(p["numInputRows"] for p in query.recentProgress), source, output, out.count())
    for row in overall(out).orderBy("category").collect():
        log.info("%s: accuracy %s", row["category"], row["accuracy"])
    return out


def overall(daily: DataFrame) -> DataFrame:
    """(category, accuracy) over all days and models, each result alike; a row a category."""
    return weighted_accuracy(daily.select("category", "accuracy", F.col("total").alias("n")), ["category"], "accuracy", "n")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.daily_scores")
    for name in ("source", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("daily_scores").getOrCreate()
    try:
        run(spark, a.source, a.output, a.checkpoint, read_config(spark, Config, a.config)).orderBy("day", "model", "category").show()
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
