"""Global order without a single task: dense positions, natural id order, top-k."""

from __future__ import annotations

import random
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolweave.sources.shared import materialize


def dense_index(df: DataFrame, order: list[Column | str], name: str = "position", start: int = 0) -> DataFrame:
    """``df`` with its rows' positions in the global order, counted from ``start``.

    Rows are dealt by range, numbered inside each range, and moved on by the
    sizes of the ranges before; only one number per range reaches the driver.
    The order must be total for positions to be reproducible.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"__order_{i}" for i in range(len(order))]
    keyed = df.select("*", *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    ranged = keyed.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    before = list(zip(sorted(sizes), accumulate([start, *[sizes[k] for k in sorted(sizes)]]), strict=False))
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    # one row per range, so this side may be sent to all executors
    placed = ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")
    return placed.select(*df.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(name))


def count_before(df: DataFrame, order: list[str], of: Column, name: str) -> DataFrame:
    """``df`` with, in ``name``, the number of rows before each in the global order for which ``of`` holds.

    As in ``dense_index`` rows are dealt by range and one number per range reaches the driver.
    """
    ranged = materialize(df.withColumn("__of", of.cast("int")).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = {r["__range"]: r["n"] for r in ranged.groupBy("__range").agg(F.sum("__of").alias("n")).collect()}
    before = list(zip(sorted(sizes), accumulate([0, *[sizes[k] for k in sorted(sizes)]]), strict=False))
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    earlier = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__inside", F.coalesce(F.sum("__of").over(earlier), F.lit(0))).join(F.broadcast(offsets), "__range")
    return placed.select(*df.columns, (F.col("__before") + F.col("__inside")).cast("long").alias(name))


def rank_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """``df`` with each row's rank, from 1, within its ``keys``, which may hold any share of the rows. Rows without a key are left out.

    The rank is the global position by (keys, order) less that of the keys' first row.
    """
    placed = dense_index(df, [*keys, *order], "__position")
    first = placed.groupBy(*keys).agg(F.min("__position").alias("__first"))
    return placed.join(first, keys).select(*df.columns, (F.col("__position") - F.col("__first") + 1).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input is read by fewer tasks, for steps that cost much per row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, rows: int, *keys: str, each: int) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys`` into parts of about ``each``, no fewer than there are cores: what a task holds doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def trailing_number(column: str, last: int = 1) -> Column:
    """The integer that the last ``last``-th part of an id (parts joined by ``_`` or ``#``) stands for."""
    return F.element_at(F.split(F.col(column), "[_#]"), -last).cast("long")


def top_k(hits: DataFrame, k: int, key: str = "qid", doc: str = "docid", score: str = "score") -> DataFrame:
    """The k best rows per key by (score desc, doc), with ``rank`` from 1; Catalyst limits each group before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc(score), doc)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def seeded_shuffle(values: Column, seed: int = 42, kind: str = "array<string>") -> Column:
    """Each array in the order that Python's generator with this seed shuffles it to."""

    @F.pandas_udf(kind)
    def run(arrays: pd.Series) -> pd.Series:
        out = []
        for a in arrays:
            a = None if a is None else list(a)
            if a:
                random.Random(seed).shuffle(a)
            out.append(a)
        return pd.Series(out, dtype=object)

    return run(values)
