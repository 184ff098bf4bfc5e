"""Writers of the same formats. Output is as many files as the data's partitions; ``single`` is for small hand-offs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.operators.catalog import category_of
from toolweave.operators.order import trailing_number


def write_tsv(df: DataFrame, path: str, header: bool | None = None, single: bool = False) -> None:
    """Tab-separated; the header is written if asked for or, by default, if there is a ``docid`` column."""
    out = df.coalesce(1) if single else df
    out.write.csv(path, sep="\t", header="docid" in df.columns if header is None else header, quote='"', escape='"')


def write_json_lines(df: DataFrame, path: str, single: bool = False) -> None:
    """One object per line, characters as they are."""
    out = df.coalesce(1) if single else df
    out.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def append_results(results: DataFrame, path: str, id_col: str = "id") -> None:
    """Append result rows, one folder per category of their id."""
    results.withColumn("category", category_of(id_col)).write.mode("append").partitionBy("category").json(path)


def natural_keys(id_col: str = "id") -> list[Column]:
    """What results are sorted by: category, the last integer part of the id, or the last two for multi-turn ids."""
    multi = F.col(id_col).contains("multi_turn") & ~F.col(id_col).contains("agent")
    return [category_of(id_col), F.when(multi, trailing_number(id_col, 2)).otherwise(trailing_number(id_col)), F.when(multi, trailing_number(id_col))]


def sorted_results(results: DataFrame, id_col: str = "id") -> DataFrame:
    """Results in natural order."""
    return results.orderBy(*natural_keys(id_col))


def retrieval_results(hits: DataFrame) -> DataFrame:
    """(qid, corpus_id_list) from ranked hits."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "docid")))
    return hits.groupBy("qid").agg(F.transform(ranked, lambda r: r["docid"]).alias("corpus_id_list"))


def write_scores(summary: DataFrame, failed: DataFrame, path: str) -> None:
    """Two tables, never mixed in one file: ``summary`` and ``failures``."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    failed.write.mode("overwrite").json(f"{path}/failures")


def append_metrics(metrics: DataFrame, path: str, epoch: int, steps: int) -> None:
    """Append one row of metrics with its epoch and steps, each metric in a column of its own."""
    metrics.select(F.lit(epoch).alias("epoch"), F.lit(steps).alias("steps"), "*").coalesce(1).write.mode("append").csv(path, header=True)
