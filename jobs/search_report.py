"""Search job: index the documents, rank them for every benchmark item, report what each item reaches.

    python -m jobs.search_report --documents D --items I --output O [--config C]

Under the output: ``index`` (the kept inverted index), ``hits`` (partitioned by
the document's language) and ``report`` (a row per item: hits, best score and
share of the hits by language of most of them). A rerun replaces all three with
the same rows. Documents without an id are left out; null texts match nothing; a
null language is the partition ``none``; ids that repeat count once, with their
greatest text.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, read_config, start_log
from toolweave.operators import index
from toolweave.operators.retrieval import SMALL_ROWS, small
from toolweave.sources.shared import drop_tables, materialize

HITS = "qid bigint, docid bigint, score double, rank int, lang string"


@dataclass(frozen=True)
class Config:
    top_k: int = 20
    lower: bool = False
    block: int = index.BLOCK
    parts: int = index.PARTS
    no_language: str = "none"


def run(spark: SparkSession, documents: str, items: str, output: str, config: Config | None = None) -> DataFrame:
    """Index, rank, write; the hits as they stand in the output."""
    config = config or Config()
    docs = spark.read.parquet(documents).filter("doc_id is not null")
    docs = once(docs.select(F.col("doc_id").alias("docid"), "text", F.coalesce("lang", F.lit(config.no_language)).alias("lang")))
    asked = spark.read.parquet(items).filter("item_id is not null").select(F.col("item_id").alias("qid"), "text")
    log.info("read %d documents from %s, %d items from %s", docs.count(), documents, asked.count(), items)
    kept = index.build(docs.select("docid", "text"), f"{output}/index", config.lower, config.block, config.parts)
    hits, work = index.search_counted(kept, asked, config.top_k)
    hits = small(materialize(hits, "hits")).join(docs.select("docid", "lang"), "docid").select("qid", "docid", "score", "rank", "lang")
    hits.repartition("lang", F.pmod(F.col("qid"), F.lit(8))).write.partitionBy("lang").mode("overwrite").parquet(f"{output}/hits")
    written = spark.read.schema(HITS).parquet(f"{output}/hits")
    report(written).write.mode("overwrite").parquet(f"{output}/report")
    for row in work.collect():
        log.info("%s: %d blocks of documents for an item, %d postings", row["kind"], row["blocks"], row["rows"])
    log.info("wrote %d hits in languages %s to %s", written.count(), sorted(r["lang"] for r in written.select("lang").distinct().collect()), output)
    return written


def once(docs: DataFrame) -> DataFrame:
    """``docs`` (docid, text, lang) with one row an id, that of the greatest text; only texts of ids that repeat are shuffled and written.

    Where these are too many to be sent to all tasks, all are written, so that they are shuffled once.
    """
    ids = materialize(docs.groupBy("docid").count().filter("count > 1").select("docid"), "repeated")
    repeated = small(ids)
    greatest = docs.join(repeated, "docid", "left_semi").groupBy("docid").agg(F.max(F.struct("text", "lang")).alias("d")).select("docid", "d.*")
    whole = docs.join(repeated, "docid", "left_anti").unionAll(materialize(greatest, "greatest"))
    return whole if ids.count() <= SMALL_ROWS else materialize(whole, "documents")


def report(hits: DataFrame) -> DataFrame:
    """(qid, hits, best, lang, share): an item's hits, their best score, and the language that most of them have."""
    by_lang = hits.groupBy("qid", "lang").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    most = F.max_by("lang", F.struct("n", "lang"))
    return by_lang.groupBy("qid").agg(F.sum("n").alias("hits"), F.max("best").alias("best"), most.alias("lang"), (F.max("n") / F.sum("n")).alias("share"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.search_report")
    for name in ("documents", "items", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    start_log()
    spark = SparkSession.builder.appName("search_report").getOrCreate()
    try:
        run(spark, a.documents, a.items, a.output, read_config(spark, Config, a.config))
    finally:
        drop_tables(spark)
        spark.stop()


if __name__ == "__main__":
    main()
