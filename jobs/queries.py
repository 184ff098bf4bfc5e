"""The jobs as queries: each runs twice into one new folder and returns its output as it stands then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import daily_scores, search_report
from toolweave.plans.oracle import BM25
from toolweave.sources.shared import scratch


def job1_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items against all documents; the second run replaces the first with the same rows."""
    output = scratch(spark, "search_report")
    for _ in range(2):
        hits = search_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", output)
    return hits


def job2_daily_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as results; the second run finds nothing new."""
    root = scratch(spark, "daily_scores")
    for _ in range(2):
        scores = daily_scores.run(spark, f"{sf_dir}/events.parquet", f"{root}/output", f"{root}/checkpoint")
    return scores.withColumn("day", F.col("day").cast("string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_search_report, job2_daily_scores)}


def oracle_sql() -> dict[str, str]:
    return {
        "job1_search_report": f"""WITH q AS (SELECT item_id AS qid, text FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text DESC NULLS LAST, coalesce(lang, 'none') DESC) AS r FROM documents WHERE doc_id IS NOT NULL) WHERE r = 1),
c AS (SELECT doc_id AS docid, text FROM g),
{BM25},
t AS (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INT AS rank FROM b_hits)
SELECT qid, docid, score, rank, coalesce(lang, 'none') AS lang FROM t JOIN g ON docid = doc_id WHERE rank <= 20""",
        "job2_daily_scores": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce(user_id, -1) AS model, event_type AS category, value,
  row_number() OVER (PARTITION BY ts::DATE, event_id ORDER BY ts, user_id NULLS FIRST, event_type, value NULLS FIRST) AS r
  FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL)
SELECT model, category, sum(coalesce(value > 50, false)::INT)::BIGINT AS correct, count(*) AS total, round(sum(coalesce(value > 50, false)::INT) / count(*)::DOUBLE, 6) AS accuracy, day
FROM e WHERE r = 1 GROUP BY day, model, category""",
    }
