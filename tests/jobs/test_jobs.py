"""The jobs on copies of the tables: growing input, reruns, replays, odd rows, the command line."""

from __future__ import annotations

import ast
import datetime as dt
import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import daily_scores, search_report
from jobs.common import read_config
from toolweave.operators import index, retrieval
from toolweave.operators.order import top_k

ROOT = Path(__file__).resolve().parents[2]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scores_grow_with_the_input(spark, small, tmp_path, caplog):
    """The second run takes the new file only, scores its days anew and equals one run over everything."""
    events = spark.read.parquet(f"{small}/events.parquet")
    source = f"{tmp_path}/events"
    events.filter("event_id % 3 <> 0").coalesce(2).write.parquet(source)
    put = lambda: daily_scores.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark")
    before = rows(put())
    assert before == rows(daily_scores.scores(events.filter("event_id % 3 <> 0").withColumn("day", F.to_date("ts")), 50.0))
    # the rest arrives, with rows that were there already and rows that can't be used
    odd = spark.createDataFrame([(None, dt.datetime(2024, 1, 5), 1, "click", 90.0, None), (10**9, None, 1, "click", 90.0, None), (10**9 + 1, dt.datetime(2024, 1, 5), 1, None, 90.0, None), (10**9 + 2, dt.datetime(2030, 1, 1), None, "click", None, None)], events.schema)
    more = events.filter("event_id % 3 = 0 or event_id % 7 = 0").unionAll(odd)
    more.coalesce(1).write.mode("append").parquet(source)
    with caplog.at_level(logging.INFO, "toolweave.jobs"):
        after = rows(put())
    assert f"batch 1: read {more.count()} rows, wrote {more.count() - 3} results" in caplog.text
    whole = events.unionAll(odd.filter("event_id = 1000000002")).withColumn("day", F.to_date("ts"))
    assert after == rows(daily_scores.scores(whole, 50.0))
    assert (-1, "click", 0, 1, 0.0, dt.date(2030, 1, 1)) in after
    # nothing new: the same result
    assert rows(put()) == after
    days = {p.name for p in Path(f"{tmp_path}/out/scores").iterdir() if p.name.startswith("day=")}
    assert "day=2030-01-01" in days


def test_replayed_batch_changes_nothing(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    config, out = daily_scores.Config(), f"{tmp_path}/out"
    for number in (0, 1, 1):
        daily_scores.put(events.filter(F.col("event_id") % 2 == number), number, out, config)
    got = rows(spark.read.schema(daily_scores.SCORES).parquet(f"{out}/scores"))
    assert got == rows(daily_scores.scores(events.withColumn("day", F.to_date("ts")), 50.0))


def test_no_results_yet(spark, small, tmp_path):
    source = f"{tmp_path}/none"
    spark.read.parquet(f"{small}/events.parquet").filter("false").write.parquet(source)
    assert daily_scores.run(spark, source, f"{tmp_path}/out", f"{tmp_path}/mark").count() == 0


@pytest.fixture(scope="module")
def library(spark):
    texts = ["open the door", "close the door", "open the window window", None, "", "nothing here", "door " * 5000, "the the the open"]
    return spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)] + [(1, "a", "de"), (None, "open", "en")], "doc_id long, text string, lang string")


def test_search_report_reruns(spark, library, tmp_path):
    """Two runs give the same; hits equal plain BM25 over one row an id; partitions are languages."""
    items = spark.createDataFrame([(1, "open the window"), (2, None), (3, "unknown"), (None, "door"), (4, "door door")], "item_id long, text string")
    library.write.parquet(f"{tmp_path}/docs")
    items.write.parquet(f"{tmp_path}/items")
    run = lambda: rows(search_report.run(spark, f"{tmp_path}/docs", f"{tmp_path}/items", f"{tmp_path}/out", search_report.Config(top_k=3, block=2, parts=4)))
    first = run()
    assert run() == first
    docs = library.filter("doc_id is not null").groupBy(F.col("doc_id").alias("docid")).agg(F.max("text").alias("text"))
    want = top_k(retrieval.bm25(items.filter("item_id is not null").select(F.col("item_id").alias("qid"), "text"), docs), 3)
    assert [r[:4] for r in first] == rows(want.select("qid", "docid", "score", "rank"))
    assert {p.name for p in Path(f"{tmp_path}/out/hits").iterdir() if "=" in p.name} <= {"lang=en", "lang=none"}
    report = {r["qid"]: r for r in spark.read.parquet(f"{tmp_path}/out/report").collect()}
    assert report.keys() == {1, 4} and report[1]["hits"] == 3


@pytest.mark.parametrize(("block", "first"), [(2, 1), (16, 2), (64, 8)])
def test_index_equals_plain_search(spark, small, tmp_path, block, first):
    """Whatever the blocks, hits, scores and ties are those of BM25 over all documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("docid"), "text")
    asked = spark.read.parquet(f"{small}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text").filter("qid < 8")
    asked = asked.unionAll(docs.filter("docid % 40 = 0").select(F.col("docid") + 1000, F.substring("text", 1, 200)))
    kept = index.build(docs, f"{tmp_path}/index", block=block, parts=4)
    hits, counted = index.search_counted(kept, asked, 5, first)
    assert rows(hits) == rows(top_k(retrieval.bm25(asked, docs), 5).select("qid", "docid", "score", "rank"))
    work = {r["kind"]: r for r in counted.collect()}
    assert 0 < work["scored"]["rows"] <= work["all"]["rows"]
    if block == 2:
        assert work["scored"]["blocks"] < work["all"]["blocks"]


def test_config_files_are_the_defaults(spark, tmp_path):
    for module in (daily_scores, search_report):
        path = ROOT / "jobs" / f"{module.__name__.split('.')[-1]}.json"
        assert read_config(spark, module.Config, str(path)) == module.Config()
    (tmp_path / "bad.json").write_text(json.dumps({"treshold": 1}))
    with pytest.raises(ValueError, match="treshold"):
        read_config(spark, daily_scores.Config, str(tmp_path / "bad.json"))


def test_command_line(small, tmp_path):
    args = ["-m", "jobs.daily_scores", "--source", f"{small}/events.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", "jobs/daily_scores.json"]
    done = subprocess.run([sys.executable, *args], cwd=ROOT, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read" in done.stderr and list(Path(f"{tmp_path}/out/scores").glob("day=*/*.parquet"))


def test_jobs_import_nothing_of_the_training_data_part():
    for path in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in names)
