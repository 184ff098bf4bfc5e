"""Readers, writers and the result stream on small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolweave.sources import readers, shared, writers
from toolweave.streaming import results


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "n": 5, "f": {"z": 1, "a": 2}}\n\n{"id": "é"}\n')
    (tmp_path / "b.json").write_text('{"id": "y"}\nbroken\n{"id": "lost"}\n')
    rows = readers.read_json_lines(spark, str(tmp_path / "*.json"), {"id": "string", "n": "int", "f": "json"}).orderBy("file", "ordinal").collect()
    assert [(r.ordinal, r.id, r.n, r.f) for r in rows] == [(0, "x", 5, '{"z":1,"a":2}'), (2, "é", None, None), (0, "y", None, None)]
    assert readers.read_existing_json_lines(spark, [str(tmp_path / "none*.json")], {"id": "string"}).count() == 0
    writers.write_json_lines(spark.createDataFrame([("é", 1)], "id string, n int"), str(tmp_path / "out"), single=True)
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"id":"é","n":1}'


def test_json_array_and_tsv(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"system": "s1", "query": "q"}, {"system": "s2"}]')
    assert [(r.ordinal, r.system, r.query) for r in readers.read_json_array(spark, str(tmp_path / "a.json"), "system:string,query:string").orderBy("ordinal").collect()] == [(0, "s1", "q"), (1, "s2", None)]
    corpus = spark.createDataFrame([(0, '{"a": "x\ty"}'), (1, "plain")], "docid int, document_content string")
    writers.write_tsv(corpus, str(tmp_path / "corpus"), single=True)
    assert sorted(readers.read_corpus(spark, str(tmp_path / "corpus")).collect()) == sorted(corpus.collect())
    queries = spark.createDataFrame([(0, 'say "hi"')], "qid int, query string")
    writers.write_tsv(queries, str(tmp_path / "q"), single=True)
    assert readers.read_queries(spark, str(tmp_path / "q")).collect() == queries.collect()
    (tmp_path / "qrels.tsv").write_text("1\t0\t5\t1\n1\t0\t5\t1\n2\t0\t6\t1\n")
    assert readers.read_qrels(spark, str(tmp_path / "qrels.tsv")).count() == 2


def test_scores_subsets_and_sink(spark, tmp_path):
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1/data_normal_atom_bool_score.json").write_text('{"accuracy": 0.5, "total_count": 4}\n{"id": "failed"}\n')
    (tmp_path / "m1/data_agent_process_score.json").write_text('{"accuracy": 0.1}\n')
    assert [(r.model, r.category, r.accuracy, r.total_count) for r in readers.read_scores(spark, str(tmp_path)).collect()] == [("m1", "normal_atom_bool", 0.5, 4)]
    (tmp_path / "r/s/t").mkdir(parents=True)
    (tmp_path / "r/s/t/test.query.txt").write_text('0\t"a b"\n1\tc\n')
    assert sorted((r.subset, r.qid, r["query"]) for r in readers.subsets(spark, str(tmp_path / "r")).collect()) == [("s/t", 0, "a b"), ("s/t", 1, "c")]
    done = spark.createDataFrame([("normal_atom_bool_10", "r"), ("normal_atom_bool_9", "r"), ("normal_multi_turn_user_adjust_2_1", "r")], "id string, result string")
    writers.append_results(done, str(tmp_path / "res"))
    assert {r.category for r in spark.read.json(str(tmp_path / "res")).select("category").collect()} == {"normal_atom_bool", "normal_multi_turn_user_adjust"}
    assert [r.id for r in writers.sorted_results(done).collect()][:2] == ["normal_atom_bool_9", "normal_atom_bool_10"]
    hits = spark.createDataFrame([(1, 7, 2), (1, 9, 1)], "qid int, docid int, rank int")
    assert writers.retrieval_results(hits).first().corpus_id_list == [9, 7]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": "x", "result": "r", "ts": "2024-01-01T00:00:00Z"}\n{"id": "x", "result": "r", "ts": "2024-01-01T00:00:01Z"}\n{"id": "y", "result": "rr", "ts": "2024-01-01T00:00:02Z"}\n')
    stream = results.result_stream(spark, str(tmp_path / "in"))
    q = results.score_stream(stream, lambda b: b.withColumn("n", F.length("result")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("x", 1), ("y", 2)]


def test_materialized_tables(spark):
    df = shared.materialize(spark.range(5), "x")
    assert df.count() == 5 and "toolweave-" in df.inputFiles()[0]
    shared.drop_tables(spark)
    assert shared.materialize(spark.range(3), "x").count() == 3
