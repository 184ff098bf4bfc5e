"""The larger flows on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from toolweave.plans import evaluate, extend

FUNCTIONS = json.dumps([{"name": "f", "parameters": {"properties": {"s": {"type": "string"}}, "required": ["s"]}}])


def test_evaluation(spark):
    ids = ["normal_atom_bool_0", "normal_atom_bool_1", "normal_multi_turn_user_adjust_0_0", "normal_multi_turn_user_adjust_0_1", "normal_multi_turn_user_adjust_1_0"]
    cases = spark.createDataFrame([(i, FUNCTIONS) for i in ids], "id string, functions_json string")
    answers = spark.createDataFrame([(i, '[{"f": {"s": "no"}}, {"f": {"s": "a"}}]' if i.endswith("bool_0") else '{"f": {"s": "a"}}') for i in ids], "id string, ground_truth string")
    results = spark.createDataFrame([(ids[0], "[f(s='a')]"), (ids[1], "[f("), (ids[2], "[ f( s = 'A' ) ]"), (ids[3], "[f(s='b')]"), (ids[4], "[f(s='a')]")], "id string, result string")
    checked = evaluate.evaluate_calls(cases, results, answers)
    got = {r.id: (r.valid, r.error_type) for r in checked.collect()}
    assert got == {ids[0]: (True, None), ids[1]: (False, "wrong_output_format"), ids[2]: (True, None), ids[3]: (False, "value_error:string"), ids[4]: (True, None)}
    single = {r.category: (r.accuracy, r.correct_count, r.total_count) for r in evaluate.single_turn_scores(checked).collect()}
    assert single["normal_atom_bool"] == (0.5, 1, 2)
    multi = {r.category: (r.accuracy, r["process"], r.sessions) for r in evaluate.multi_turn_scores(checked.filter(F.col("id").contains("multi"))).collect()}
    assert multi == {"normal_multi_turn_user_adjust": (0.5, 0.75, 2)}
    ordered = checked.filter(F.col("id").contains("multi")).withColumn("ordinal", F.element_at(F.array(F.lit(0), F.lit(2), F.lit(1)), F.expr("case when id like '%0_0' then 1 when id like '%0_1' then 2 else 3 end")))
    assert evaluate.run_scores(ordered).first().sessions == 3
    assert evaluate.failed_rows(checked).count() == 2
    assert {(r.id, r.only_in) for r in evaluate.unmatched(cases.limit(5), results.filter(F.col("id") != ids[0])).collect()} == {(ids[0], "left")}


def test_special_and_agents(spark):
    answers = spark.createDataFrame([("a", "incomplete", "f", [" p "]), ("b", "incomplete", "f", ["p"]), ("c", "error_param", "", ["9"]), ("d", "irrelevant", "", [])], "id string, kind string, name string, values array<string>")
    results = spark.createDataFrame([("a", "Missing necessary parameters (p) for the api (f)"), ("b", "f p"), ("c", "There is incorrect value (8)")], "id string, result string")
    assert {r.id: (r.valid, r.error_type) for r in evaluate.evaluate_special(results, answers).collect()} == {"a": (True, None), "b": (False, "error_detection"), "c": (False, "error_correction"), "d": (False, "error_detection")}
    want = spark.createDataFrame([("agent_multi_step_0", '{"A": {"x": 1}}', [["p", "q"], ["r"]]), ("agent_multi_step_1", '{"A": {"x": 1}}', [["p", "q"]])], "id string, state_json string, milestones array<array<string>>")
    got = spark.createDataFrame([("agent_multi_step_0", '{"A": {"x": 1}}', ["z"]), ("agent_multi_step_1", '{"A": {"x": 2}}', ["p", "z"])], "id string, state_json string, process array<string>")
    checked = evaluate.evaluate_agents(got, want)
    assert {r.id[-1]: (r.valid, r["process"]) for r in checked.collect()} == {"0": (True, 1.0), "1": (False, 0.5)}
    r = evaluate.agent_scores(checked).first()
    assert (r.category, r.accuracy, r.process_accuracy, r.total_count) == ("agent_multi_step", 0.5, 0.75, 2)


def test_extension(spark):
    fn = "array<struct<name:string,json:string>>"
    cases = spark.createDataFrame([(0, 0, [("get.a", "A"), ("b", "B")]), (1, 1, [("c", "C"), ("b", "B2")])], f"qid int, ordinal int, functions {fn}")
    corpus = extend.build_corpus(cases)
    assert sorted((r.docid, r.name, r.document_content) for r in corpus.collect()) == [(0, "get.a", "A"), (1, "b", "B2"), (2, "c", "C")]
    answers = spark.createDataFrame([(0, ['{"a": {}, "c": {}}']), (1, ['{"c_2": {}}', '{"zz": {}}'])], "qid int, alternatives array<string>")
    assert sorted((r.qid, r.docid) for r in extend.build_qrels(answers, corpus).collect()) == [(0, 0), (1, 2)]
    assert sorted((r.qid, r.docid) for r in extend.build_qrels(answers, corpus, exact=True, all_functions=True).collect()) == [(0, 0), (0, 2)]
    hits = spark.createDataFrame([(0, 9, 1), (0, 2, 2), (0, 1, 3), (1, 0, 1)], "qid int, docid long, rank int")
    verdicts = spark.createDataFrame([(1, "get.a", "1")], "qid int, candidate string, verdict string")
    out = {(r.qid, r.target): [f.name for f in r.functions] for r in extend.extend_cases(cases.drop("ordinal"), hits, corpus, verdicts, targets=[2, 3]).collect()}
    assert out == {(0, 2): ["get.a", "b"], (0, 3): ["get.a", "b", "c"], (1, 2): ["c", "b"], (1, 3): ["c", "b"]}


def test_retrievers(spark):
    corpus = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate([("alpha beta", [1.0, 0.0]), ("gamma", [0.0, 1.0]), ("alpha", [0.6, 0.8])])], "docid long, text string, embedding array<double>")
    queries = spark.createDataFrame([(100, "gamma", [0.0, 1.0])], "qid long, text string, embedding array<double>")
    for kind in ("bm25", "TF-IDF", "dense", "hybrid", "reranker"):
        assert extend.retrieve(kind, queries, corpus, 2).orderBy("rank").first().docid == 1, kind
    with pytest.raises(ValueError):
        extend.retrieve("none", queries, corpus)


def test_try_check_retry(spark):
    cases = spark.createDataFrame([("x", "find the red cat", [("cat", "find a cat by colour", "{}"), ("dog", "walk a dog", "{}"), ("cow", None, '{"name": "cow"}')])], "id string, question string, functions array<struct<name:string,description:string,json:string>>")
    groups = {r.group_id: [f.name for f in r.functions] for r in extend.divide(cases, 2).collect()}
    assert groups[0][0] == "cat" and sorted(groups) == [0, 1, 2]
    declared = spark.createDataFrame([("x", "cat", ["colour", "size"], ["colour"]), ("x", "dog", ["pace"], [])], "id string, name string, declared array<string>, required array<string>")
    first = spark.createDataFrame([("x", 0, "[cat(size=1)]"), ("x", 1, "<think>t</think>\n\n[dog(leash=true), cow()]")], "id string, group_id int, text string")
    second = spark.createDataFrame([("x", "[cat(colour='red')]")], "id string, text string")
    r = extend.try_check_retry(cases, declared, first, second, k=2).first()
    assert ([f.name for f in r.functions], r.hints, r.result) == (["cat", "dog"], ["cat: missing colour", "dog: not declared leash"], "[cat(colour='red')]")
