"""Flows do each row's work once, in tasks whose rows have a bound."""

from __future__ import annotations

from toolweave.operators import order
from toolweave.plans import extend, flows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cases_are_checked_once(spark, small):
    """The summary that is returned reads what was written; it doesn't check the cases again."""
    out = flows.evaluate_flow(spark, small)
    assert "EvalPython" not in plan(out) and {r["category"] for r in out.collect()} == {"normal_atom_number", "normal_multi_turn_user_adjust"}


def test_extending_deals_cases_into_parts_of_a_size(spark, monkeypatch):
    """Two hits of one name stay two, and tasks have few cases whatever the number of them."""
    monkeypatch.setattr(extend, "CASES_A_TASK", 4)
    cases = spark.createDataFrame([(q, [("x", "X")]) for q in range(40)], "qid long, functions array<struct<name:string,json:string>>")
    corpus = spark.createDataFrame([(1, "a", "A1"), (2, "a", "A2"), (3, "x", "X"), (4, "b", "B")], "docid long, name string, document_content string")
    hits = spark.createDataFrame([(q, d, r) for q in range(40) for r, d in enumerate([3, 1, 9, 2, 4])], "qid long, docid long, rank int")
    alike = spark.createDataFrame([(7, "a", " 2 "), (8, "a", "0")], "qid long, candidate string, verdict string")
    out = extend.extend_cases(cases, hits, corpus, alike, limit=3, targets=[1, 2, 9])
    assert out.rdd.getNumPartitions() == 10
    got = {(r["qid"], r["target"]): [f["json"] for f in r["functions"]] for r in out.collect()}
    assert len(got) == 120 and all(got[q, 1] == ["X"] for q in range(40))
    assert got[7, 9] == ["X"] and got[8, 9] == ["X", "A1", "A2"] and got[8, 2] == ["X", "A1"]


def test_dealt_parts(spark):
    assert order.dealt(spark.range(100), 100, "id", each=10).rdd.getNumPartitions() == 10
