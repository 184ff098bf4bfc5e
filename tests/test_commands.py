"""The command line's steps, one after the other, on files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from toolweave import __main__ as cli
from toolweave.functions.calls import print_answers
from toolweave.functions.text import answer_type, document_text
from toolweave.operators.order import seeded_shuffle


def test_all_steps(spark, tmp_path, monkeypatch):
    function = lambda n, about: {"name": n, "description": about, "parameters": {"properties": {"s": {"type": "string"}}, "required": ["s"]}}
    cases = [
        {"id": "normal_atom_bool_0", "question": "weather in\nParis ", "function": [function("get.weather", "weather in a city"), function("stop", "stop it")]},
        {"id": "normal_atom_bool_1", "question": [[{"role": "user", "content": "stop "}, {"role": "user", "content": "now"}]], "function": function("stop", "stop it now")},
        {"id": "normal_multi_turn_user_adjust_0_0", "question": "x", "function": [function("stop", "stop it")]},
    ]
    answers = [{"id": c["id"], "ground_truth": g} for c, g in zip(cases, [{"get.weather": {"s": "paris"}}, [{"stop": {"s": "now"}}, {"stop": {"s": "at once"}}], {"stop": {"s": "x"}}], strict=True)]
    results = [{"id": cases[0]["id"], "result": "[get.weather(s='Paris')]"}, {"id": cases[1]["id"], "result": "[stop(s='at once')]"}, {"id": cases[2]["id"], "result": "[stop(s='y')]"}]
    for name, rows in (("cases", cases), ("answers", answers), ("results", results)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    at = lambda name: str(tmp_path / name)
    cli.main(["prepare", "--cases", at("cases.json"), "--answers", at("answers.json"), "--output", at("data")])
    assert sorted((r.docid, json.loads(r.document_content)["description"]) for r in spark.read.csv(at("data/corpus"), sep="\t", header=True, quote='"', escape='"', schema="docid int, document_content string").collect()) == [(0, "weather in a city"), (1, "stop it")]
    assert {(int(r._c0), int(r._c2)) for r in spark.read.csv(at("data/qrels"), sep="\t").collect()} == {(0, 0), (1, 1), (2, 1)}
    assert {r._c1 for r in spark.read.csv(at("data/queries"), sep="\t").collect()} == {"weather inParis", "stop now", "x"}
    cli.main(["retrieve", "--data", at("data"), "--output", at("out")])
    assert spark.read.json(at("out/metrics")).first().ndcg_5 is not None
    cli.main(["evaluate", "--model", "m", "--cases", at("cases.json"), "--results", at("results.json"), "--answers", at("answers.json"), "--output", at("scores")])
    summary = {r.category: (r.accuracy, r.total_count) for r in spark.read.json(at("scores/m/summary")).collect()}
    assert summary == {"normal_atom_bool": (1.0, 2), "normal_multi_turn_user_adjust": (0.0, 1)}
    assert spark.read.json(at("scores/m/failures")).count() == 1
    cli.main(["leaderboard", "--scores", at("scores")])


def test_small_functions(spark):
    df = spark.createDataFrame([('{"f": {"a": "x", "n": 1}}', ["a", "b", "c", "d"], "5", '""')], "g string, v array<string>, n string, e string")
    r = df.select(print_answers("g").alias("p"), seeded_shuffle(F.col("v")).alias("s"), answer_type(F.col("n")).alias("t"), answer_type(F.col("e")).alias("e"), document_text(F.col("n"), F.lit(None), F.col("e")).alias("d")).first()
    assert r.p == ["f(a='x', n=1)"] and r.s == ["c", "b", "d", "a"] and r.t == "BIGINT" and r.e is None and r.d == '5, , ""'
