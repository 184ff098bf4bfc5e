"""Evaluation of special and agent categories beside those of calls."""

from __future__ import annotations

import json

from toolweave.plans import commands

GOLDEN = [
    ("special_incomplete_0", {"book": ["seat ", " day"]}, "Missing necessary parameters (seat, day) for book", None),
    ("special_incomplete_1", {"book": ["seat"]}, "Missing necessary parameters (row) for book", "error_correction"),
    ("special_error_param_0", {"a": ["x1"], "b": ["y2"]}, "There is incorrect value: x1", "error_correction"),
    ("special_error_param_1", {"a": ["x1"]}, "There is incorrect value: x1", None),
    ("special_irrelevant_0", "Due to the limitations of the function, I cannot solve this problem.", "Due to the limitations of the function", None),
    ("special_irrelevant_1", "Due to the limitations of the function, I cannot solve this problem.", None, "error_detection"),
    ("agent_multi_step_0", [{"Box": {"n": 1}}, {"Lid": {"open": True}}], [{"Lid": {"open": True}}, {"Box": {"n": 1}}], None),
    ("agent_multi_step_1", [{"Box": {"n": 1}}], [{"Box": {"n": 2}}], "wrong_end_state"),
    ("agent_multi_turn_0", {"Box": {"n": 1}}, [{"Box": {"n": 1}}], None),
    ("normal_atom_bool_0", {"stop": {"s": "now"}}, "[stop(s='now')]", None),
]
STONES = {"agent_multi_step_0": [["a"]], "agent_multi_step_1": [["a", "b"], ["c", "d", "e", "a"]], "agent_multi_turn_0": ["a"]}


def test_every_kind_is_routed(spark, tmp_path):
    function = {"name": "stop", "description": "", "parameters": {"properties": {"s": {"type": "string"}}, "required": ["s"]}}
    write = lambda name, rows: (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    write("cases.json", [{"id": i, "question": "q", "function": [function]} for i, *_ in GOLDEN])
    write("answers.json", [{"id": i, "ground_truth": g} | ({"mile_stone": STONES[i]} if i in STONES else {}) for i, g, *_ in GOLDEN])
    write("results.json", [{"id": i, "result": r, "process": ["c", "d", "x"]} for i, _, r, _ in GOLDEN if r is not None])
    at = lambda name: str(tmp_path / name)
    summary = commands.evaluate_model(spark, "m", at("cases.json"), at("results.json"), at("answers.json"), at("scores"))
    assert {r.category: (r.accuracy, r.process_accuracy, r.total_count) for r in summary.collect()} == {
        "special_incomplete": (0.5, None, 2), "special_error_param": (0.5, None, 2), "special_irrelevant": (0.5, None, 2),
        "agent_multi_step": (0.5, 0.75, 2), "agent_multi_turn": (1.0, 1.0, 1), "normal_atom_bool": (1.0, None, 1),
    }
    failures = {r.id: r.error_type for r in spark.read.json(at("scores/m/failures")).collect()}
    assert failures == {i: e for i, *_, e in GOLDEN if e}
