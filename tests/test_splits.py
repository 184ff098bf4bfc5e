"""Records over splits against readers that take a whole file at once."""

from __future__ import annotations

import csv
import json
import random

import pytest

from toolweave.sources import readers
from toolweave.sources.splits import cut_records, json_pieces, quoted_pieces

TEXTS = ["plain", 'quote " and , comma', "back\\slash \\", "brackets ]}[{", "tab\tand\nline", "", "é 日本 😀", '\\"', "a,b,c," * 30, '"""']


@pytest.fixture
def tiny_splits(spark):
    """Splits of 701 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "701b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def elements(seed, n):
    rng = random.Random(seed)
    return [{"name": f"f{i}", "text": rng.choice(TEXTS), "tags": [rng.choice(TEXTS) for _ in range(rng.randrange(3))], "deep": {"a": [{"b": rng.choice(TEXTS)}, []]}} for i in range(n)]


@pytest.mark.parametrize("style", [{}, {"ensure_ascii": False}, {"indent": 1}, {"separators": (",", ":")}])
def test_json_array_in_splits(spark, tiny_splits, tmp_path, style):
    rows = elements(len(style), 60)
    (tmp_path / "a.json").write_text(json.dumps(rows, **style))
    got = readers.read_json_array(spark, str(tmp_path / "a.json"), "name string, text string, tags array<string>, deep string")
    found = sorted(got.collect(), key=lambda r: r["ordinal"])
    assert [(r["ordinal"], r["name"], r["text"], r["tags"], json.loads(r["deep"])) for r in found] == [(i, r["name"], r["text"], r["tags"], r["deep"]) for i, r in enumerate(rows)]
    pieces = json_pieces(spark, str(tmp_path / "a.json"))
    assert pieces.select("split").distinct().count() > 5
    raw = {r["record"]: r["value"] for r in cut_records(pieces, ",", arrays=True).collect()}
    assert json.loads(",".join(raw[k] for k in sorted(raw))) == rows


def test_json_arrays_odd_files(spark, tiny_splits, tmp_path):
    """Empty arrays, one object, one element, nulls, byte order mark, one long string, several files."""
    files = {"a": "[]", "b": " [ ] ", "c": '{"x": 1, "y": "2,3"}', "d": '[{"x": 5}]', "e": '[null, {"x": 6}, 7]', "f": '﻿[{"x": 8, "y": "a"}]\n', "g": json.dumps([{"x": 9, "y": "[,]\\" * 200}, {"x": 10, "y": None}]), "h": ""}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = [(r["file"].rpartition("/")[2][0], r["ordinal"], r["x"], r["y"]) for r in readers.read_json_array(spark, f"{tmp_path}/*.json", "x int, y string").collect()]
    want = [("c", 0, 1, "2,3"), ("d", 0, 5, None), ("e", 0, None, None), ("e", 1, 6, None), ("e", 2, None, None), ("f", 0, 8, "a"), ("g", 0, 9, "[,]\\" * 200), ("g", 1, 10, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_table_in_splits(spark, tiny_splits, tmp_path, ending):
    rng = random.Random(4)
    texts = [rng.choice(TEXTS[:2] + TEXTS[3:5] + TEXTS[6:]) + str(i) for i in range(80)]
    with (tmp_path / "corpus.tsv").open("w", newline="") as f:
        out = csv.writer(f, delimiter="\t", lineterminator=ending)
        out.writerow(["docid", "document_content"])
        out.writerows((i % 50, t) for i, t in enumerate(texts))
    path = str(tmp_path / "corpus.tsv")
    assert quoted_pieces(spark, path).rdd.getNumPartitions() > 2
    assert sorted(map(tuple, readers.read_corpus(spark, path).collect())) == sorted((i % 50, t) for i, t in enumerate(texts))
    last = {i % 50: t for i, t in enumerate(texts)}
    assert dict(map(tuple, readers.read_corpus(spark, path, last_wins=True).collect())) == last


def test_quoted_queries(spark, tiny_splits, tmp_path):
    (tmp_path / "q.tsv").write_text('1\t"a ""b"" c"\n\n2\t"line\nfeed\n\ntwo"\n3\tplain')
    assert sorted(map(tuple, readers.read_queries(spark, str(tmp_path / "q.tsv")).collect())) == [(1, 'a "b" c'), (2, "line\nfeed\n\ntwo"), (3, "plain")]
