"""Request bodies, calls with retries, workbooks, file finding."""

from __future__ import annotations

import io
import json
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toolweave.operators import requests, responses
from toolweave.plans import commands
from toolweave.sources import readers, workbooks


def test_calls_are_retried(spark):
    sent = []

    def shaky(body):
        sent.append(body)
        if len(sent) < 3:
            raise TimeoutError
        return "done"

    assert requests.with_retries(shaky, 5, 0.0)("b") == "done" and len(sent) == 3
    assert requests.with_retries(shaky, 5, 0.0)(None) is None and len(sent) == 3
    df = spark.createDataFrame([(1, "ok"), (2, "fail please"), (3, None)], "n int, said string")
    body = requests.chat_body("m", requests.messages_of(F.lit("be kind"), F.col("said")), temperature=0.5)
    rows = df.select("n", F.when(F.col("said").isNotNull(), body).alias("body"))
    got = {r.n: r for r in requests.call_service(rows, requests.echo, attempts=2, delay=0.0).withColumn("text", responses.completion_text("response")).collect()}
    assert json.loads(got[1].body) == {"model": "m", "messages": [{"role": "system", "content": "be kind"}, {"role": "user", "content": "ok"}], "temperature": 0.5}
    assert got[1].text.endswith("ok") and got[2].response is None and got[3].response is None
    assert requests.call_service(rows.filter("false"), requests.echo).count() == 0


def test_calls_keep_their_distance(spark):
    rows = spark.createDataFrame([("{}",)] * 4, "body string").coalesce(1)
    began = time.monotonic()
    assert requests.call_service(rows, lambda body: "x", per_minute=600).filter("response = 'x'").count() == 4
    assert time.monotonic() - began >= 0.3


def test_post_builder():
    send = requests.http_post("http://127.0.0.1:9/none", {"A": "b"}, timeout=0.2)
    with pytest.raises(OSError):
        send("{}")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.text(max_size=12), st.integers(-(10**9), 10**9), st.none() | st.floats(allow_nan=False, allow_infinity=False)), max_size=6))
def test_workbook_bytes(rows):
    got = workbooks.workbook_rows(workbooks.workbook_bytes(["a", "b & <c>", "x"], rows))
    clean = lambda t: workbooks._CONTROL.sub("", t.encode("utf-8", "replace").decode()).replace("\r\n", "\n").replace("\r", "\n")
    assert [(r["a"] if "a" in r else "", int(r["b & <c>"]), float(r["x"]) if "x" in r else None) for r in got] == [(clean(a), b, c) for a, b, c in rows]


def test_workbook_with_shared_texts():
    data = workbooks.workbook_bytes(["a"], [("x",)])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as new:
        for n in z.namelist():
            new.writestr(n, z.read(n).decode().replace('<c r="A2" t="inlineStr"><is><t xml:space="preserve">x</t></is></c>', '<c r="A2" t="s"><v>1</v></c>'))
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbooks.MAIN}"><si><t>no</t></si><si><r><t>y</t></r><r><t>es</t></r></si></sst>')
    assert workbooks.workbook_rows(out.getvalue()) == [{"a": "yes"}]
    assert [workbooks.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    with pytest.raises(ValueError):
        workbooks.workbook_bytes(["a"], [("x",)] * workbooks.ROWS)


def test_files_are_found(spark, tmp_path):
    for n in ("data_b_score.json", "data_a_score.json", "data_multi_turn_score.json", "other.txt"):
        (tmp_path / n).write_text("{}")
    assert [p.rsplit("/", 1)[1] for p in readers.find_files(spark, str(tmp_path), "score")] == ["data_a_score.json", "data_b_score.json"]
    assert len(readers.find_files(spark, str(tmp_path), "multi_turn")) == 1


def test_lines_of_split_files(spark, tmp_path):
    """Many splits and files give the ordinals of one pass; line ends of both kinds, no line end at the end."""
    for k in range(3):
        (tmp_path / f"{k}.txt").write_bytes(b"".join(b"line %d of %d%s" % (i, k, b"\r\n" if i % 2 else b"\n") for i in range(4000)) + b"\n  \nlast")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
        rows = readers.read_lines(spark, str(tmp_path), tolerant=False).collect()
        assert readers.read_lines(spark, str(tmp_path)).count() == 3 * 4001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file[-5], []).append((r.ordinal, r.value))
    for k, got in by_file.items():
        assert sorted(got) == [*((i, f"line {i} of {k}") for i in range(4000)), (4000, ""), (4001, "  "), (4002, "last")]


def test_examples_routes_devices_batches(spark):
    body = requests.messages_of(F.lit(None).cast("string"), F.lit("q"), [("a?", "a!"), ("b?", "b!")])
    assert [tuple(m) for m in spark.range(1).select(body.alias("m")).first().m] == [("user", "a?"), ("assistant", "a!"), ("user", "b?"), ("assistant", "b!"), ("user", "q")]
    assert requests.service_for("My-Echo-7b", {"other": len, "echo": requests.echo}) is requests.echo
    with pytest.raises(KeyError):
        requests.service_for("x", {})
    assert requests.most_free([3, 9, 9, 1], 3) == [1, 2, 0]
    assert [len(b) for b in readers.batches(spark.range(7), 3)] == [3, 3, 1] and list(readers.batches(spark.range(0), 3)) == []
    assert commands.result_path("r/", "m", "c") == "r/m/data_c_score.json"
