"""The search job shuffles no text of an id that comes once."""

from __future__ import annotations

from jobs import search_report


def test_only_repeated_ids_are_grouped(spark):
    docs = spark.createDataFrame([(1, "b", "en"), (1, "c", "de"), (2, None, "en"), (2, "a", "xx"), (3, None, "none"), (4, "z", "en")], "docid long, text string, lang string")
    out = search_report.once(docs)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, "c", "de"), (2, "a", "xx"), (3, None, "none"), (4, "z", "en")]
    unique = search_report.once(docs.filter("docid > 2"))
    assert sorted(r["docid"] for r in unique.collect()) == [3, 4]
    # what is left after the anti join is handed on as it lies
    above = out._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[0]
    assert "LeftAnti" in out._jdf.queryExecution().toString() and "Aggregate" not in above
