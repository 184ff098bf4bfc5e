"""Containment by automaton against ``in`` for every pair."""

from __future__ import annotations

import random

import pytest

from toolweave.operators import containment


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_first_contained(spark, monkeypatch, block):
    """One block and many: overlapping, repeated, empty and null names, null, empty and long texts."""
    monkeypatch.setattr(containment, "BLOCK_CHARS", block)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé_") for _ in range(n))
    names = [(i % 70, word(rng.randrange(1, 6))) for i in range(100)] + [(500, "zzz"), (3, None), (501, "not there")]
    texts = [(i, word(rng.randrange(0, 40))) for i in range(60)] + [(100, None), (101, ""), (102, "x" * 100_000 + "zzz"), (103, "xyz")]
    for extra in ([], [(2, "")]):
        got = containment.first_contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names + extra, "docid long, name string"))
        want = []
        for i, t in texts:
            inside = {}
            for d, n in names + extra:
                if n is not None and t is not None and n in t:
                    inside[n] = min(d, inside.get(n, d))
            want.append((i, *min(((d, n) for n, d in inside.items()), default=(None, None)), len(inside)))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_empty_tables(spark):
    texts, names = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "docid long, name string")
    assert [tuple(r) for r in containment.first_contained(texts, names).collect()] == [(1, None, None, 0)]
    assert containment.first_contained(texts.filter("false"), names).count() == 0
