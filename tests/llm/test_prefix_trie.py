"""The prefix trie against a dictionary of prefixes, its parts against loops."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolweave.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string"


def by_prefixes(rows):
    given = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            given[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [v[2:] for v in sorted(s)] for c, s in given.items()}
    rebuilt = {}
    for c, s in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h]) + tuple(s[h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, longest):
    """Conversations of a few kinds that part late or never, with null turns, roles and texts and repeated rows."""
    rng, rows = random.Random(seed), []
    for c in range(-7, 60):
        n, kind, own = rng.choice([1, 2, 3, 9, 12, longest]), rng.randrange(3), rng.choice([0, 1, 2, 9])
        for k in range(n):
            text = f"t{kind}-{k}" if k < n - own else f"u{rng.randrange(4)}é"
            rows.append((c, k if rng.random() < 0.95 else None, "user" if k % 2 else None, text if rng.random() < 0.98 else None))
    return [*rows, (None, 1, "a", "b"), (3, 0, "user", "x"), (3, 0, "user", "x"), (3, 1, "user", "long " * 100_000)]


@pytest.mark.parametrize(("block", "segment"), [(1 << 16, 64), (3, 64), (7, 4)])
def test_trie_equals_prefixes(spark, monkeypatch, block, segment):
    """Blocks of three and seven make intervals that cross blocks, segments of four several rounds of sorting."""
    monkeypatch.setattr(prefixtrie, "SEGMENT", segment)
    monkeypatch.setattr(prefixtrie, "RUN", 3)
    rows = talks(segment, 70)
    table = spark.createDataFrame(rows, KIND).repartition(5)
    for name in ("conv", "at", "depth", "rep", "n", "h1", "left"):
        table = table.withColumn(name, F.lit("clash"))
    got = prefixtrie.conversation_trie(table, block=block)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == by_prefixes(rows)


def test_small_tables(spark):
    table = spark.createDataFrame([], KIND)
    assert prefixtrie.conversation_trie(table).count() == 0
    for rows in ([(4, 0, "a", "b")], [(5, None, None, None)], [(5, 0, "u", "x"), (6, 0, "u", "x"), (7, 0, "u", "x")]):
        got = prefixtrie.conversation_trie(spark.createDataFrame(rows, KIND))
        assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == by_prefixes(rows)


def test_nearest_smaller_values():
    for seed in range(20):
        values = np.random.default_rng(seed).integers(0, 6, 40).tolist()
        left, right = prefixtrie.nearest_smaller(values)
        for k, v in enumerate(values):
            assert left[k] == max((i for i in range(k) if values[i] < v), default=-1)
            assert right[k] == min((i for i in range(k + 1, 40) if values[i] < v), default=40)


def test_range_minima():
    values = np.random.default_rng(1).integers(0, 100, 37)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(37), np.arange(1, 38)))
    got = prefixtrie.RangeMinima(values).least(a, b)
    want = [values[i:j].min() if i < j else np.iinfo(np.int64).max for i, j in zip(a, b, strict=True)]
    assert got.tolist() == want


def test_copies_are_counted(spark):
    """A third of all conversations are equal; their ids make one digest."""
    rows = [(c * 5, k, "user", f"same {k}") for c in range(300) for k in range(10)] + [(c * 5, 0, "user", f"own {c}") for c in range(300, 900)]
    got = prefixtrie.conversation_trie(spark.createDataFrame(rows, KIND), block=64)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == by_prefixes(rows)
