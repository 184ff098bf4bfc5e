"""Texts of a crowd that agree on nothing finer than the crowd's key are compared all the same."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pytest

from toolweave.llm import neardup
from toolweave.llm.components import connected_components


def node(i):
    return bytearray(hashlib.md5(str(i).encode()).digest())


@pytest.fixture
def crowd(spark, monkeypatch):
    """40 texts with one key in common: texts 2k and 2k + 1 are equal in their shingles, others share none."""
    monkeypatch.setattr(neardup, "GROUP", 8)
    rng = np.random.default_rng(2)
    fp = rng.integers(-(2**63), 2**63 - 1, 20)
    sets = [np.sort(rng.choice(2**32, 30, replace=False)).astype("<u4").tobytes() for _ in range(20)]
    prints = spark.createDataFrame([(node(i), int(fp[i // 2]), bytearray(sets[i // 2])) for i in range(40)], "node binary, fp bigint, shingles binary")
    nodes = spark.createDataFrame([(node(i), [[7, 100 + i]]) for i in range(40)], "node binary, levels array<array<bigint>>")
    return prints, nodes


def test_links_of_a_crowd(crowd):
    roots = {bytes(r.node): bytes(r.root) for r in connected_components(neardup.near_duplicate_links(*crowd, neardup.BUDGET, neardup.SIMILARITY)).collect()}
    assert len(roots) == 40 and len(set(roots.values())) == 20
    assert all(roots[bytes(node(2 * k))] == roots[bytes(node(2 * k + 1))] for k in range(20))


def test_blocks_hold_every_pair_that_is_apart(spark, crowd):
    crowds = neardup.key_groups(crowd[1])[2]
    roots = spark.createDataFrame([(node(i), node(0)) for i in range(30)], "node binary, root binary")
    for known, apart in [(roots.limit(0), 0), (roots, 30)]:
        blocks: dict[int, list[bytes]] = {}
        for r in neardup.crowd_blocks(crowds, known).collect():
            blocks.setdefault(r.key, []).append(bytes(r.node))
        met = {frozenset(p) for b in blocks.values() for p in combinations(b, 2)}
        assert all(frozenset((bytes(node(i)), bytes(node(j)))) in met for i, j in combinations(range(40), 2) if j >= apart)
        assert max(map(len, blocks.values())) < 32
    assert neardup.crowd_blocks(crowds, spark.createDataFrame([(node(i), node(0)) for i in range(40)], "node binary, root binary")).count() == 0
