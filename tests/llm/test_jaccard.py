"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolweave.llm import jaccard

LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(texts, shingle):
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        yield frozenset([tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [tuple(w)] if w else [])


def all_pairs(rows, shingle=4, percent=85):
    sets = list(sets_of([t for _, t in rows], shingle))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    seen = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in seen[x])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            seen[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def copies(seed, sizes, crowd):
    """Texts in groups of near copies, with a few words changed, mostly at the end."""
    rng = random.Random(seed)
    words, rows = [f"w{i}" for i in range(2000)], []
    for size in sizes:
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(rng.choice(crowd)):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(size) if rng.random() < 0.6 else -1] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(text)))
    return rows


ODD = [(None, "no id but six words here"), (5, None), (6, ""), (7, " \n\t"), (8, "a b"), (9, "A B"), (10, "a b"), (3, "no id but six words here"), (3, "no id but six words here"), (11, "ÀÉ été 日本語 😀 x"), (12, "x" * 200_000), (13, "lorem ipsum dolor " * 30_000)]


@pytest.mark.parametrize("chunk", [1 << 20, 1500])
def test_components_equal_all_pairs(spark, monkeypatch, chunk):
    """Chunks of about six sets make cells of several chunks, and members outside the main component."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = copies(3, [5, 8, 14, 14, 17, 25, 25, 60, 60, 150, 400], [2, 6, 30]) + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name in ("n", "row", "key", "node", "cell", "id", "row_key"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = jaccard.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == all_pairs(rows)
    assert jaccard.jaccard_components(docs.filter("false")).count() == 0


def test_other_similarity_and_ids(spark):
    rows = [(f"d{i}", t) for i, t in copies(8, [6, 10, 30, 80], [3, 12])]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id string, text string"), shingle=2, percent=70)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == all_pairs(rows, 2, 70)


@pytest.mark.parametrize("percent", [60, 85, 95])
def test_linked_sets_share_a_key(percent):
    """Whatever the sizes: sets at the threshold agree on one key at least."""
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        keep = int(rng.integers(1, n + 1))
        x, y = np.unique(pool[:n]), np.unique(np.append(pool[:keep], pool[n : n + int(rng.integers(0, n))]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= percent * (len(x) + len(y) - common) and len(np.union1d(x, y)) != common:
            assert np.intersect1d(jaccard.block_keys(x, percent), jaccard.block_keys(y, percent)).size


@pytest.mark.parametrize("seed", range(4))
def test_tree_drops_no_link(seed):
    sets = [np.unique(s) for s in near_sets(seed)]
    tree = jaccard.CountTree(sets, 64, 3)
    found = {(int(tree.order[a]), int(tree.order[b])) for *_, left, right in jaccard.joined(tree, tree, 85, True) for a, b in zip(left, right, strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                assert (i, j) in found or (j, i) in found


def near_sets(seed):
    rng = np.random.default_rng(seed)
    for _ in range(12):
        base = rng.integers(0, 2**63, int(rng.integers(3, 200)), dtype=np.uint64)
        for _ in range(10):
            changed = base.copy()
            changed[rng.integers(0, len(base), max(1, len(base) // 12))] = rng.integers(0, 2**63, dtype=np.uint64)
            yield changed
