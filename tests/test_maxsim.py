"""Late interaction through the kept index against every document."""

from __future__ import annotations

import numpy as np
import pytest

from toolweave.operators import maxsim

KIND = "vectors array<array<double>>"


def clustered(seed, docs, width):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(8, width))
    return [(i, (middles[i % 8] + 0.2 * rng.normal(size=(int(rng.integers(1, 5)), width))).tolist()) for i in range(docs)]


def ranked(queries, docs, k, others_only=False):
    out = []
    for q, a in queries:
        hits = [(-round(sum(max(float(np.dot(x, y)) for y in b) for x in a), 6), d) for d, b in docs if not (others_only and d == q)]
        out += [(q, d, -s, r + 1) for r, (s, d) in enumerate(sorted(hits)[:k])]
    return sorted(out)


def found(hits):
    return sorted((r["qid"], r["docid"], r["score"], r["rank"]) for r in hits.collect())


def same(got, want):
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)


@pytest.mark.parametrize(("width", "centroids", "k"), [(4, 8, 3), (16, None, 10), (16, 1, 10), (8, 16, 1000)])
def test_hits_equal_all_documents(spark, tmp_path, monkeypatch, width, centroids, k):
    """Small blocks of queries and products; a k beyond the corpus gives it all."""
    monkeypatch.setattr(maxsim, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(maxsim, "PRODUCTS", 500)
    docs = clustered(width, 120, width)
    asked = docs[::20]
    kept = maxsim.build(spark.createDataFrame(docs, f"docid long, {KIND}").repartition(3), f"{tmp_path}/index", centroids)
    queries = spark.createDataFrame(asked, f"qid long, {KIND}")
    for others_only in (False, True):
        same(found(maxsim.search(kept, queries, k, others_only, first_lists=1)), ranked(asked, docs, k, others_only))


def test_most_documents_stay_unread(spark, tmp_path):
    docs = clustered(1, 400, 16)
    kept = maxsim.build(spark.createDataFrame(docs, f"docid long, {KIND}"), f"{tmp_path}/index", 8)
    hits, counted = maxsim.search_counted(kept, spark.createDataFrame(docs[:1], f"qid long, {KIND}"), 5, first_lists=1)
    same(found(hits), ranked(docs[:1], docs, 5))
    n = {r["kind"]: r["n"] for r in counted.collect()}
    assert n["pairs"] == 400 and n["scored"] < 40 and n["codes"] < n["vectors"] / 2


def test_odd_rows(spark, tmp_path):
    """Null and empty vectors, ties, zero vectors, an empty corpus, a query set without vectors; a rebuilt index replaces the old."""
    docs = [(1, [[1.0, 0.0]]), (2, None), (3, []), (4, [None, [1.0, 0.0]]), (5, [[0.0, 0.0]]), (None, [[9.0, 9.0]]), (6, [[-1.0, 0.0], [0.0, 2.0]])]
    asked = [(7, [[1.0, 0.0], [0.0, 1.0]]), (8, None), (9, [])]
    corpus, queries = spark.createDataFrame(docs, f"docid long, {KIND}"), spark.createDataFrame(asked, f"qid long, {KIND}")
    usable = [(1, docs[0][1]), (4, [[1.0, 0.0]]), (5, docs[4][1]), (6, docs[6][1])]
    kept = maxsim.build(corpus, f"{tmp_path}/index")
    same(found(maxsim.search(kept, queries, 3)), ranked(asked[:1], usable, 3))
    assert maxsim.search(kept, queries.filter("qid > 7"), 3).count() == 0
    empty = maxsim.build(corpus.filter("false"), f"{tmp_path}/index")
    assert maxsim.search(empty, queries, 3).count() == 0


def test_the_first_look_hands_on_k_documents_a_query_and_task(spark, tmp_path, monkeypatch):
    """Before, each product handed on k documents, and the driver held a number per query vector and entry of a list."""
    monkeypatch.setattr(maxsim, "PRODUCTS", 50)
    docs = clustered(3, 300, 4)
    kept = maxsim.build(spark.createDataFrame(docs, f"docid long, {KIND}"), f"{tmp_path}/index", 6)
    q = next(maxsim.blocks_of(spark.createDataFrame(docs[::60], f"qid long, {KIND}")))
    codes = kept.table("codes").repartition(2)
    looked = maxsim._scan(codes, q, kept.centroids(), None, 3, False).groupBy("qid").count().collect()
    assert len(looked) == 5 and max(r["count"] for r in looked) <= 3 * 2
    assert not hasattr(maxsim, "list_bounds")
