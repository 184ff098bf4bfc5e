"""The learnt reranker: better than the dense order on queries it wasn't trained on."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from toolweave.operators import metrics, ranker, retrieval
from toolweave.plans import extend


def test_held_out_queries_gain(spark):
    """Noisy queries about topics, a topic's documents are wanted; half of the queries train, the rest is scored."""
    rng = np.random.default_rng(11)
    topics = rng.normal(size=(20, 16))
    docs = [(i, (topics[i % 20] + 0.6 * rng.normal(size=16)).tolist(), i % 20) for i in range(600)]
    queries = [(1000 + i, (topics[i % 20] + 0.9 * rng.normal(size=16)).tolist(), i % 20) for i in range(120)]
    corpus = spark.createDataFrame(docs, "docid long, embedding array<double>, topic int")
    asked = spark.createDataFrame(queries, "qid long, embedding array<double>, topic int")
    hits = ranker.features(retrieval.dense_top_k(asked, corpus, 50), corpus).persist()
    wanted = asked.select("qid", "topic").join(corpus.select("docid", "topic"), "topic").select("qid", "docid")
    learn = F.crc32(F.col("qid").cast("string")) % 2 == 0
    model = ranker.train(hits.filter(learn), wanted)
    held = retrieval.rerank(hits.filter(~learn), model.score(), depth=50)
    mean = lambda rows: rows.agg(F.avg("ndcg")).first()[0]
    before = mean(metrics.ndcg(hits.filter(~learn), wanted))
    after = mean(metrics.ndcg(held.select("qid", "docid", F.col("rerank_score").alias("score")), wanted))
    assert after > before + 0.01
    assert model == ranker.train(hits.filter(learn), wanted)
    hits.unpersist()


def test_weights_follow_the_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(ranker.NAMES)))
    rows = pd.DataFrame({"qid": np.arange(600) // 30, "features": list(x), "rel": (x[:, 3] > 0.5).astype(int)})
    w = np.array(ranker.fitted(rows).weights)
    assert np.argmax(np.abs(w)) == 3 and w[3] > 0


@pytest.mark.parametrize("rel", [0, 1])
def test_nothing_to_learn_from(rel):
    rows = pd.DataFrame({"qid": [1, 1], "features": [np.ones(len(ranker.NAMES)), np.zeros(len(ranker.NAMES))], "rel": [rel, rel]})
    assert ranker.fitted(rows).weights == (1.0, 0, 0, 0, 0, 0)
    assert ranker.fitted(rows.head(0)).weights == (1.0, 0, 0, 0, 0, 0)


def test_retriever_with_a_model(spark):
    """The reranker by a model that wants distant documents turns the dense order round."""
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.5]), (3, [0.0, 1.0])], "docid long, embedding array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, embedding array<double>")
    order = lambda model: [r.docid for r in extend.retrieve("reranker", queries, corpus, 3, model=model).orderBy("rerank_rank").collect()]
    assert order(None) == [1, 2, 3] and order(ranker.Ranker((-1.0, 0, 0, 0, 0, 0))) == [3, 2, 1]


def test_missing_vectors(spark):
    hits = spark.createDataFrame([(1, 5, 0.9, 0.1, 1), (1, 6, 0.5, None, 2)], "qid long, docid long, score double, distance double, rank int")
    got = {r.docid: r.features for r in ranker.features(hits, spark.createDataFrame([(5, [1.0, 0.0])], "docid long, embedding array<double>")).collect()}
    assert got[5] == pytest.approx([0.9, -0.1, 1.0, 1.0, 1.0, 1.0]) and got[6] == pytest.approx([0.5, 0.0, 0.5, 0.0, 0.0, 0.0])
