"""Every retriever from the command line, over one prepared folder."""

from __future__ import annotations

import argparse

import pytest

from toolweave import __main__ as cli
from toolweave.plans import commands
from toolweave.sources import writers

DOCS = [(0, "open the door", [1.0, 0.0]), (1, "close the window", [0.0, 1.0]), (2, "paint a wall", [-1.0, 0.2]), (3, "no vector here", None)]
#: The query with id 1 asks for document 0, and that with id 0 for document 1: ids of both sides are unrelated.
ASKED = [(0, "close window", [0.1, 1.0]), (1, "open door", [1.0, 0.1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("retrievers"))
    for name, rows, key, text in (("corpus", DOCS, "docid", "document_content"), ("queries", ASKED, "qid", "query")):
        table = spark.createDataFrame(rows, f"{key} long, {text} string, embedding array<double>")
        writers.write_tsv(table.select(key, text), f"{root}/data/{name}", **({} if name == "corpus" else {"header": False}))
        table.filter("embedding is not null").selectExpr(key, "embedding", "array(embedding, array(0D, 0D)) AS vectors").write.parquet(f"{root}/vectors/{name}")
    qrels = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 0, 1)], "qid int, head int, docid int, label int")
    writers.write_tsv(qrels, f"{root}/data/qrels", header=False)
    return root


@pytest.mark.parametrize("kind", sorted(commands.RETRIEVERS))
def test_retriever(spark, folder, kind):
    args = ["retrieve", "--data", f"{folder}/data", "--output", f"{folder}/{kind}", "--retriever", kind, "--top-k", "5", "--vectors", f"{folder}/vectors"]
    a = cli.parser().parse_args(args)
    assert isinstance(a, argparse.Namespace)
    cli.run(spark, a)
    best = {r.qid: r.corpus_id_list[0] for r in spark.read.json(f"{folder}/{kind}/hits").collect()}
    assert best == {0: 1, 1: 0}
    assert spark.read.json(f"{folder}/{kind}/metrics").first().ndcg_5 == 1.0


def test_vectors_are_asked_for(spark, folder):
    with pytest.raises(ValueError, match="vectors"):
        commands.retrieve(spark, f"{folder}/data", f"{folder}/none", "colbert")
