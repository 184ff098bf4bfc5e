"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from toolweave.llm import decontaminate, htmltext, langid, lattice, media, neardup, packing, repeats, secrets, simhash, toxicity

LONG = "lorem ipsum dolor " * 4000
ROWS = [(1, "Password: hunter2222 some words here"), (1, "Password: hunter2222 some words here"), (2, None), (3, ""), (4, LONG), (5, "x" * 50_000), (None, "no id here"), (6, " \n\t "), (7, "été 日本語 😀 ÀÉ"), (8, "tie"), (9, "tie")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("id", "score", "fp", "key", "length", "rank", "word", "row", "label", "piece", "at", "salt", "n"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (4, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "a benchmark passage that is quite long enough to be cut into several segments of text")], "item_id long, text string")


def operators(labels, bench):
    true = F.lit(True)
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train_toxicity(d, labels, true)),
        "decontaminate": lambda d: decontaminate.benchmark_matches(d, bench),
        "repeats": repeats.repeated_passages,
        "lattice": lambda d: lattice.score_documents(d, F.col("doc_id") > 2),
        "html": lambda d: htmltext.extract_text(d, "doc_id", "text", keep=("source",)),
        "simhash": simhash.simhash_components,
        "media": media.media_digest,
        "media read": lambda d: media.media_columns(media.wrap_texts(d), "doc_id", "media"),
        "packing": packing.pack_documents,
        "secrets": secrets.secret_digest,
        "langid": lambda d: langid.identify_language(d, langid.train_language(d, true)),
    }


NAMES = ["toxicity", "decontaminate", "repeats", "lattice", "html", "simhash", "media", "media read", "packing", "secrets", "langid"]
PER_ROW = {"toxicity", "lattice", "html", "simhash", "media", "media read", "secrets", "langid"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, labels, bench, name):
    rows = operators(labels, bench)[name](odd).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ROWS)
        same = [tuple(r) for r in rows if r["doc_id"] == 1]
        assert same[0] == same[1]
    assert operators(labels, bench)[name](odd.filter("false")).count() == 0
    empty = operators(labels.filter("false"), bench.filter("false"))[name](odd)
    assert empty.count() >= 0


def test_defined_values(spark, odd, labels, bench):
    got = {n: {r["doc_id"]: r for r in f(odd).collect()} for n, f in operators(labels, bench).items() if n in ("toxicity", "langid", "simhash", "media", "secrets", "lattice", "html")}
    assert got["toxicity"][2].score == got["toxicity"][3].score == got["toxicity"][6].score == 0.0
    assert got["langid"][2].lang_pred == "und" and got["langid"][6].score == 0.0 and got["langid"][7].lang_pred == "en"
    assert got["simhash"][2].fp == 0 and got["simhash"][3].component_id == 2 and got["simhash"][9].component_id == 8
    assert got["media"][3].payload_bytes == 64 and got["media"][3].n_bytes == 0 and got["media"][2].media_sha256 == got["media"][3].media_sha256
    assert got["secrets"][1].n_assign == 1 and got["secrets"][2].spans == "" and got["secrets"][5].n_hex == 0
    assert got["lattice"][2].n_tokens == 1 and got["lattice"][4].n_tokens == 12_001
    assert got["html"][3].text == "" and got["html"][2].n_chars == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, labels, bench, tmp_path, name):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = stage(spark, odd, str(tmp_path)).collect()
    if name == "packing":
        assert len(rows) >= len(ROWS)
    else:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns
        assert any(r["doc_id"] == 7 for r in rows)
    assert stage(spark, odd.filter("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "decontamination"])
def test_stages_without_labels_or_items_keep_all(spark, odd, labels, bench, tmp_path, name):
    labels.filter("false").write.parquet(f"{tmp_path}/labels.parquet")
    bench.filter("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = dict(corpus_pipeline.STAGES)[name](spark, odd, str(tmp_path))
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_near_duplicate_rows(spark, odd):
    """Repeated rows, equal words, texts without words and null ids: the smallest id stands for each class, once."""
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert {r.id: r.class_id for r in neardup.near_duplicate_decisions(odd).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 2, 7: 7, 8: 8, 9: 8, None: None}


def test_rows_that_repeat(spark, odd, labels, bench):
    """What a repeated row gives where results have a row per finding."""
    item = bench.filter("item_id = 4").first().text
    rows = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(20, item), (20, item), (21, f"so {item} so")], "doc_id long, text string"))
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.benchmark_matches(rows, bench).collect())
    assert found == [(20, 4), (20, 4), (21, 4)]
    long = " ".join(f"w{k}" for k in range(70))
    same = spark.createDataFrame([(1, long), (1, long), (2, "x " + long)], "doc_id long, text string")
    got = sorted(tuple(r) for r in repeats.repeated_passages(same).collect())
    assert got == [(1, 0, 70, 70, 1, 0, 2), (2, 1, 71, 70, 1, 0, 2)]
    assert repeats.repeated_passages(same.filter("doc_id = 1")).count() == 0
    packed = packing.pack_documents(same).collect()
    assert len([r for r in packed if r.doc_id == 1]) == 2 and len({(r.sequence_id, r.offset) for r in packed}) == 3


def test_ties():
    """Equal runs score alike, equally few edits take the first occurrence."""
    item = b"abcdefgh ijklmnop qrstuvwx yz012345 abcdefgh ijklmnop qrstuvwx yz01"
    index = decontaminate.Index([(0, item)])
    ((_, _, _, start, _, edits),) = index.matches([b"-- " + item + b" -- " + item])
    assert (start, edits) == (3, 0)
    from toolweave.llm.subword import best_run
    import numpy as np

    assert best_run(np.array([1.0, 0.0, 1.0, 0.0]), 1) == (1.0, 0)
