"""Every language is learned, from windows of long texts where it has no short ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from toolweave.llm import langid

WORDS = {"aa": "kato miru sanno teki", "bb": "blorf wexing dralt hupf", "cc": "zuqi yxou qivy jaxo"}


def docs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")


def test_language_with_long_texts_only(spark):
    rows = [(f"{n} {text} " * 5, lang) for lang, text in WORDS.items() if lang != "cc" for n in range(60)]
    rows += [("7 " * 4000 + f"{WORDS['cc']} " * 700, "cc") for _ in range(30)]
    df = docs(spark, rows)
    model = langid.train_language(df, F.lit(True))
    assert model.names == ["aa", "bb", "cc"]
    got = langid.identify_language(df, model).collect()
    assert all(r.lang_pred == rows[r.doc_id][1] for r in got)


def test_only_long_texts(spark):
    df = docs(spark, [(f"{WORDS[lang]} " * 700, lang) for lang in ("aa", "bb") for _ in range(20)])
    got = langid.identify_language(df, langid.train_language(df, F.lit(True))).join(df, "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_more_than_200_languages(spark):
    rows = [("same words here", f"l{n:03}") for n in range(230)]
    assert len(langid.train_language(docs(spark, rows), F.lit(True)).names) == 230
