"""Long texts are learned whole, long words are scored in little memory."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolweave.llm import langid, lattice, toxicity

PLAIN = "mild words of no harm at all "


def test_toxicity_learns_whole_texts(spark):
    rows = [(i, PLAIN * 4 + ("vrumpf zaskel oddi" if i % 2 else "calm end here"), i % 2) for i in range(40)]
    rows += [(i, PLAIN * 3000 + f"marker{i}qx", 1) for i in range(40, 52)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels, F.lit(True))
    for i in range(40, 52):
        assert model.scores.of([f"marker{i}qx"]).any()


def test_language_learns_whole_texts(spark):
    rows = [(i, f"{i} kato miru sanno teki", "aa") for i in range(60)] + [(i, f"{i} blorf wexing dralt", "bb") for i in range(60, 120)]
    long = [(i, "kato miru sanno teki " * 1500 + "ghuyw" * (i - 118), "aa") for i in range(120, 140)]
    docs = spark.createDataFrame(rows + long, "doc_id long, text string, lang string")
    model = langid.train_language(docs, F.lit(True))
    assert model.scores.of(["ghuyw"]).any()
    got = langid.identify_language(docs, model).join(docs, "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got)


@pytest.fixture(scope="module")
def one():
    prior = lattice.vocabulary()[2]
    return lattice.Lattice(np.log(prior))


def all_prefixes(one, word: str) -> float:
    """The forward recursion with every prefix kept."""
    text = lattice.MARK + word
    alpha = [0.0]
    for j in range(1, len(text) + 1):
        terms = [alpha[i] + one.edge[text[i:j]][1] for i in range(j) if text[i:j] in one.edge]
        if text[j - 1] not in one.edge:
            terms.append(alpha[j - 1] + one.spell(text[j - 1])[1])
        alpha.append(float(np.logaddexp.reduce(terms)))
    return alpha[-1]


@pytest.mark.parametrize("word", ["", "a", "information" * 20, "naïveté\x00\U0001f600" * 12, "q" * 300])
def test_window_of_prefixes_equals_all(one, word):
    assert math.isclose(one.log_marginal(word), all_prefixes(one, word), rel_tol=1e-9, abs_tol=1e-9)


def test_expected_uses_spell_the_word(one):
    """Every path spells the word, so the pieces' lengths by expected uses add up to it."""
    word = "unbelievablyinternational" * 8
    total = [0.0] * len(one.log_p)
    one.expect(word, 3.0, total)
    number = {n: piece for piece, (n, _) in one.edge.items()}
    assert math.isclose(sum(len(number[n]) * u for n, u in enumerate(total) if u), 3.0 * (len(word) + 1), rel_tol=1e-6)


def test_long_word_in_little_memory(one):
    word = "thequickbrownfox" * 12_500
    tracemalloc.start()
    value = one.log_marginal(word)
    scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    one.expect(word, 1.0, [0.0] * len(one.log_p))
    learned = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(value)
    # the marked copy of the word takes two bytes a character
    assert scored < 8 * len(word) + 1_000_000
    assert learned < 24 * len(word) + 2_000_000
