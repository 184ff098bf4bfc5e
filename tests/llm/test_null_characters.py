"""Words with U+0000 have the probability of the one-by-one lattice, whatever their length."""

from __future__ import annotations

import numpy as np
import pytest

from toolweave.llm import lattice


def test_null_characters_are_spelt():
    _, _, prior = lattice.vocabulary()
    one, side = lattice.Lattice(np.log(prior)), lattice.WordLattices(np.log(prior))
    words = ["\0", "a\0", "\0the", "in\0the", "the", "x\0\0", "\0" * 60]
    got = side.log_marginals(words)
    assert np.isfinite(got).all()
    for w, v in zip(words, got, strict=True):
        assert v == pytest.approx(one.log_marginal(w))
    alone, together = [0.0] * len(prior), np.zeros(len(prior))
    for w in words:
        one.expect(w, 2.0, alone)
    side.expect(words, np.full(len(words), 2.0), together)
    assert np.allclose(alone, together)
