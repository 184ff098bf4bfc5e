"""Items shorter than a segment, with the edits they are allowed spread as evenly as can be."""

from __future__ import annotations

import random

import pytest

from toolweave.llm import decontaminate


def edited(rng, text, edits, kind):
    """``text`` with single-byte edits in the middle of equal parts."""
    out = bytearray(text)
    for k in reversed(range(edits)):
        at = (2 * k + 1) * len(text) // (2 * edits)
        if kind == "swap":
            out[at] = ord("#") if out[at] != ord("#") else ord("q")
        elif kind == "drop":
            del out[at]
        else:
            out.insert(at, ord("#"))
    return bytes(out)


@pytest.mark.parametrize("kind", ["swap", "drop", "add"])
def test_every_length_is_found(kind):
    rng = random.Random(kind)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(n, "".join(rng.choice(letters) for _ in range(n)).encode()) for n in range(11, 65)]
    index = decontaminate.Index(items)
    for k, (n, text) in enumerate(items):
        edits = decontaminate.EDITS * n // decontaminate.SEGMENT
        doc = b"zz zz zz " + edited(rng, text, edits, kind) + b" yy yy yy"
        found = {m[1]: m for m in index.matches([b"other text", doc])}
        assert k in found, n
        assert found[k][0] == 1 and found[k][5] <= edits
        if edits:
            over = edited(rng, text, 2 * edits + 2, "swap")
            assert k not in {m[1] for m in index.matches([over])}


def test_texts_of_short_items_only():
    index = decontaminate.Index([(1, b"abcdefghijklmnop"), (2, b"")])
    assert [m[:2] for m in index.matches([b"", b"abcdefghXjklmnop", b"abcd"])] == [(1, 0)]
    assert list(decontaminate.Index([]).matches([b"text"])) == []
