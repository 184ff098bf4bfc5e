"""Ids of whole texts are those of the library's default call."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from toolweave.llm import packing


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_special_tokens_in_texts(tok):
    ids = packing.text_encoder()
    assert ids("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]
    for text in ["", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b <|endoftext|", "x<|endoftext|>  \n"]:
        assert ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_long_white_space_is_cut_at_the_patterns_bounds(tok, monkeypatch):
    """Short runs take the long runs' path and give the library's ids."""
    monkeypatch.setattr(packing, "LONG_SPACE", 2)
    monkeypatch.setattr(packing, "_LONG_SPACE", packing.re.compile(packing._LONG_SPACE.pattern.replace("100000", "2")))
    for text in ["a   b", "  ", "   x\n\n\n", "a \n\t 12 \u00a0\u3000\u2003 !!  <|endoftext|>   z\u0085\u0085 q", "one two  three\x1c\x1c\x1cfour"]:
        assert packing.text_encoder()(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_a_million_spaces_and_line_feeds(spark, tok):
    texts = {1: "a" + "\n" * 1_000_000 + "b", 2: " " * 1_000_000, 3: "x <|endoftext|> y"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = packing.tokenized_pieces(df, 1 << 30).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3]
    for r in rows:
        if r["id"] != 2:
            ids = [*tok.encode(texts[r["id"]], add_special_tokens=False).ids, packing.END_ID]
            assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
