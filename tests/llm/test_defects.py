"""Cases that once failed: caps, switches, hostile inputs."""

from __future__ import annotations

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolweave.llm import decontaminate, langid, media, secrets, toxicity

LANGUAGES = {"aa": "kato miru sanno teki pavu lodi", "bb": "blorf wexing dralt hupf znick truss", "cc": "zuqi yxou qivy jaxo xyzu yuqo"}


def languages(spark, names=tuple(LANGUAGES), each=80):
    rows = []
    for name in names:
        words = LANGUAGES[name].split()
        rows += [(" ".join(words[(n * k + k * k) % len(words)] for k in range(6 + n % 20)), name) for n in range(each)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")


def test_language_rejection_is_on(spark):
    df = languages(spark)
    model = langid.train_language(df, F.lit(True))
    names, score, accepted = model.predict(["kato miru sanno teki pavu", "wfgh pqrt mbvc jkls dfgh wrtp", "½ ² ① Ⅷ", "123 !?", None])
    assert names[0] == "aa" and accepted[0] and not accepted[1]
    assert names[1] in LANGUAGES and names[2:] == ["und"] * 3 and not score[2:].any() and not accepted[2:].any()
    got = langid.identify_language(df, model)
    assert got.filter("accepted").count() > 0.9 * df.count()


def test_one_language(spark):
    model = langid.train_language(languages(spark, ["aa"]), F.lit(True))
    names, score, accepted = model.predict(["kato miru sanno", "xq wvz bnm ggh ppl", "42"])
    assert names == ["aa", "aa", "und"] and score[0] > score[1] and accepted.tolist() == [True, False, False]


def test_language_ties_go_by_name():
    model = langid.LanguageModel(["aa", "bb"], None)
    model.scores = type("Even", (), {"of": staticmethod(lambda words: np.zeros((len(words), 3), np.float32))})()
    names, score, _ = model.predict(["any words"])
    assert names == ["aa"] and score[0] == pytest.approx(1 / 3)


def test_toxicity_learns_from_few_rows(spark):
    rows = [(1, "you are scum"), (2, "a kind day to all"), (3, "scum of the earth"), (4, "fine words"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, toxicity.train_toxicity(df, labels, F.lit(True))).collect()}
    assert got[3] > got[4] and got[5] == 0 and got[4] < 0.5
    one = toxicity.train_toxicity(df, labels.filter("toxic = 1"), F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(df, one).collect()} == {0.0}


def test_toxicity_learns_from_long_texts(spark):
    rows = [(i, ("scum " if i % 2 else "sunny ") * 6000) for i in range(8)] + [(9, "you scum"), (10, "a sunny day")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.filter("doc_id < 8").selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(df, toxicity.train_toxicity(df, labels, F.lit(True))).collect()}
    assert (got[9], got[10]) == (1, 0)


def test_toxicity_brute_force():
    """A text's score against a loop over its runs with vectors added up n-gram by n-gram."""
    from toolweave.llm.subword import SubwordModel, gram_rows

    model = SubwordModel(2, bits=10, width=4, window=3)
    model.fit([["good", "day"], ["bad", "scum", "here"], ["nice"], ["scum"]], np.array([0, 1, 0, 1]), epochs=3)
    scored = toxicity.ToxicityModel(model.scorer(), 0.25, 3)
    for text in ["one", "scum", "a good day with scum in it", "x " * 40, "tie tie tie tie"]:
        logits = []
        for w in text.lower().split():
            rows, _ = gram_rows([w], 3, 5, 10)
            vector = sum(model.embedding[r].astype(float) for r in rows) / len(rows)
            two = vector @ model.weights.astype(float)
            logits.append(two[1] - two[0])
        runs = [sum(logits[k : k + 3]) / 3 for k in range(len(logits) - 2)] if len(logits) >= 3 else [sum(logits) / len(logits)]
        assert scored.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(max(runs) + 0.25))), abs=1e-5)


def test_language_brute_force(spark):
    model = langid.train_language(languages(spark), F.lit(True))
    table = model.scores.table
    from toolweave.llm.subword import gram_rows

    for text in ["kato wexing", "zuqi", "new words kato"]:
        total = np.zeros(table.shape[1])
        for w in text.split():
            rows, _ = gram_rows([w], 3, 4, 15)
            total += sum(table[r].astype(float) for r in rows) / len(rows)
        z = (total / len(text.split()) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        names, score, _ = model.predict([text])
        assert names[0] == model.names[int(p[:-1].argmax())] and score[0] == pytest.approx(p[:-1].max(), abs=1e-4)


def test_short_benchmark_items_match_exactly():
    index = decontaminate.Index([(1, b"short"), (2, b"short"), (3, b"")])
    assert sorted(index.matches([b"short", b"a short text", b""])) == [(0, 0, 1, 0, 5, 0), (0, 1, 1, 0, 5, 0)]


@pytest.mark.parametrize(("segment", "stride"), [(32, 8), (32, 4), (128, 8), (64, 16)])
def test_all_segments_of_an_equal_text_are_found(segment, stride):
    import random

    item = bytes(random.Random(4).choices(b"abcdefgh ", k=170)).strip()
    index = decontaminate.Index([(0, item)], segment, stride)
    ((_, _, n, a, b, edits),) = index.matches([b"before " + item + b" after"])
    assert (n, a, b, edits) == (len(index.segments), 7, 7 + len(item), 0)


def test_secret_scan_is_linear():
    scan = secrets.Scanner().spans
    began = time.perf_counter()
    assert scan("eyJ" * 200_000) == []
    assert len(scan(("é" + "ab12" * 6 + " ") * 20_000)) == 20_000
    assert time.perf_counter() - began < 10
    token = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    assert [s[:2] for s in scan(f"EYJx{token}")] == [(4, 4 + len(token))] and scan("EYJ" + token[3:]) == []


def u4(*n):
    return b"".join(x.to_bytes(4, "big") for x in n)


def test_hostile_containers():
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    with pytest.raises(ValueError, match="deeper"):
        media.read_media(deep)
    claim = media.box(b"trak", media.full(b"stsz", u4(1, (1 << 32) - 1)))
    with pytest.raises(ValueError, match="more samples"):
        media.read_media(claim)
    many = media.box(b"moov", *[media.box(b"trak", media.full(b"stsz", u4(1, 5000))) for _ in range(2000)])
    with pytest.raises(ValueError, match="more samples"):
        media.read_media(many)


def fragmented(base_is_moof=True, offsets=True):
    box, full = media.box, media.full
    tkhd = full(b"tkhd", u4(0, 0, 1, 0, 0), bytes(16), bytes(36), u4(8 << 16, 8 << 16))
    track = box(b"trak", tkhd, box(b"mdia", full(b"mdhd", u4(0, 0, 10, 0), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", box(b"stbl", full(b"stsd", u4(1), box(b"avc1", bytes(70)))))))
    head = box(b"ftyp", b"isom", u4(0)) + box(b"moov", track, box(b"mvex", full(b"trex", u4(1, 1, 4, 3, 0x10000))))
    tfhd = full(b"tfhd", u4(1), flags=0x20000 if base_is_moof else 0)
    first = lambda at: full(b"trun", u4(2), *([u4(at)] if offsets else []), u4(0), u4(2, 3), flags=(0x1 if offsets else 0) | 0x4 | 0x200)
    moof = lambda at: box(b"moof", box(b"traf", tfhd, full(b"tfdt", u4(20)), first(at), full(b"trun", u4(1))))
    return head + moof(len(moof(0)) + 8) + box(b"mdat", b"aabbbccc")


def test_fragments_are_read():
    data = fragmented()
    (track,) = media.read_media(data)
    assert media.sample_bytes(data, track) == b"aabbbccc" and track.sizes.tolist() == [2, 3, 3]
    assert (track.codec, track.duration, track.seconds, track.keys.tolist()) == ("avc1", 32, 3.2, [0])
    with pytest.raises(ValueError, match="track"):
        media.read_media(media.box(b"moof", media.box(b"traf", media.full(b"tfhd", u4(9)))))
    for cut in range(8, len(data), 5):
        try:
            media.read_media(data[:cut])
        except ValueError:
            continue


def independent_payload(data):
    """A second reader of what ``wrap_payload`` writes, by plain struct calls along the one path of boxes."""

    def inside(body, path):
        for kind in path:
            at = 0
            while body[at + 4 : at + 8] != kind:
                at += struct.unpack_from(">I", body, at)[0]
            body = body[at + 8 : at + struct.unpack_from(">I", body, at)[0]]
        return body

    table = [b"moov", b"trak", b"mdia", b"minf", b"stbl"]
    size, count = struct.unpack_from(">II", inside(data, [*table, b"stsz"]), 4)
    chunks = inside(data, [*table, b"stco"])
    starts = struct.unpack_from(f">{struct.unpack_from('>I', chunks, 4)[0]}I", chunks, 8)
    runs = inside(data, [*table, b"stsc"])
    entries = [struct.unpack_from(">III", runs, 8 + 12 * k) for k in range(struct.unpack_from(">I", runs, 4)[0])]
    keys = inside(data, [*table, b"stss"])
    out = b""
    for number, start in enumerate(starts, 1):
        out += data[start : start + size * [n for first, n, _ in entries if first <= number][-1]]
    return out, count, struct.unpack_from(f">{struct.unpack_from('>I', keys, 4)[0]}I", keys, 8)


@pytest.mark.parametrize("n", [0, 1, 64, 65, 1024, 5000])
def test_media_by_another_reader(n):
    payload = media.pad_payload(bytes(i * 7 % 256 for i in range(n)))
    out, count, keys = independent_payload(media.wrap_payload(payload))
    assert out == payload and count == len(payload) // 64 and list(keys) == list(range(1, count + 1, 8))
    (track,) = media.read_media(media.wrap_payload(payload))
    head = f"vide;raw;8x8;{count / 25:.3f}s;{count};{len(keys)};"
    assert media.track_feature(track).startswith(head)


def test_repetitive_texts_are_matched_in_ranges(monkeypatch):
    """Runs that item and text share need no more memory than other texts, and ranges of any size give the same."""
    tail = decontaminate.plain("the quick brown fox jumps over the lazy dog and runs far away from it all, said the old man in the end")
    items = [(1, b"0 " * 100 + b"0"), (2, tail), (3, b"ab" * 60 + b" " + tail[:40])]
    index = decontaminate.Index(items)
    texts = [b"0 " * 600 + tail, tail[:70] + b" " + b"0 " * 40 + b"1 " + b"0 " * 30, b"ab" * 50 + b"ba" * 50 + b" " + tail[:50], b"", b"0 " * 20]
    monkeypatch.setattr(decontaminate, "HITS", 1 << 40)
    want = sorted(index.matches(texts))
    assert {(d, k) for d, k, *_ in want} >= {(0, 0), (0, 1), (2, 2)}
    sizes, hits = [], decontaminate.Index.hits
    monkeypatch.setattr(decontaminate.Index, "hits", lambda self, at, lo, n: (sizes.append(int(n.sum())), hits(self, at, lo, n))[1])
    for most in (1, 300, 20_000):
        monkeypatch.setattr(decontaminate, "HITS", most)
        assert sorted(index.matches(texts)) == want
    sizes.clear()
    ((_, _, n, _, _, edits),) = index.matches([b"0 " * 100_000])
    # a range and what its last bands may have beyond it; of the rest of the run nothing is looked at
    assert n == len(range(0, 201 - 64, 16)) + 1 and edits == 0 and max(sizes) < 40_000 and sum(sizes) < 200_000
