"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint holds, per bit, the majority of its shingles' hashes.
Equal fingerprints are one node from the start. Two fingerprints link at
``budget`` or fewer differing bits; all links are found: cut into ``budget`` + 2
blocks of bits, linked fingerprints agree on two whole blocks at least, so each
fingerprint goes to one group per pair of blocks, keyed by their bits. In a
group the fingerprints form a binary trie that is joined with itself: pairs of
nodes go down together, differing bits add up, and a pair is dropped once they
exceed the budget. Crowded groups are parted by two more blocks of the other bits
first. A group hands on only a spanning set of links (a fingerprint
and the root of its part of the group), never all its pairs.

Within a group two blocks' bits are the same, and a fingerprint has at most
C(64,1) + C(64,2) others within two bits, so work per fingerprint is bounded
even where near copies crowd together.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of
all words; repeated rows give repeated results; a row with null id takes its
component from the other rows (null if there are none).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import lower_words, map_batches, materialize, texts_of
from toolweave.llm.components import connected_components

#: Shingles whose bits are counted at once, and node pairs that go down at once.
CHUNK = 1 << 16
FRONTIER = 1 << 20
#: Fingerprints of a group that one task takes; larger groups are parted.
CROWD = 1 << 17


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are 1 in more than half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i : i + CHUNK], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text, XXH64 (seed 42) of lower-cased word shingles, unsigned."""
    words = lower_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(42)), "<u8", n)
    return int(majority(hashes))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed 64-bit number."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, shingle) for t in texts_of(batch, 1)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

        return work

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, fp bigint")


def block_keys(fp: str, budget: int) -> Column:
    """Group keys: per pair of the ``budget`` + 2 blocks of bits, the pair's number and both blocks' bits."""
    n = budget + 2
    cuts = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(cuts)]
    keys = []
    for number, (i, j) in enumerate(itertools.combinations(range(n), 2)):
        width = cuts[j + 1] - cuts[j]
        keys.append(F.shiftleft(F.lit(number).cast("long"), 2 * -(-64 // n)).bitwiseOR(F.shiftleft(part[i], width)).bitwiseOR(part[j]))
    return F.array(*keys)


def trie_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of fingerprints within ``budget`` bits, in each group [lo, hi) of ``fp``.

    ``fp`` is sorted, without repeats, in each group, so a trie node is a range
    of positions. All groups go down one bit at a time together.
    """
    empty = [np.zeros(0, np.int64)] * 5
    keep = hi - lo > 1
    stack = [(63, lo[keep], hi[keep], empty)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, s_lo, s_hi, cross = stack.pop()
        a0, a1, b0, b1, bits = cross
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(fp[i] ^ fp[j]) <= budget
            yield i[near], j[near]
            a0, a1, b0, b1, bits = (x[~leaf] for x in (a0, a1, b0, b1, bits))
        if bit < 0 or not (len(s_lo) or len(a0)):
            continue
        if len(a0) > FRONTIER:
            for k in range(0, len(a0), FRONTIER // 2):
                stack.append((bit, *empty[:2], [x[k : k + FRONTIER // 2] for x in (a0, a1, b0, b1, bits)]))
            stack.append((bit, s_lo, s_hi, empty))
            continue
        if bit not in ones:
            ones[bit] = np.append(0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))
        count = ones[bit]
        split = lambda x, y: y - (count[y] - count[x])  # noqa: B023, E731
        s_mid, a_mid, b_mid = split(s_lo, s_hi), split(a0, a1), split(b0, b1)
        pairs = [
            (a0, a_mid, b0, b_mid, bits),
            (a_mid, a1, b_mid, b1, bits),
            (a0, a_mid, b_mid, b1, bits + 1),
            (a_mid, a1, b0, b_mid, bits + 1),
            (s_lo, s_mid, s_mid, s_hi, np.ones(len(s_lo), np.int64)),
        ]
        a0, a1, b0, b1, bits = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (bits <= budget)
        s_lo, s_hi = np.concatenate([s_lo, s_mid]), np.concatenate([s_mid, s_hi])
        big = s_hi - s_lo > 1
        stack.append((bit - 1, s_lo[big], s_hi[big], [x[keep] for x in (a0, a1, b0, b1, bits)]))


def _spanning(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each linked fingerprint to the first of its part of the group."""
    label = np.arange(len(fp))
    for i, j in trie_pairs(fp, lo, hi, budget):
        i, j = label[i], label[j]
        while len(i):
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
            while (label != (up := label[label])).any():
                label = up
            i, j = label[i], label[j]
            open_ = i != j
            i, j = i[open_], j[open_]
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def finer_keys(fp: str, budget: int) -> Column:
    """Per pair of blocks, in the order of ``block_keys``, the keys of a crowded group's parts.

    The other bits are cut into ``budget`` + 2 blocks in their turn, of which
    linked fingerprints agree on two, so each part holds the bits of two more.
    """
    n = budget + 2
    cuts = [64 * i // n for i in range(n + 1)]
    out = []
    for pair in itertools.combinations(range(n), 2):
        fixed = [b for k in pair for b in range(cuts[k], cuts[k + 1])]
        rest = [b for b in range(64) if b not in fixed]
        parts = [rest[len(rest) * i // n : len(rest) * (i + 1) // n] for i in range(n)]
        masks = [sum(1 << b for b in (*fixed, *x, *y)) for x, y in itertools.combinations(parts, 2)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        out.append(F.array(*[F.xxhash64(F.lit(f"{pair} {k}"), F.col(fp).bitwiseAND(F.lit(m))) for k, m in enumerate(signed)]))
    return F.array(*out)


def trie_links(nodes: DataFrame, budget: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``nodes`` that connect all within ``budget`` bits.

    A group of more than ``crowd`` fingerprints is parted by ``finer_keys``, which
    loses no link; with two bits a part has at most 2^16 fingerprints.
    """
    keyed = nodes.select("fp", F.posexplode(block_keys("fp", budget)).alias("pair", "key"))
    crowded = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"), "crowded")
    plain = keyed.select("fp", "key")
    if not crowded.isEmpty():
        finer = F.element_at(finer_keys("fp", budget), F.col("pair") + 1)
        plain = plain.join(crowded, "key", "left_anti").select("fp", "key").unionAll(keyed.join(crowded, "key").select("fp", F.explode(finer).alias("key")))
    grouped = plain.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((fp, key))
            key, fp = key[order], fp[order]
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            a, b = _spanning(fp, np.append(0, cut), np.append(cut, len(key)), budget)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, fps = [], []
        for batch in batches:
            key = batch.column(1).to_numpy()
            fp = batch.column(0).to_numpy().view(np.uint64)
            if len(key) and keys and key[-1] != keys[-1][-1]:
                last = np.searchsorted(key, key[-1])  # this batch's last key may go on in the next
                yield joined(np.concatenate([*keys, key[:last]]), np.concatenate([*fps, fp[:last]]))
                keys, fps, key, fp = [], [], key[last:], fp[last:]
            if len(key):
                keys.append(key)
                fps.append(fp)
        if keys:
            yield joined(np.concatenate(keys), np.concatenate(fps))

    return grouped.mapInArrow(run, "a bigint, b bigint").distinct()


def fingerprint_groups(prints: DataFrame, budget: int) -> DataFrame:
    """(fp, component_id, first_id, first_fp) per distinct fingerprint of ``prints`` (id, fp).

    component_id is the smallest id of the component; (first_id, first_fp) names
    the rows that stand for it: the smallest id with the smallest fingerprint
    that has it (a null id only where there is no other).
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    roots = connected_components(trie_links(nodes, budget))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = F.min(F.struct(F.col("first_id").isNull(), F.col("first_id").alias("id"), F.col("fp").alias("fp")))
    heads = placed.groupBy("root").agg(first.alias("first"))
    return placed.join(heads, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.id").alias("first_id"), F.col("first.fp").alias("first_fp"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """Per row: id, fp and component_id, the smallest id that its fingerprint reaches by links."""
    prints = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    groups = fingerprint_groups(prints, budget).select("fp", "component_id")
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_text(fp: str) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
