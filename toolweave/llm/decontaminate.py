"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark items are cut into overlapping segments of ``segment`` characters. If
a segment occurs in a document with at most ``edits`` edits, document and
segment share at least segment - q + 1 - q * edits of their q-grams, and these
lie within a band of diagonals (document position minus item position). So a
document's q-grams are looked up in the benchmark's, hits are counted per
segment in bands of diagonals that overlap by half, bands that meet the bound
are kept, and each is verified by a banded alignment.

Texts are compared as lower-cased UTF-8 in which runs of ASCII white space and
punctuation are one space; "characters" are bytes of that form. Documents are
scanned whole, many at a time in numpy; shared q-grams are gone through in ranges
of positions, and an item whose segments all occur unchanged in a document takes
part no more, so repetitive texts need no more memory than others. The benchmark is read in blocks of at
most ``BLOCK_BYTES`` of text (a checked size), and every block scans all
documents, so a large benchmark takes more passes and not more memory.

Defined cases: null or empty texts on either side match nothing; an item
shorter than a segment is one segment of its own length, with edits in
proportion, and where those may leave no q-gram of its own untouched, it is
looked up by shorter ones; one shorter than ``q`` has no q-gram and matches the documents that
equal it in the compared form; of occurrences with equally few edits the first
counts; repeated rows give repeated matches; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import map_batches, texts_of

Q = 11
SEGMENT = 64
STRIDE = 16
EDITS = 4
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20
#: Shared q-grams that are looked at together, about.
HITS = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The form in which texts are compared."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_FLAT).split())


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q bytes from each position on (the last q - 1 have none)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if q < 8:
        padded = np.append(data, np.zeros(8, np.uint8))
        few = np.ndarray((n,), "<u8", padded, 0, (1,)) & np.uint64((1 << (8 * q)) - 1)
        return (few ^ (few >> np.uint64(29))) * _MIX
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    return (eight[:n] * _MIX) ^ ((eight[q - 8 : q - 8 + n] + np.uint64(0x2545F4914F6CDD1D)) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4096)  # repetitive texts ask for the same again and again
def banded_distance(a: bytes, b: bytes, most: int, width: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best occurrence of ``a`` in ``b`` if within ``most`` edits.

    Only ``width`` diagonals are filled, from that of the start of ``b`` on.
    """
    far = most + 1
    row = [(0, j) for j in range(min(width, len(b) + 1))]  # (edits, start) at column i + k
    row += [(far, 0)] * (width - len(row))
    for i, x in enumerate(a, 1):
        nxt, left = [], (far, 0)
        for k in range(width):
            j = i + k
            best = (far, 0)
            if j <= len(b):
                e, s = row[k]
                if j >= 1:
                    best = (e + (b[j - 1] != x), s)
                if k + 1 < width and row[k + 1][0] + 1 < best[0]:
                    best = (row[k + 1][0] + 1, row[k + 1][1])
                if left[0] + 1 < best[0]:
                    best = (left[0] + 1, left[1])
            nxt.append(best)
            left = best
        row = nxt
        if min(e for e, _ in row) > most:
            return None
    e, s, k = min((e, s, k) for k, (e, s) in enumerate(row))
    return (e, s, len(a) + k) if e <= most else None


class Index:
    """Q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], segment: int = SEGMENT, stride: int = STRIDE, edits: int = EDITS, q: int = Q):
        self.q = q
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.segments: list[tuple[int, int, int, int]] = []  # item, start, length, edits
        at: list[np.ndarray] = []
        first: list[int] = []
        grams: list[np.ndarray] = []
        self.most, self.segment, self.stride = edits, segment, stride
        #: items without a q-gram, by their text
        self.short: dict[bytes, list[int]] = {}
        #: items so short for their edits that they may share no q-gram with a match, by what q serves them
        weak: dict[int, list[int]] = {}
        for k, text in enumerate(self.texts):
            n = len(text)
            first.append(len(self.segments))
            if n < q:
                if n:
                    self.short.setdefault(text, []).append(k)
                continue
            if n <= segment:
                allowed = edits * n // segment
                if n - q + 1 - q * allowed < 1 and (fits := (n - allowed) // (allowed + 1)) < q:
                    weak.setdefault(max(1, fits), []).append(k)
                    continue
                self.segments.append((k, 0, n, allowed))
            else:
                starts = sorted({*range(0, n - segment, stride), n - segment})
                self.segments += [(k, s, segment, edits) for s in starts]
            h = gram_hashes(np.frombuffer(text, np.uint8), q)
            grams.append(h)
            at.append(np.stack([np.full(len(h), k), np.arange(len(h))], 1))
        first.append(len(self.segments))
        self.first = np.array(first)
        seg = np.array(self.segments, np.int64).reshape(-1, 4)
        self.seg = seg
        #: hits that a segment's band must have, by the lemma; one at least
        self.need = np.maximum(1, seg[:, 2] - q + 1 - q * seg[:, 3])
        self.weak = [(ks, Index([items[k] for k in ks], segment, stride, edits, fits)) for fits, ks in sorted(weak.items())]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        place = np.concatenate(at) if at else np.zeros((0, 2), np.int64)
        order = np.argsort(h, kind="stable")
        self.gram, self.place = h[order], place[order]
        self.bits = max(12, min(24, int(len(h)).bit_length() + 5))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.gram >> np.uint64(64 - self.bits)] = True

    def shared(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, first, number) of every q-gram that items have too, as a range of ``place``."""
        h = gram_hashes(data, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
        h = h[at]
        lo = np.searchsorted(self.gram, h, "left")
        n = np.searchsorted(self.gram, h, "right") - lo
        keep = n > 0
        return at[keep], lo[keep], n[keep]

    def hits(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, item position) of every occurrence in an item of the shared q-grams."""
        pick = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        place = self.place[pick]
        return np.repeat(at, n), place[:, 0], place[:, 1]

    def open_grams(self, lo: np.ndarray, n: np.ndarray, done: np.ndarray) -> np.ndarray:
        """Whether a q-gram occurs in an item that isn't ``done``."""
        left = np.append(0, np.cumsum(~done[self.place[:, 0]]))
        return left[lo + n] > left[lo]

    def candidates(self, pos: np.ndarray, item: np.ndarray, j: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """(doc, segment, diagonal) rows of bands that meet the segment's bound."""
        if not len(pos):
            return np.zeros((0, 3), np.int64)
        parts = []
        # the segments of an item that hold position j are consecutive; go through them by how far back they start
        lo, hi = self.first[item], self.first[item + 1]
        most = int((hi - lo).max(initial=0))
        near = min(most, self.segment // self.stride + 2)
        guess = np.minimum(lo + j // self.stride, hi - 1)
        for back in range(-1, near + 1):
            s = guess - back
            ok = (s >= lo) & (s < hi)
            ok[ok] &= (self.seg[s[ok], 1] <= j[ok]) & (j[ok] + self.q <= self.seg[s[ok], 1] + self.seg[s[ok], 2])
            if ok.any():
                parts.append(np.stack([doc[ok], s[ok], pos[ok] - j[ok]], 1))
        if not parts:
            return np.zeros((0, 3), np.int64)
        rows = np.concatenate(parts)
        half = self.most + 1
        band = rows[:, 2] // half
        both = np.concatenate([np.stack([rows[:, 0], rows[:, 1], b, rows[:, 2]], 1) for b in (band, band - 1)])
        order = np.lexsort((both[:, 2], both[:, 1], both[:, 0]))
        both = both[order]
        cut = np.flatnonzero((both[1:, :3] != both[:-1, :3]).any(1)) + 1
        start = np.append(0, cut)
        count = np.diff(np.append(start, len(both)))
        good = np.flatnonzero(count >= self.need[both[start, 1]])
        return np.stack([both[start[good], 0], both[start[good], 1], both[start[good], 2] * half + half], 1)  # the band's middle diagonal

    def banded(self, data: np.ndarray, starts: np.ndarray, found: dict[tuple[int, int], dict[int, tuple[int, int, int]]]) -> Iterator[list[int]]:
        """``candidates`` of the texts that begin at ``starts``, in ranges of positions of about HITS hits.

        A band belongs to the range that holds the place where its segment would
        begin; the q-grams that it can have beyond that are read too. ``found``
        is what the caller made of the candidates so far.
        """
        at, lo, n = self.shared(data)
        half, total, a = self.most + 1, np.cumsum(n), 0
        low, last, text, done, keep = -1 << 62, 1 << 62, -1, np.zeros(0, bool), np.zeros(0, bool)
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, total[a] - n[a] + HITS, "right")))
            high = int(at[b]) if b < len(at) else last
            end = int(np.searchsorted(at, high + self.segment + 2 * half))
            mine = np.arange(a, end)
            d = int(np.searchsorted(starts, at[a], "right")) - 1
            if a and at[end - 1] < starts[d + 1]:
                # a long range of one text: leave out the items whose segments all occur unchanged
                whole = [k for (e, k), of in found.items() if e == d and len(of) == self.first[k + 1] - self.first[k] and not any(x[0] for x in of.values())]
                if d != text or len(whole) > done.sum():
                    text, done = d, np.isin(np.arange(len(self.ids)), whole)
                    keep = self.open_grams(lo, n, done)
                mine = mine[keep[mine]]
            pos, item, j = self.hits(at[mine], lo[mine], n[mine])
            doc = np.searchsorted(starts, pos, "right") - 1
            rows = self.candidates(pos - starts[doc], item, j, doc)
            begin = starts[rows[:, 0]] + rows[:, 2] - half + self.seg[rows[:, 1], 1]
            yield from rows[(begin >= low) & (begin < high)].tolist()
            a, low = b, high

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, segments found, start, end, fewest edits) per text and item."""
        if self.short:
            for d, t in enumerate(texts):
                yield from ((d, k, 1, 0, len(t), 0) for k in self.short.get(t, ()))
        for ks, index in self.weak:
            yield from ((d, ks[k], *rest) for d, k, *rest in index.matches(texts))
        if not len(self.gram):
            return
        for first, chunk in _chunks(texts):
            data = np.frombuffer(b"\0".join(chunk) + b"\0", np.uint8)
            starts = np.append(0, np.cumsum([len(t) + 1 for t in chunk]))
            found: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
            for d, s, diagonal in self.banded(data, starts, found):
                k, at, n, most = self.segments[s]
                if s in found.get((d, k), ()) and not found[d, k][s][0]:
                    continue  # no later occurrence has fewer edits
                part = self.texts[k][at : at + n]
                # diagonals of the band lie within most + 1 of its middle; the start may drift by the edits
                left = max(0, diagonal + at - 2 * self.most - 1)
                window = chunk[d][left : diagonal + at + n + 2 * self.most + 2]
                exact = window.find(part)
                m = (0, exact, exact + n) if exact >= 0 else banded_distance(part, window, most, 4 * self.most + 3) if most else None
                if m:
                    of = found.setdefault((d, k), {})
                    if s not in of or m[0] < of[s][0]:
                        of[s] = (m[0], left + m[1], left + m[2])
            for (d, k), of in found.items():
                yield first + d, k, len(of), min(x[1] for x in of.values()), max(x[2] for x in of.values()), min(x[0] for x in of.values())


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    part: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark's items in blocks of bounded size, by ranges of a hash of their text."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK_BYTES // 2))) if size else 0
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == b).collect()
        yield sorted((r["id"], plain(r["text"])) for r in rows)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_segments, start, end, edits) per document row and item of which it holds a segment.

    start and end count bytes of the document's compared form.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, n_segments bigint, start bigint, end bigint, edits int"
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(items: list[tuple[object, bytes]]) -> DataFrame:
        def start():
            index = Index(items)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                rows = list(index.matches([plain(t) for t in texts_of(batch, 1)]))
                if not rows:
                    return None
                doc, item, n, a, b, e = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array([index.ids[i] for i in item]), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.int32())], ["id", "item", "n_segments", "start", "end", "edits"])

            return work

        return map_batches(slim, start, schema)

    parts = [scan(items) for items in benchmark_blocks(benchmark, item_col, item_text_col)]
    out = reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no segment of any item.

    Null and empty texts hold none and stay; rows that repeat stay or go
    together; without items, or with empty ones only, every row stays.
    """
    at = docs.columns.index(text_col)
    for items in benchmark_blocks(benchmark, item_col, item_text_col):

        def start(items=items):
            index = Index(items)

            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                bad = {row[0] for row in index.matches([plain(t) for t in texts_of(batch, at)])}
                return batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

            return work

        docs = map_batches(docs, start, docs.schema)
    return docs
