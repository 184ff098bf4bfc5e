"""Best-fit packing of tokenised documents into fixed-length sequences.

Method: large-item matching. Pieces longer than a third of the capacity fit at
most twice into a sequence, so they are matched greedily, longest first with the
longest partner that fits; shorter pieces, longest first, then best-fit into the
remaining gaps.

The plan depends on lengths only. There are at most ``capacity`` different
lengths, so it is worked out on the driver from a histogram of at most that many
rows, in runs of equal sequences, whatever the number of documents. Documents
get their places by their rank within their length: a rank inside a salted
share of the length plus the sizes of the shares before it, so that a length
which a third of all documents has is dealt over many tasks.

Defined cases: null text counts as empty and packs as the end id alone;
repeated rows are packed as often as they occur; an empty table gives none.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolweave.llm.common import map_batches, materialize, texts_of

END_ID = 0
#: Ranks are counted within salted shares of a length, of about so many rows.
SHARE_ROWS = 4000
#: The vocabulary's special token; a text that holds its name gives its id, as the ``tokenizers`` library does by default.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: White space as the pattern's ``\s`` reads it; the pattern's stack doesn't hold a run of about a million.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """Text to ids (uint32) by the byte-level BPE of ``byte_bpe_50k``; once per worker.

    The ids are those of the ``tokenizers`` library with ``byte_bpe_50k.json``
    (the tests compare them). They are computed by ``tiktoken`` from the same
    vocabulary's ranks, which takes a sixth of the time. Here special tokens'
    names are ordinary text, and very long white space raises an error; see
    ``text_encoder`` for whole texts.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy


def text_encoder(path: str | None = None) -> Callable[[str], np.ndarray]:
    """Whole texts to ids, those of ``Tokenizer.encode`` with its defaults.

    The special token's name stands for its id and parts the text. A long run
    of white space is one unit of the pattern, without its last character where
    something follows; it is merged without the pattern.
    """
    encode = encoder(path)
    unit = encode.__self__._core_bpe.encode_single_piece

    def plain(text: str) -> list[np.ndarray]:
        parts, done = [], 0
        for m in _LONG_SPACE.finditer(text) if len(text) >= LONG_SPACE else ():
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts += [encode(text[done : m.start()], disallowed_special=()), np.array(unit(text[m.start() : end].encode()), np.uint32)]
            done = end
        return [*parts, encode(text[done:], disallowed_special=())]

    def ids(text: str) -> np.ndarray:
        if SPECIAL not in text and len(text) < LONG_SPACE:
            return encode(text, disallowed_special=())
        parts: list[np.ndarray] = []
        for i, part in enumerate(text.split(SPECIAL)):
            parts += [np.array([SPECIAL_ID], np.uint32), *plain(part)] if i else plain(part)
        return np.concatenate(parts)

    return ids


def cut_points(length: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document; only the first piece may be shorter than the capacity."""
    first = length % capacity or capacity
    return [0, *range(first, length, capacity)]


def tokenized_pieces(df: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Per piece: id, piece, start, length and the CRC-32 of its ids."""
    kind = df.schema[id_col].dataType.simpleString()

    def start():
        encode = text_encoder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, text in enumerate(texts_of(batch, 1)):
                ids = encode(text).astype("<u4").tobytes() + end
                n = len(ids) // 4
                at = cut_points(n, capacity)
                rows += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True))]
            row, piece, at, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0).take(row), piece.cast(pa.int32()), at, length, crc], ["id", "piece", "start", "length", "ids_crc32"])

        return work

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Plan:
    """Places for ranked items of each size.

    A slot (size, rank, per_bin, bins, bin, offset) says: items of the size from
    that rank on go, ``per_bin`` side by side from ``offset`` on, into ``bins``
    sequences from ``bin`` on.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.n_bins, self.slots = capacity, 0, []
        self.rank = dict.fromkeys(counts, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.sorted_gaps: list[int] = []
        if counts and not 1 <= min(counts) <= max(counts) <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        left = {s: n for s, n in counts.items() if n}
        self._match(left)
        self._best_fit(left)
        self.slots.sort()
        table = np.array(self.slots, np.int64).reshape(-1, 6)
        self.key, self.table = (table[:, 0] << 48) + table[:, 1], table

    def _place(self, size: int, per_bin: int, bins: int, start: int, offset: int) -> None:
        self.slots.append((size, self.rank[size], per_bin, bins, start, offset))
        self.rank[size] += per_bin * bins

    def _open(self, bins: int) -> int:
        self.n_bins += bins
        return self.n_bins - bins

    def _leave(self, gap: int, start: int, bins: int) -> None:
        if gap and bins:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.sorted_gaps, gap)
            self.gaps[gap].append((start, bins))

    def _match(self, left: dict[int, int]) -> None:
        """Pairs of items above a third of the capacity, longest first, each with the longest that fits."""
        sizes = sorted(s for s in left if 3 * s > self.capacity)
        while sizes:
            size = sizes[-1]
            room = self.capacity - size
            i = bisect.bisect_right(sizes, room) - 1
            if i == len(sizes) - 1 and left[size] == 1:
                i -= 1
            if i < 0:
                n = left[size]
                start = self._open(n)
                self._place(size, 1, n, start, 0)
                self._leave(room, start, n)
                left[size] = 0
            elif (other := sizes[i]) == size:
                n = left[size] // 2
                start = self._open(n)
                self._place(size, 2, n, start, 0)
                self._leave(room - size, start, n)
                left[size] -= 2 * n
            else:
                n = min(left[size], left[other])
                start = self._open(n)
                self._place(size, 1, n, start, 0)
                self._place(other, 1, n, start, size)
                self._leave(room - other, start, n)
                left[size] -= n
                left[other] -= n
                if not left[other]:
                    del sizes[i]
            if not left[size]:
                sizes.pop()

    def _best_fit(self, left: dict[int, int]) -> None:
        """Shorter items, longest first, each run into the narrowest gap that holds it."""
        for size in sorted((s for s, n in left.items() if n), reverse=True):
            n = left[size]
            while n:
                i = bisect.bisect_left(self.sorted_gaps, size)
                if i < len(self.sorted_gaps):
                    gap = self.sorted_gaps[i]
                    start, bins = self.gaps[gap].pop()
                    if not self.gaps[gap]:
                        del self.gaps[gap], self.sorted_gaps[i]
                else:
                    gap = self.capacity
                    bins = -(-n // (gap // size))
                    start = self._open(bins)
                offset, fit = self.capacity - gap, gap // size
                whole = min(bins, n // fit)
                if whole:
                    self._place(size, fit, whole, start, offset)
                    self._leave(gap - fit * size, start, whole)
                    n -= fit * whole
                if whole < bins and n:
                    self._place(size, n, 1, start + whole, offset)
                    self._leave(gap - n * size, start + whole, 1)
                    n, whole = 0, whole + 1
                self._leave(gap, start + whole, bins - whole)

    def places(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the items with these sizes and ranks."""
        slot = self.table[np.searchsorted(self.key, (size << 48) + rank, "right") - 1]
        k = rank - slot[:, 1]
        return slot[:, 4] + k // slot[:, 2], slot[:, 5] + k % slot[:, 2] * slot[:, 0]


def ranked(pieces: DataFrame, total: int, size_col: str, order: Iterable[str]) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within equal ``size_col``, counted in salted shares."""
    shares = max(1, min(1 << 14, -(-total // SHARE_ROWS)))
    order = list(order)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(shares)).cast("int"))
    before = Window.partitionBy(size_col).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy(size_col, "salt").agg(F.count("*").alias("n"))
    sizes = sizes.select(size_col, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(size_col, "salt").orderBy(*order))
    return salted.withColumn("inside", inside).join(sizes, [size_col, "salt"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("before", "inside", "salt")


def pack_documents(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id and offset.

    ``capacity`` (at most 65,536) bounds the rows that reach the driver.
    """
    if not 1 <= capacity <= 1 << 16:
        raise ValueError("capacity must lie between 1 and 65,536")
    pieces = materialize(tokenized_pieces(df, capacity, id_col, text_col, tokenizer_path), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, offset = plan.places(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": bins, "offset": offset})

    rows = ranked(pieces, sum(counts.values()), "length", ["id", "piece", "start", "ids_crc32"])
    rows = rows.withColumn("place", place("length", "rank"))
    return rows.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
