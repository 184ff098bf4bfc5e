"""Repeated passages by a sparse suffix array.

Of all word suffixes of all documents only those are kept that start at
minimisers: of the first ``window`` positions of a run of ``length`` words the
one with the smallest 4-word hash. The choice depends on the run's words alone,
so two copies of it keep the same suffix, whose next length - window + 1 words
(its core) lie in the run; each run has one such anchor.

1. Suffixes whose core's hash occurs in one document only are left out.
2. The others are sorted as a suffix array: by the core (as a 128-bit hash, equal
   for equal words), then by the words that follow, then by the words before,
   nearest first. Neighbours are compared by their common prefix, which tells how
   far a match goes on to the right; from there it is extended to the left word by
   word. So every run of ``length`` words that is anchored at a suffix finds all
   other documents that hold it, and the first of these.
3. Runs that follow each other and have their first copy in the same place are
   joined into passages.

Ranges of the order are dealt to tasks, and what is in a range of its own group
is dealt by document, so that a passage that a third of all documents share is
spread over many tasks. Groups of equal cores of more than ``large`` suffixes, and
those at a range's ends, are settled run by run and not in one place: suffixes
with the same words around the core are one context, contexts give their runs as
128-bit hashes, these are counted, and contexts learn of their runs' first places.

Defined cases: null text counts as empty; documents under ``length`` words have
no passages; repeats inside one id (also rows that repeat an id) don't count;
rows without an id are left out; of several first places in one document the
lowest counts; an empty table gives no passages. Words are split at ASCII white
space, A-Z lowered; positions count words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolweave.llm.common import give_back, map_batches, materialize, texts_of

LENGTH = 50
WINDOW = 20
GRAM = 4
#: Parts of a range of the first sort, by key: suffixes with their words take more room than their keys.
PARTS = 16
#: Suffixes of a group that one task compares by words.
LARGE = 64
CHUNK_CHARS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_CHECK = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def _powers(base: int | np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word."""
    if not words:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(code)) - 1
    return _mixed(np.add.reduceat(code * _powers(_BASE, int(size.max()))[left], end - size) + size.astype(np.uint64))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    total = np.append(np.uint64(0), np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64))
    return _mixed((total[n:] - total[:-n]) * _powers(_INVERSE, len(h) - n + 1))


def anchors(h: np.ndarray, end: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first run, last run) of the anchors of all runs of ``length`` words that end within a document.

    ``h`` are the words' hashes of documents one after another that end at
    ``end``. A run's anchor is the first smallest 4-word hash among its first
    ``window`` positions; the runs of an anchor follow each other.
    """
    order = run_hashes(h, GRAM)
    if len(h) < length:
        return (np.zeros(0, np.int64),) * 3
    starts = np.arange(len(h) - length + 1)
    starts = starts[starts + length <= end[np.searchsorted(end, starts, "right")]]
    view = np.lib.stride_tricks.sliding_window_view(order, window)
    at = starts + view.argmin(1)[starts]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    return at[first], starts[first], starts[np.append(first[1:], len(at)) - 1] if len(at) else starts


def word_lists(texts: list[str], characters: int = CHUNK_CHARS) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Word lists of consecutive texts, about so many characters at a time, with the first text's number."""
    part: list[list[bytes]] = []
    size = first = 0
    for i, t in enumerate(texts):
        part.append(t.encode("utf-8", "surrogatepass").lower().split())
        size += len(t)
        if size >= characters:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def sparse_suffixes(docs: DataFrame, length: int, window: int) -> DataFrame:
    """(key, id, pos) of the kept suffixes of ``docs`` (id, text); key is the core's hash."""
    core = length - window + 1

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys, rows, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, words in word_lists(texts_of(batch, 1)):
                n = np.array([len(w) for w in words])
                end = np.cumsum(n)
                h = word_hashes([x for w in words for x in w])
                at, *_ = anchors(h, end, length, window)
                doc = np.searchsorted(end, at, "right")
                keys.append(run_hashes(h, core)[at])
                rows.append(doc + first)
                places.append(at - (end - n)[doc])
            key, row, place = (np.concatenate(x) for x in (keys, rows, places))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32))], ["key", "id", "pos"])

        return work

    return map_batches(docs, start, "key bigint, id bigint, pos int")


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, pos, kind) of sorted (key, id, pos): 0 the key has two ids or more, 1 not known here.

    1 is for the keys at both ends of the partition; for these also 2, the
    smallest and largest id seen.
    """
    names = ["key", "id", "pos", "kind"]
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    key_now = low = high = None
    shared = False  # whether the run that is still open has two ids already
    at_start = True  # whether that run is the partition's first

    def rows(cols: list[np.ndarray], kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(len(cols[0]), kind, np.int32))], names)

    def marker(key: int, low: int, high: int) -> pa.RecordBatch:
        return rows([np.array([key, key]), np.array([low, high]), np.zeros(2, np.int32)], 2)

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(new[0]):
            continue
        if key_now is not None and new[0][0] != key_now:  # the open run ended with the last batch
            if at_start:
                yield marker(key_now, low, high)
                if not shared and len(held[0]):
                    yield rows(held, 1)
            held, shared, at_start, key_now = [x[:0] for x in held], False, False, None
        cols = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
        key, ids = cols[0], cols[1]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        start, end = np.append(0, cut), np.append(cut, len(key))
        many = ids[start] != ids[end - 1]
        many[0] |= shared
        first_low = low if key_now is not None else int(ids[0])
        if at_start and len(start) > 1:
            yield marker(int(key[0]), first_low, int(ids[end[0] - 1]))
            if not many[0]:
                yield rows([x[: end[0]] for x in cols], 1)
        keep = np.repeat(many, end - start)
        if keep.any():
            yield rows([x[keep] for x in cols], 0)
        last = start[-1]
        if len(start) > 1 or key_now is None:
            low = int(ids[last])
        high, key_now, shared = int(ids[-1]), int(key[-1]), bool(many[-1])
        at_start = at_start and len(start) == 1
        held = [x[last:] if not shared else x[:0] for x in cols]
    if key_now is not None:
        yield marker(key_now, low, high)
        if not shared:
            yield rows(held, 1)


def shared_rows(rows: DataFrame, name: str) -> DataFrame:
    """The rows (key, id, pos) whose key occurs with another id too, with the part of the ``range`` of the order by all three that holds them."""
    rows = materialize(rows, name)
    found = rows.repartitionByRange("key", "id", "pos").sortWithinPartitions("key", "id", "pos").mapInArrow(_compare_neighbours, "key bigint, id bigint, pos int, kind int")
    part = F.spark_partition_id() * PARTS + F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
    found = materialize(found.withColumn("range", part), name)
    cut = found.filter("kind = 2").groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("key")
    open_ = found.filter("kind = 1").join(cut, "key", "left_semi")
    return found.filter("kind = 0").unionByName(open_).select("key", "id", "pos", "range")


SUFFIX = "range int, key bigint, check bigint, after binary, before binary, id bigint, pos int, left int, right int"


def suffix_words(docs: DataFrame, matches: DataFrame, length: int, window: int) -> DataFrame:
    """The suffixes of ``matches`` (id, pos, range) with the words that their runs have around the core.

    ``after`` are those that follow it, ``before`` those before it, nearest
    first, each word with a blank behind it, so that the order of the bytes keeps
    equal beginnings together. The suffix's runs start from ``left`` to ``right``
    words before it.
    """
    core = length - window + 1
    by_doc = matches.groupBy("id").agg(F.collect_set(F.struct("pos", "range")).alias("at"))
    names = [c.split()[0] for c in SUFFIX.split(", ")]

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ranges, rows, keys, checks, afters, befores, places, lefts, rights = ([] for _ in range(9))
            lists = batch.column(2)
            for i, text in enumerate(texts_of(batch, 1)):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                h = word_hashes(words)
                at, low, high = anchors(h, np.array([len(h)]), length, window)
                asked = lists[i].values
                pos, order = np.unique(asked.field("pos").to_numpy(zero_copy_only=False), return_index=True)
                place = np.searchsorted(pos, at)
                mine = place < len(pos)
                mine[mine] = pos[place[mine]] == at[mine]
                at, low, high = at[mine], low[mine], high[mine]
                if not len(at):
                    continue
                ranges.append(asked.field("range").to_numpy(zero_copy_only=False)[order[place[mine]]])
                keys.append(run_hashes(h, core)[at])
                checks.append(run_hashes(_mixed(h ^ _CHECK), core)[at])
                spaced = [w + b" " for w in words]
                for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                    afters.append(b"".join(spaced[p + core : b + length]))
                    befores.append(b"".join(spaced[a:p][::-1]))
                rows.append(np.full(len(at), i))
                places.append(at)
                lefts.append(at - low)
                rights.append(at - high)
            if not rows:
                return None
            span, row, key, check, place, left, right = (np.concatenate(x) for x in (ranges, rows, keys, checks, places, lefts, rights))
            columns = [pa.array(span.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), pa.array(afters, pa.binary()), pa.array(befores, pa.binary()), batch.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (place, left, right))]
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    return map_batches(docs.join(by_doc, "id"), start, SUFFIX)


def word_ends(words: bytes) -> list[int]:
    """Byte positions after no, one, two ... of the words."""
    out, at = [0], 0
    while (at := words.find(b" ", at) + 1) > 0:
        out.append(at)
    return out


def common_words(a: bytes, b: bytes) -> int:
    """How many words two word sequences share at their start."""
    n = min(len(a), len(b))
    if a[:n] != b[:n]:
        low, high = 0, n  # the first byte that differs lies in [low, high)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
        n = low
    return a.count(b" ", 0, n)


Place = tuple[int, int]
#: For the runs that start from the first to the second number of words before a suffix: their first copy's suffix, and how many copies there are.
Found = tuple[int, int, Place, int]


class Context:
    """Suffixes of a group that have the same words around the core: their places and how far they match others."""

    def __init__(self, after: bytes, before: bytes, left: int, right: int):
        self.after, self.before, self.left, self.right = after, before, left, right
        self.places: list[Place] = []
        self.shares = 0  # words after the core that a neighbour shares

    def runs(self, tail: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(l, words before the core, words after it) of the run that starts l words before the suffix, for all its runs."""
        back, forth = word_ends(self.before), word_ends(self.after)
        for l in range(self.right, self.left + 1):
            yield l, self.before[: back[l]], self.after[: forth[tail - l]]


def in_two_documents(places: list[Place]) -> bool:
    return places[0][0] != places[-1][0]


def extend(contexts: list[Context], tail: int) -> list[list[Found]]:
    """Per context of a group of equal cores the runs that two documents or more hold.

    ``tail`` is how many words a run has beside the core. A run that starts
    ``l`` words before the suffix needs l words to the left and tail - l to the
    right; where no neighbour in the order shares so many to the right, only its
    own context holds it.
    """
    for a, b in zip(contexts, contexts[1:], strict=False):
        n = common_words(a.after, b.after)
        a.shares, b.shares = max(a.shares, n), max(b.shares, n)
    alike: dict[tuple[int, bytes, bytes], list[int]] = {}
    runs: list[list[tuple[int, Place, int]]] = [[] for _ in contexts]
    for i, c in enumerate(contexts):
        for l, before, after in c.runs(tail):
            if tail - l <= c.shares:
                alike.setdefault((l, before, after), []).append(i)
            elif in_two_documents(c.places):
                runs[i].append((l, c.places[0], len(c.places)))
    for (l, _, _), members in alike.items():
        ends = [contexts[i].places[k] for i in members for k in (0, -1)]
        if min(ends)[0] != max(ends)[0]:
            n = sum(len(contexts[i].places) for i in members)
            for i in members:
                runs[i].append((l, min(ends), n))
    out: list[list[Found]] = []
    for found in runs:
        joined: list[Found] = []
        for l, first, n in sorted(found):
            if joined and joined[-1][0] == l - 1 and joined[-1][2] == first:
                joined[-1] = l, joined[-1][1], first, max(n, joined[-1][3])
            else:
                joined.append((l, l, first, n))
        out.append(joined)
    return out


#: What a task tells of its suffixes. FOUND: runs from word low to high on, with their first copy and number of copies.
#: MEMBER: the suffix at word low of a large group, by context. RUN: the run that starts low words before a context's suffixes.
RUNS = "kind int, id bigint, low int, high int, first_doc bigint, shift int, n bigint, last_doc bigint, context binary, run binary"
FOUND, MEMBER, RUN = range(3)


class Group:
    """The suffixes of one core, in order: compared here if they are few, told context by context if they are many."""

    def __init__(self, key: tuple[int, int], tail: int, many: bool, tell: Callable[..., None]):
        self.key, self.tail, self.many, self.tell = key, tail, many, tell
        self.contexts: list[Context] = []
        self.size = 0

    def add(self, after: bytes, before: bytes, place: Place, left: int, right: int) -> None:
        if not self.contexts or self.contexts[-1].after != after or self.contexts[-1].before != before:
            self.contexts.append(Context(after, before, left, right))
        places = self.contexts[-1].places
        if places and places[-1] == place:
            return
        places.append(place)
        self.size += 1

    def open(self, last: bool) -> None:
        """Tell all contexts that are complete, and forget them; the last one is, if no suffix follows."""
        for c in self.contexts if last else self.contexts[:-1]:
            name = xxhash.xxh3_128_digest(b"%d,%d\0%s\0%s" % (*self.key, c.before, c.after))
            for id_, pos in c.places:
                self.tell(MEMBER, id=id_, low=pos, context=name)
            doc, pos = c.places[0]
            for l, before, after in c.runs(self.tail):
                run = xxhash.xxh3_128_digest(b"%d,%d,%d\0%s\0%s" % (*self.key, l, before, after))
                self.tell(RUN, low=l, first_doc=doc, shift=pos - l, n=len(c.places), last_doc=c.places[-1][0], context=name, run=run)
        self.contexts = [] if last else self.contexts[-1:]

    def settle(self, at_end: bool = False) -> None:
        if self.many or at_end:
            self.open(True)
        elif in_two_documents([min(c.places[0] for c in self.contexts), max(c.places[-1] for c in self.contexts)]):
            for c, found in zip(self.contexts, extend(self.contexts, self.tail), strict=True):
                for most, least, (doc, place), n in found:
                    for id_, pos in c.places:
                        self.tell(FOUND, id=id_, low=pos - most, high=pos - least, first_doc=doc, shift=place - pos, n=n)


def _extend_groups(batches: Iterator[pa.RecordBatch], tail: int, large: int) -> Iterator[pa.RecordBatch]:
    """RUNS of sorted suffixes. A range's first and last group may go on in other ranges and count as large."""
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in RUNS.split(", ")])
    out: list[dict] = []

    def tell(kind: int, **row) -> None:
        out.append({"kind": kind, **row})

    group: Group | None = None
    now = None
    for batch in batches:
        for span, key, check, after, before, id_, pos, left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group is None or now != span or group.key != (key, check):
                if group is not None:
                    group.settle(at_end=now != span)
                group, now = Group((key, check), tail, now != span, tell), span
            group.add(after, before, (id_, pos), left, right)
            if group.size > large:
                group.many = True
            if group.many and len(group.contexts) > 1:
                group.open(False)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    if group is not None:
        group.settle(at_end=True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)
    out.clear()
    del group
    give_back()


def shared_runs(suffixes: DataFrame, tail: int, large: int = LARGE) -> DataFrame:
    """(id, low, high, first_doc, shift, n): runs from word ``low`` to ``high`` on have their first copy ``shift`` words on in first_doc, and n copies."""
    ranged = suffixes.repartition("range").sortWithinPartitions("range", "key", "check", "after", "before", "id", "pos")
    told = materialize(ranged.mapInArrow(lambda batches: _extend_groups(batches, tail, large), RUNS), "runs")
    runs = told.filter(F.col("kind") == RUN)
    # counts combine before the shuffle; written, so that nothing keeps Spark from splitting a hot run in the join
    counted = runs.groupBy("run").agg(F.min(F.struct("first_doc", "shift")).alias("first"), F.sum("n").alias("n"), F.min("first_doc").alias("least"), F.max("last_doc").alias("most"))
    known = materialize(counted.filter("least <> most").select("run", F.col("first.first_doc").alias("first_doc"), F.col("first.shift").alias("first_low"), "n"), "known")
    per_context = runs.select("run", "context", "low").join(known, "run").select("context", "low", "first_doc", (F.col("first_low") + F.col("low")).alias("place"), "n").distinct()
    line = ["context", "first_doc", "place"]
    islands = per_context.withColumn("island", F.col("low") - F.row_number().over(Window.partitionBy(*line).orderBy("low")))
    islands = materialize(islands.groupBy(*line, "island").agg(F.max("low").alias("most"), F.min("low").alias("least"), F.max("n").alias("n")), "islands")
    members = told.filter(F.col("kind") == MEMBER).select("id", F.col("low").alias("pos"), "context")
    placed = members.join(islands, "context").select("id", (F.col("pos") - F.col("most")).alias("low"), (F.col("pos") - F.col("least")).alias("high"), "first_doc", (F.col("place") - F.col("pos")).alias("shift"), "n")
    return told.filter(F.col("kind") == FOUND).select(*placed.columns).unionAll(placed)


def _join_runs(batches: Iterator[pa.RecordBatch], length: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Passages of runs sorted by (id, first_doc, shift, low); a batch at a time is held, and the open passage."""
    held = None  # id, first_doc, shift, low, high, n
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            id_, low, high, doc, shift, n = row
            if held and held[:3] == [id_, doc, shift] and low <= held[4] + 1:
                held[4], held[5] = max(held[4], high), max(held[5], n)
                continue
            if held:
                out.append(held)
            held = [id_, doc, shift, low, high, n]
        if out:
            yield _passages(out, length, names)
    if held:
        yield _passages([held], length, names)


def _passages(rows: list[list[int]], length: int, names: list[str]) -> pa.RecordBatch:
    id_, doc, shift, low, high, n = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (id_, low, high + length, high - low + length, doc, low + shift, n)], names)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """The passages of ``length`` words or more that occur in another document too, each with its class.

    Per passage of a document: id, start_word, end_word, n_words, first_doc,
    first_word, n_copies. (first_doc, first_word) is the passage's first copy, by
    id and position, and names its class: all copies have it, its own included.
    n_copies is the number of places that hold a run of ``length`` words of the
    passage, the most of any of its runs. Where neighbouring runs have their
    first copies in different places a passage ends and the next one, which
    overlaps it, begins; together they cover all that repeats.

    The id column must be of a whole-number type.
    """
    if not GRAM <= length - window + 1:
        raise ValueError("length must exceed window by at least three words")
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    matches = shared_rows(sparse_suffixes(slim, length, window), "suffixes")
    runs = shared_runs(suffix_words(slim, matches.select("id", "pos", "range"), length, window), window - 1)
    names = ["id", "start_word", "end_word", "n_words", "first_doc", "first_word", "n_copies"]
    ordered = runs.repartition("id").sortWithinPartitions("id", "first_doc", "shift", "low")
    out = ordered.mapInArrow(lambda batches: _join_runs(batches, length, names), ", ".join(f"{c} bigint" for c in names))
    return out.withColumnRenamed("id", id_col)
