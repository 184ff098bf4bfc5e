"""N-gram Jaccard join: sets of word shingles that overlap enough, by an R-tree over count vectors.

A document's set holds its distinct word shingles, as 64-bit hashes. Dealt into
groups by their low bits and counted, a set is a point; two sets share no more
shingles than the sum of their coordinates' minima, and none below a node more
than the sum of the minima with the node's greatest coordinates. The R-tree of
a cell is joined with itself from the top, node pairs that can't overlap enough
are dropped, and the pairs of points that survive are verified on their sets.

Cells come from the same points: sets with a similarity of ``percent`` differ in
at most tau shingles. Over more than tau blocks of groups, at least one block
is the same in both, so every set goes out with one key per block (the block's
shingles), for the band of sizes it is in and those its larger partners are in.
Sets that agree on a key are in one cell, and cells are closed under it, so
every link lies within a cell. Large cells are parted by other blocks likewise.

A cell's sets are joined in chunks: each with itself, each with the first, and,
of what is not in the cell's main component by then, each with all. Only links
between sets that are not connected yet are verified and handed on.

Defined cases: null text counts as empty; words are split at ASCII white space,
A-Z lowered; fewer words than a shingle are one shingle of all words; a document
without words has an empty set, links with nothing and is its own component;
equal sets link; rows that repeat give equal rows; a row without an id takes its
component from the others (null if there are none); an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import give_back, map_batches, materialize, texts_of
from toolweave.llm.components import connected_components
from toolweave.llm.neardup import row_key
from toolweave.llm.prefixtrie import running
from toolweave.llm.repeats import run_hashes, word_hashes, word_lists

SHINGLE = 4
PERCENT = 85
#: A chunk holds sets of a cell with about so many shingles in all, each counted as LEAST of them at least.
CHUNK = 1 << 20
LEAST = 256
#: Points of a leaf.
LEAF = 16
#: Bands of sizes grow by a half.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 3 // 2))
#: Shingles of a block that says enough, and how often a set with few such blocks is dealt anew.
FULL = 2
DEALS = 8
#: How often a cell larger than a chunk is parted by other blocks.
PARTINGS = 3
_SPREAD = np.uint64(0xA0761D6478BD642F)
_MIX = np.uint64(0xE7037ED1A0B428DB)
_HALF = np.uint64(32)


def shingle_sets(texts: list[str], shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, sequences in word_lists(texts):
        runs, at = run_hashes(word_hashes([w for s in sequences for w in s]), shingle), 0
        for words in sequences:
            if len(words) >= shingle:
                yield np.unique(runs[at : at + len(words) - shingle + 1])
            else:
                yield np.frombuffer(xxhash.xxh3_64_digest(b" ".join(words)), "<u8") if words else np.zeros(0, np.uint64)
            at += len(words)


def bands(n: int, percent: int) -> range:
    """The bands of sizes in which a set of ``n`` meets others: its own and those of larger partners."""
    return range(bisect_right(EDGES, n) - 1, bisect_right(EDGES, 100 * n // percent))


def block_keys(hashes: np.ndarray, percent: int, deals: int = 0) -> np.ndarray:
    """Keys of a sorted set: two linked, different sets have one in common. ``deals`` picks other blocks altogether.

    Of the blocks with ``FULL`` shingles at least the largest go out, one more
    than shingles can differ: the set whose smallest of these is larger has an
    equal one among them that the other gives too. A set with fewer such blocks
    gives them all and takes part in another deal, as its partners do then.
    """
    keys = [np.zeros(0, np.uint64)]
    for band in bands(len(hashes), percent) if len(hashes) else ():
        most = 2 * (EDGES[band + 1] - 1) * (100 - percent) // (100 + percent)
        if not most:  # sets of this size link only if they are equal
            continue
        blocks = most + 1 + most // 2
        for deal in range(deals * DEALS, (deals + 1) * DEALS):
            h = hashes
            if deal:
                h = (hashes ^ (hashes >> np.uint64(29)) ^ np.uint64(deal)) * _SPREAD
                h = np.sort((h ^ (h >> _HALF)) * _MIX)
            at = ((h >> _HALF) * np.uint64(blocks)) >> _HALF
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            size = np.diff(np.append(first, len(h)))
            name = np.uint64((band << 16 | deal) << 40) + at[first]
            found = _mixed(np.add.reduceat(_mixed(h), first) ^ _mixed(name))
            full = np.flatnonzero(size >= FULL)
            if len(full) > most:
                order = np.lexsort((found[full], size[full]))
                keys.append(found[full[order[len(full) - most - 1 :]]])
                break
            keys.append(found[full])
        else:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at[first], assume_unique=True)
            keys += [found, _mixed(_mixed(np.uint64((band << 16 | deal) << 40) + empty))]
    return np.concatenate(keys)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _SPREAD
    return (h ^ (h >> np.uint64(29))) * _MIX


def set_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Per row: id, row_key (of the raw text), node (of the set), n, keys; a task gives the keys of equal sets once."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        seen: set[bytes] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, keys = [], [], []
            for hashes in shingle_sets(texts_of(batch, 2), shingle):
                node = xxhash.xxh3_128_digest(hashes.tobytes())
                nodes.append(node)
                sizes.append(len(hashes))
                keys.append(np.zeros(0, np.int64) if node in seen else block_keys(hashes, percent).view(np.int64))
                seen.add(node)
            ends = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists], ["id", "row_key", "node", "n", "keys"])

        return work

    rows = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("row_key"), F.col(text_col).alias("text"))
    return map_batches(rows, start, f"id {kind}, row_key bigint, node binary, n bigint, keys array<bigint>")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, row) sorted: (key, a, b), a row and the first of its key; for the partition's first and last key also with a null b."""

    def out(key: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], ["key", "a", "b"])

    ends: list[tuple[int, int]] = []
    for batch in batches:
        key, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.append(not ends or ends[-1][0] != key[0], key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(head < 0, ends[-1][1] if ends else 0, row[np.maximum(head, 0)])
        pairs = np.unique(np.stack([first[~new], row[~new]], 1), axis=0) if not new.all() else np.zeros((0, 2), np.int64)
        if len(pairs):
            yield out(np.zeros(len(pairs), np.int64), np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]))
        ends = [ends[0] if ends else (int(key[0]), int(first[0])), (int(key[-1]), int(first[-1]))]
    if ends:
        marks = np.array(sorted(set(ends)), np.int64)
        yield out(marks[:, 0].copy(), marks[:, 1].copy(), None)
    give_back()


def cells(keyed: DataFrame) -> DataFrame:
    """(row, cell) of the rows that share a key of ``keyed`` (key, row) with others.

    Keys are dealt by range together with their rows, so that a frequent one is
    parted; its parts meet by the first rows that they have seen.
    """
    found = materialize(keyed.repartitionByRange("key", "row").sortWithinPartitions("key", "row").mapInArrow(_chained, "key bigint, a bigint, b bigint"), "chained")
    marks = found.filter("b is null").select("key", F.col("a").alias("b"))
    heads = marks.groupBy("key").agg(F.min("b").alias("a"))
    links = found.filter("b is not null").select("a", "b").unionAll(marks.join(heads, "key").filter("a <> b").select("a", "b"))
    return connected_components(links.distinct()).select(F.col("node").alias("row"), F.col("root").alias("cell"))


def large_cells(members: DataFrame) -> DataFrame:
    """(cell, size) of the cells that are more than a chunk."""
    return members.groupBy("cell").agg(F.sum(F.greatest("n", F.lit(LEAST))).alias("size")).filter(F.col("size") > CHUNK)


def parted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``members`` (row, cell, n) of large cells, in smaller cells: by keys of other blocks, as long as that parts them."""
    before = None
    for deals in range(1, PARTINGS + 1):
        large = large_cells(members)
        size = large.agg(F.sum("size")).first()[0]
        if not size or before and size > 0.9 * before:
            break
        before = size

        def start(deals: int = deals):
            def work(batch: pa.RecordBatch) -> pa.RecordBatch:
                keys = [block_keys(np.frombuffer(s, "<u8"), percent, deals).view(np.int64) for s in batch.column(2).to_pylist()]
                ends = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], ["row", "cell", "keys"])

            return work

        rows = members.join(large.select("cell"), "cell").join(sets, "row").select("row", "cell", "shingles")
        keyed = map_batches(rows, start, "row bigint, cell bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "row", "cell").select(F.xxhash64("cell", "key").alias("key"), "row")
        parts = cells(keyed).withColumnRenamed("cell", "part")
        kept = members.join(large.select("cell"), "cell", "left_anti")
        members = materialize(kept.unionByName(members.join(large.select("cell"), "cell").join(parts, "row").select("row", F.col("part").alias("cell"), "n")), "members")
    return members


class CountTree:
    """Points in leaves; every level has, per node, its slice of the points, greatest coordinates and least and greatest size."""

    def __init__(self, sets: list[np.ndarray], groups: int, levels: int) -> None:
        points = np.stack([np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups) for s in sets]).astype(np.int32)
        size = np.array([len(s) for s in sets])
        order = np.arange(len(sets))
        for level in range(levels):  # each node is parted at the median of its size, then of its widest coordinate
            edge = len(order) * np.arange((1 << level) + 1) // (1 << level)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                mine = order[a:b]
                by = size[mine] if level < 2 else points[mine, np.argmax(points[mine].max(0) - points[mine].min(0))]
                order[a:b] = mine[np.argsort(by, kind="stable")]
        self.order, self.points, self.size = order, points[order], size[order]
        self.edges = [len(order) * np.arange((1 << k) + 1) // (1 << k) for k in range(levels + 1)]
        self.most = [np.maximum.reduceat(self.points, e[:-1]) for e in self.edges]
        self.least = [np.minimum.reduceat(self.size, e[:-1]) for e in self.edges]
        self.largest = [np.maximum.reduceat(self.size, e[:-1]) for e in self.edges]


def _needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two linked sets whose sizes sum up to ``sizes``."""
    return -(-percent * sizes // (100 + percent))


def joined(x: CountTree, y: CountTree, percent: int, itself: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per pair of leaves that may hold links: both leaves' first places, and the pairs of places in them that may be links."""
    i = j = np.zeros(1, np.int64)
    for level in range(len(x.edges)):
        if level:
            i, j = (2 * i[:, None] + [0, 0, 1, 1]).ravel(), (2 * j[:, None] + [0, 1, 0, 1]).ravel()
        keep = (i <= j) if itself else np.ones(len(i), bool)
        keep &= (100 * x.largest[level][i] >= percent * y.least[level][j]) & (100 * y.largest[level][j] >= percent * x.least[level][i])
        i, j = i[keep], j[keep]
        bound = np.concatenate([np.zeros(0, np.int64), *(np.minimum(x.most[level][i[k : k + 256]], y.most[level][j[k : k + 256]]).sum(1) for k in range(0, len(i), 256))])
        keep = bound >= _needed(x.least[level][i] + y.least[level][j], percent)
        i, j = i[keep], j[keep]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        (p, q), (r, s) = x.edges[-1][a : a + 2], y.edges[-1][b : b + 2]
        bound = np.stack([np.minimum(x.points[k], y.points[r:s]).sum(1) for k in range(p, q)])
        good = bound >= _needed(x.size[p:q, None] + y.size[None, r:s], percent)
        if itself and a == b:
            good = np.triu(good, 1)
        left, right = np.nonzero(good)
        if len(left):
            yield int(p), int(r), left + p, right + r


def linked(sets: list[np.ndarray], parts: list[int], known: list, percent: int) -> list[tuple[int, int]]:
    """Links that connect ``sets``, part 0 with itself, or with part 1 where there is one; ``known`` tells which are connected already."""
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    first: dict = {}
    for k, c in enumerate(known):
        root[k] = first.setdefault(c, k)
    sides = [[k for k, p in enumerate(parts) if p == side] for side in (0, 1)]
    itself = not sides[1]
    sides = [sides[0], sides[0]] if itself else sides
    if not sides[0]:
        return []
    groups = min(1024, max(64, 1 << (max(map(len, sets)) // 2).bit_length()))
    levels = max(0, (min(map(len, sides)) - 1) // LEAF).bit_length()
    trees = [CountTree([sets[k] for k in s], groups, levels) for s in sides[: 1 if itself else 2]]
    places = [np.array(s)[t.order] for s, t in zip(sides, [trees[0], trees[-1]], strict=True)]
    out = []
    for _, _, left, right in joined(trees[0], trees[-1], percent, itself):
        for a, b in zip(places[0][left].tolist(), places[1][right].tolist(), strict=True):
            if (u := find(a)) == (v := find(b)):
                continue
            common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[max(u, v)] = min(u, v)
                out.append((a, b))
    return out


def _join_tasks(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (task, part, row, known, shingles) sorted by task: links (a, b)."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        # a text that repeats may have been hashed by several tasks
        task, part, name, known, sets = zip(*{row[1:3]: row for row in rows}.values(), strict=True)
        pairs = linked([np.frombuffer(s, "<u8") for s in sets], list(part), list(known), percent)
        return pa.RecordBatch.from_arrays([pa.array([name[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    if len(held) > 1:
                        yield work(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield work(held)
        del held
        give_back()

    return run


def _links(tasks: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links found by ``tasks`` (task, part, row, known)."""
    rows = tasks.join(sets, "row").select("task", "part", "row", "known", "shingles")
    rows = rows.repartition("task").sortWithinPartitions("task")
    return materialize(rows.mapInArrow(_join_tasks(percent), "a bigint, b bigint"), name)


def _placed(members: DataFrame) -> DataFrame:
    """``members`` with their chunk within their cell, in the order of their sizes."""
    rows = members.withColumn("weight", F.greatest("n", F.lit(LEAST)))
    at = running(rows, ["cell", "n", "row"], {"before": "weight"}, members.columns, "places")
    first = at.groupBy("cell").agg(F.min("before").alias("first"))
    return at.join(first, "cell").withColumn("chunk", F.floor((F.col("before") - F.col("first")) / CHUNK)).drop("before", "first")


def similar_sets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all linked sets of ``members`` (row, cell, n); ``sets`` has their (row, shingles)."""
    task = lambda *cols: F.concat_ws(":", *cols)
    own = lambda rows: rows.select(task("cell", "chunk").alias("task"), F.lit(0).alias("part"), "row", F.col("row").alias("known"))
    large = materialize(members.join(large_cells(members).select("cell"), "cell"), "large")
    links = _links(own(members.join(large.select("row"), "row", "left_anti").withColumn("chunk", F.lit(0))), sets, percent, "links")
    if large.isEmpty():
        return links
    sets = materialize(sets.join(large.select("row"), "row", "left_semi"), "sets")
    placed = materialize(_placed(parted(large, sets, percent)), "chunks")
    inside = _links(own(placed), sets, percent, "links")
    links = links.unionAll(inside)
    several = placed.groupBy("cell").agg(F.max("chunk").alias("last")).filter("last > 0")
    if several.isEmpty():
        return links

    def known(rows: DataFrame) -> DataFrame:
        roots = connected_components(inside).withColumnRenamed("node", "row")
        return materialize(rows.join(roots, "row", "left").withColumn("known", F.coalesce("root", "row")).drop("root"), "known")

    # each chunk with the first
    large = known(placed.join(several, "cell"))
    heads = large.filter("chunk = 0").withColumn("with", F.explode(F.sequence(F.lit(1), "last"))).select(task("cell", "with").alias("task"), F.lit(0).alias("part"), "row", "known")
    rest = large.filter("chunk > 0").select(task("cell", "chunk").alias("task"), F.lit(1).alias("part"), "row", "known")
    first = _links(heads.unionAll(rest), sets, percent, "links")
    inside, links = inside.unionAll(first), links.unionAll(first)
    # what is not in the main component, in chunks of its own, with each chunk whose sizes can match
    large = known(large.drop("known"))
    main = large.groupBy("cell", "known").count().groupBy("cell").agg(F.max_by("known", F.struct("count", "known")).alias("main"))
    odd = materialize(_placed(large.join(main, "cell").filter("known <> main").select("row", "cell", "n", "known")), "odd")
    spans = lambda rows, name: rows.groupBy("cell", F.col("chunk").alias(name)).agg(F.min("n").alias(f"{name}_low"), F.max("n").alias(f"{name}_high"))
    pairs = spans(odd, "x").join(spans(large, "y"), "cell").filter(f"100 * x_high >= {percent} * y_low and 100 * y_high >= {percent} * x_low").select("cell", "x", "y")
    side = lambda rows, name, part: rows.withColumnRenamed("chunk", name).join(pairs, ["cell", name]).select(task("cell", "x", "y").alias("task"), F.lit(part).alias("part"), "row", "known")
    return links.unionAll(_links(side(odd, "x", 0).unionAll(side(large, "y", 1)), sets, percent, "links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) per row of ``docs``."""
    prints = materialize(set_prints(docs, id_col, text_col, shingle, percent).withColumn("row", F.monotonically_increasing_id()), "prints")
    small = prints.drop("keys")
    celled = cells(prints.select(F.explode("keys").alias("key"), "row"))
    # equal sets of several tasks are one member; one of their rows stands for its text
    members = materialize(small.join(celled, "row").groupBy("node").agg(F.min_by(F.struct("row", "cell", "n", "id", "row_key"), "row").alias("at")).select("node", "at.*"), "members")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("row_key"), F.col(text_col).alias("text"))
    wanted = members.select("row", F.col("id").alias("wanted_id"), F.col("row_key").alias("wanted_key"))
    # dealt anew at any size: whether the other side could be sent to all executors depends on the input
    texts = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("row_key") == F.col("wanted_key"))).select("row", "text")

    def start():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            new = [k for k, row in enumerate(batch.column(0).to_pylist()) if not (row in seen or seen.add(row))]
            batch = batch.take(pa.array(new, pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(texts_of(batch, 1), shingle)], pa.binary())], ["row", "shingles"])

        return work

    sets = materialize(map_batches(texts, start, "row bigint, shingles binary"), "sets")
    links = similar_sets(members.select("row", "cell", "n"), sets, percent)
    roots = connected_components(links).withColumnRenamed("node", "row").join(members.select("row", "node"), "row").drop("row")
    nodes = small.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("row").alias("row"))
    # a set without links is its own root, under a number that no root has
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", -1 - F.col("row")))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = materialize(placed.join(least, "root").select("node", "component"), "components")
    return small.join(placed, "node", "left").select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
