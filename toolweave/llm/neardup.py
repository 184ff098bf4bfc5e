"""Near-duplicates: a SimHash trie join within groups of sampled shingles.

The fingerprints of texts whose word shingles have a Jaccard similarity of 0.8
differ by about ten of 64 bits, too many to cut them into blocks of which some
agree. So texts meet in groups first. A text's distinct shingles are dealt by
their hash into 2^k classes of about three to six; the shingles of a class, as
one hash, are a key, for the first SLOTS classes. Similar texts agree on some
class almost surely, others hardly ever. Texts near a power of two take the
finer classes too, so that two similar texts have classes of one size.

In a group the texts' fingerprints form a binary trie that is joined with itself
(``simhash.trie_pairs``) within ``BUDGET`` bits. Of its pairs those go on whose
similarity by the smallest SKETCH shingle hashes is high enough, best first, and
only as far as they link parts of the group that are not linked yet. Every such
link is verified on all shingles of both texts, and components of verified links
are one class of near-duplicates.

A key that more than GROUP texts have is a passage's, or that of a crowd of near
copies. All its texts are candidates for links with HEADS of them, chosen by
hashes, and with those that agree with them on two classes, or four, eight, all
SLOTS of them. What these links leave apart is compared whole: every two texts of
the crowd that are not of one class yet meet in some block of about GROUP texts
(``crowd_blocks``), so no pair that shares a key goes unseen. Equal word
sequences are one text from the start.

Defined cases: null text counts as empty; words are split at ASCII white space,
A-Z lowered; all texts without words are equal; fewer words than a shingle make
one shingle of all words; similarity counts distinct shingles; rows that repeat
are one document; an empty table has no groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import give_back, map_batches, materialize, texts_of
from toolweave.llm.components import connected_components
from toolweave.llm.repeats import run_hashes, word_hashes, word_lists
from toolweave.llm.simhash import majority, trie_pairs

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits: of 64, similar texts differ by 10 on average (standard deviation 3).
BUDGET = 20
SLOTS = 16
CLASS = 3
GROUP = 1024
HEADS = 4
SKETCH = 128
#: Texts are hashed in lists of about so many characters.
CHUNK_CHARS = 500_000
#: How far below the similarity an estimate from sketches may be.
SLACK = 0.1
_SPREAD = np.uint64(0xA0761D6478BD642F)


def levels_of(n: int, similarity: float) -> list[int]:
    """The powers of two that ``n`` shingles are dealt into: texts as similar as asked for have one in common."""
    exact = math.log2(max(1.0, n / CLASS))
    low = math.floor(exact)
    return [low, low + 1] if n < CLASS * SLOTS or exact - low > 1 + math.log2(similarity) else [low]


def class_keys(hashes: np.ndarray, level: int) -> list[int]:
    """A key per class of the shingles' hashes, 0 where a class is empty."""
    slots = min(SLOTS, 1 << level)
    at = (hashes & np.uint64((1 << level) - 1)).astype(np.int64)
    mine = at < slots
    total, full = np.zeros(slots, np.uint64), np.zeros(slots, bool)
    np.add.at(total, at[mine], (hashes[mine] ^ (hashes[mine] >> np.uint64(29))) * _SPREAD)
    full[at[mine]] = True
    keys = (total + np.arange(1, slots + 1, dtype=np.uint64) * _SPREAD + np.uint64(level)) * np.uint64(0xE7037ED1A0B428DB)
    keys |= np.uint64(1)
    return np.where(full, keys, np.uint64(0)).view(np.int64).tolist()


def shingle_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Per row: id, row_key (of the raw text), node (of the word sequence), fp, the sorted 32-bit shingle hashes, class keys by level."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "row_key", "node", "fp", "shingles", "levels"]

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, prints, sets, levels = [], [], [], []
            for _, sequences in word_lists(texts_of(batch, 2), CHUNK_CHARS):
                all_, at = run_hashes(word_hashes([w for s in sequences for w in s]), shingle), 0
                for words in sequences:
                    node = xxhash.xxh3_128_digest(b" ".join(words))
                    if len(words) >= shingle:
                        hashes = np.unique(all_[at : at + len(words) - shingle + 1])
                    else:
                        hashes = np.frombuffer(node[:8], "<u8") if words else np.zeros(0, np.uint64)
                    at += len(words)
                    nodes.append(node)
                    prints.append(int(majority(hashes).view(np.int64)) if len(hashes) else 0)
                    sets.append(np.unique((hashes >> np.uint64(32)).astype("<u4")).tobytes())
                    levels.append([class_keys(hashes, k) for k in levels_of(len(hashes), similarity)])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(prints, pa.int64()), pa.array(sets, pa.binary()), pa.array(levels, pa.list_(pa.list_(pa.int64())))], names)

        return work

    rows = docs.select(F.col(id_col).alias("id"), row_key(text_col).alias("row_key"), F.col(text_col).alias("text"))
    return map_batches(rows, start, f"id {kind}, row_key bigint, node binary, fp bigint, shingles binary, levels array<array<bigint>>")


def row_key(text_col: str) -> Column:
    """Tells rows with one id and different texts apart, without Python."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _keyed(nodes: DataFrame, width: int) -> DataFrame:
    """(node, level, slot, key): keys of ``width`` neighbouring classes of a level, where the first is not empty."""
    ring = lambda keys, slot: F.slice(F.concat(keys, keys), slot + 1, width)
    key = F.col("key") if width == 1 else F.xxhash64(ring(F.col("keys"), F.col("slot")))
    rows = nodes.select("node", F.posexplode("levels").alias("level", "keys")).select("node", "level", "keys", F.posexplode("keys").alias("slot", "key")).filter("key <> 0")
    return rows.select("node", "level", "slot", key.alias("key"))


def key_groups(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """((key, node) of groups of 2 to GROUP texts, candidate links (a, b) of larger ones' texts with their heads, (key, node) of the larger ones of single classes).

    Texts that share a key of several classes share those of the single ones too.
    """
    heads = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node")) for k in range(HEADS)])
    groups, stars, open_, crowds, width = [], [], None, None, 1
    while True:
        keyed = _keyed(nodes, width)
        if open_ is not None:
            keyed = keyed.join(open_, ["node", "level", "slot"])
        sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
        groups.append(keyed.join(sizes.filter(F.col("n") <= GROUP).select("key"), "key").select("key", "node"))
        large = sizes.filter(F.col("n") > GROUP).select("key")
        if large.isEmpty():
            break
        open_ = materialize(keyed.join(large, "key").select("key", "node", "level", "slot"), "crowded")
        crowds = open_.select("key", "node") if crowds is None else crowds
        chosen = open_.groupBy("key").agg(F.array_distinct(F.transform(heads, lambda h: h["node"])).alias("heads"))
        stars.append(open_.join(chosen, "key").select("node", F.explode("heads").alias("head")).filter("node <> head"))
        open_ = open_.drop("key")
        if width >= SLOTS:
            break
        width *= 2
    ends = nodes.sparkSession.createDataFrame([], "a binary, b binary")
    for s in stars:
        ends = ends.unionAll(s.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")))
    out = groups[0]
    for g in groups[1:]:
        out = out.unionAll(g)
    return out, ends.distinct(), crowds


def crowd_blocks(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node): blocks of about GROUP texts in which every two texts of a crowd meet that ``roots`` (node, root) leave apart.

    Of two such texts one at least is outside the crowd's largest class: parts of
    those outside meet parts of the whole crowd. The blocks of a crowd grow with the
    product of both; each is bounded, and they are dealt over all tasks.
    """
    placed = materialize(crowds.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "crowds")
    shares = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = shares.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("most < n")
    parts = lambda n: F.ceil(n / max(1, GROUP // 2)).cast("int")
    sizes = sizes.select("key", "main", parts(F.col("n") - F.col("most")).alias("outside"), parts(F.col("n")).alias("all"))
    rows = placed.join(sizes, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = rows.filter("root <> main").select("key", "node", mine("outside").alias("i"), every("all").alias("j"))
    right = rows.select("key", "node", every("outside").alias("i"), mine("all").alias("j"))
    return left.unionAll(right).select(F.xxhash64("key", "i", "j").alias("key"), "node").distinct()


def _expand(i: np.ndarray, j: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of pairs of distinct fingerprints; the members of k are start[k] up to start[k + 1]."""
    n, m = start[i + 1] - start[i], start[j + 1] - start[j]
    each = n * m
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return np.repeat(start[i], each) + at // np.repeat(m, each), np.repeat(start[j], each) + at % np.repeat(m, each)


def spanning_links(sketches: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, most similar first, of the pairs (i, j) whose sketches are similar enough."""
    members = np.unique(np.concatenate([i, j]))
    place = np.searchsorted(members, i), np.searchsorted(members, j)
    mine = [sketches[k] for k in members]
    values, column, seen = np.unique(np.concatenate(mine), return_inverse=True, return_counts=True)
    row, common = np.repeat(np.arange(len(mine)), [len(s) for s in mine]), seen > 1
    column, row = (np.cumsum(common) - 1)[column][common[column]], row[common[column]]
    shared = np.zeros(len(i))
    for first in range(0, int(common.sum()), 4096):
        block = np.zeros((len(mine), 4096), np.float32)
        here = (column >= first) & (column < first + 4096)
        block[row[here], column[here] - first] = 1
        shared += (block @ block.T)[place] if len(i) > len(mine) else (block[place[0]] * block[place[1]]).sum(1)
    # a sketch that isn't the whole set knows nothing beyond its last value
    whole = sizes[members] <= SKETCH
    limit = np.where(whole, 1 << 32, [int(s[-1]) if len(s) else 0 for s in mine])
    upto = np.stack([np.searchsorted(s, limit, "right") for s in mine])
    union = upto[place] + upto[place[1], place[0]] - shared
    alike = shared / np.maximum(union, 1)
    good = np.flatnonzero(alike >= similarity - np.where(whole[place[0]] & whole[place[1]], 1e-9, SLACK))
    root = list(range(len(mine)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for k in good[np.argsort(-alike[good], kind="stable")].tolist():
        a, b = find(int(place[0][k])), find(int(place[1][k]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i[k]), int(j[k])))
    return out


def _join_groups(batches: Iterator[pa.RecordBatch], budget: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the groups of rows sorted by key: (key, node, fp, size, sketch)."""

    def linked(table: pa.Table) -> pa.RecordBatch:
        key, fp = table.column(0).to_numpy(), table.column(2).to_numpy().view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        node, size = table.column(1).take(order).to_pylist(), table.column(3).to_numpy()[order]
        sketches = [np.frombuffer(s, "<u4") for s in table.column(4).take(order).to_pylist()]
        # equal fingerprints of a group are one leaf
        new = np.append(True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1]))
        first = np.flatnonzero(new)
        start = np.append(first, len(key))
        cut = np.flatnonzero(key[first][1:] != key[first][:-1]) + 1
        lo, hi = np.append(0, cut), np.append(cut, len(first))
        pairs = [_expand(i, j, start) for i, j in trie_pairs(fp[first], lo, hi, budget)]
        many = np.flatnonzero(np.diff(start) > 1)
        same = _expand(many, many, start)
        pairs.append(tuple(x[same[0] < same[1]] for x in same))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        group = np.searchsorted(start[lo], np.minimum(i, j), "right")
        order = np.argsort(group, kind="stable")
        i, j, group = i[order], j[order], group[order]
        out: list[tuple[int, int]] = []
        bounds = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            out += spanning_links(sketches, size, i[a:b], j[a:b], similarity)
        ends = [sorted((node[a], node[b])) for a, b in out]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # this batch's last key may go on in the next
        if held and held[-1].column(0)[0].as_py() != key[0] or last and held:
            yield linked(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held, batch = [], batch.slice(last)
        elif last:
            yield linked(pa.Table.from_batches([batch.slice(0, last)]))
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield linked(pa.Table.from_batches(held))
    held.clear()
    give_back()


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' whole shingle sets are similar enough."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        return work

    return map_batches(links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b"), start, "a binary, b binary")


def near_duplicate_links(prints: DataFrame, nodes: DataFrame, budget: int, similarity: float) -> DataFrame:
    """Verified links (a, b) between the distinct texts ``nodes`` that connect near-duplicates."""
    groups, stars, crowds = key_groups(nodes)
    groups, stars = materialize(groups, "groups"), materialize(stars, "stars")
    needed = groups.select("node").unionAll(stars.select(F.col("a").alias("node"))).unionAll(stars.select(F.col("b").alias("node")))
    if crowds is not None:
        needed = needed.unionAll(crowds.select("node"))
    # equal texts combine before the shuffle
    sets = prints.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("shingles").alias("shingles"))
    sets = materialize(sets.join(needed.distinct(), "node", "left_semi"), "sets")
    sketched = sets.select("node", "fp", (F.octet_length("shingles") / 4).cast("long").alias("size"), F.substring("shingles", 1, 4 * SKETCH).alias("sketch"))

    def linked(groups: DataFrame) -> DataFrame:
        rows = groups.join(sketched, "node").select("key", "node", "fp", "size", "sketch")
        rows = rows.repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(lambda batches: _join_groups(batches, budget, similarity), "a binary, b binary")

    links = materialize(linked(groups).unionAll(stars).distinct(), "candidates")
    links = verified(links, sets, similarity)
    if crowds is None:
        return links
    links = materialize(links, "verified")
    roots = connected_components(links)
    root = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    more = linked(crowd_blocks(crowds, roots)).distinct().join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return links.unionAll(verified(materialize(more.filter(apart).select("a", "b"), "candidates"), sets, similarity))


def near_duplicate_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, budget: int = BUDGET) -> DataFrame:
    """(id, row_key, n, class_id, stays) per distinct (id, text) of ``docs``.

    class_id is the smallest id of the near-duplicates (null only if there is no
    other); ``stays`` holds for one (id, text) of them, that with this id and,
    among several, the smallest row_key. n counts rows that repeat.
    """
    prints = materialize(shingle_prints(docs, id_col, text_col, shingle, similarity), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key"))
    nodes = materialize(prints.groupBy("node").agg(first.alias("first"), F.any_value("levels").alias("levels")), "nodes")
    roots = connected_components(near_duplicate_links(prints, nodes.select("node", "levels"), budget, similarity))
    placed = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"))
    placed = placed.join(heads, "root").select("node", "head")
    # counted before the join, so that no aggregate keeps Spark from splitting a hot text there
    counts = prints.groupBy("id", "row_key", "node").agg(F.count("*").alias("n"))
    stays = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("row_key") == F.col("head.row_key"))
    return materialize(counts.join(placed, "node").select("id", "row_key", "n", F.col("head.id").alias("class_id"), stays.alias("stays")), "decisions")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their near-duplicates: one row of each class.

    The row with the smallest id stays, one of those that repeat it. Only keys of
    dropped rows meet the texts in a join.
    """
    decided = near_duplicate_decisions(docs, id_col, text_col, shingle, similarity, budget)
    key = lambda rows: rows.select(F.col("id").alias("__near_id"), F.col("row_key").alias("__near_key"))
    same = F.col(id_col).eqNullSafe(F.col("__near_id")) & (row_key(text_col) == F.col("__near_key"))
    kept = docs.join(key(decided.filter("not stays")), same, "left_anti")
    repeated = key(decided.filter("stays and n > 1"))
    if not repeated.isEmpty():
        text = "__near_text"
        single = kept.join(repeated, same, "left_semi").withColumn(text, row_key(text_col)).dropDuplicates([id_col, text]).drop(text)
        kept = kept.join(repeated, same, "left_anti").unionByName(single)
    return kept
