"""Prefix trie of conversations, from a Cartesian tree over the LCP array of their sorted order.

Conversations are sequences of turns, turns are 128-bit hashes of role and text.
Equal sequences are one, with its number. The rest is sorted lexicographically:
by segments of ``SEGMENT`` turns, next those that agree on all of a segment by
the next one, so no more of a conversation is ever gathered; there are as many
rounds as the longest prefix that two different sequences share has segments.
Neighbours in that order have a longest common prefix (LCP) each.

The nearest smaller values to the left and right of an LCP are the ends of the
interval of sequences that share it. They are found per block of positions with
a stack; what leaves its block looks up, in the blocks' minima, the nearest block
that has a smaller value, and there its place. Equal values with one interval are
one node; the Cartesian tree is these intervals and the single sequences. A tree
edge over several depths stands for a node at each. What a subtree sums up is the
difference of running totals at the ends of its interval, in the order of the
trie from the top; the least conversation of an interval comes from block minima.

Nothing but one number per block of ``BLOCK`` sequences and one per range
partition reaches the driver.

Defined cases: turns without a conversation id are left out; null roles and texts
are empty; turns go by number, null first, and equal numbers by role, then text;
rows that repeat are turns of their own; a conversation without turns belongs to
the root; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import give_back, materialize

SEGMENT = 64
BLOCK = 1 << 16
#: Ids that are put into one text before a node's digest is taken.
RUN = 4096


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str], keep: list[str], name: str) -> DataFrame:
    """``keep`` and, per entry of ``sums``, the total of that long column over all rows before in ``order``.

    Rows are dealt by range and summed up inside each range; one row per range reaches the driver.
    """
    columns, values = list(sums), list(dict.fromkeys(sums.values()))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, *[F.col(v).cast("long").alias(f"__{v}") for v in values])
    schema = T.StructType([*rows.select(*keep).schema.fields, *[T.StructField(f"__{v}", T.LongType()) for v in values], *[T.StructField(c, T.LongType()) for c in columns], T.StructField("__range", T.LongType())])
    k, names = len(keep), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), dict.fromkeys(values, 0)
        for batch in batches:
            given = {v: batch.column(k + i).to_numpy() for i, v in enumerate(values)}
            totals = {v: at[v] + np.cumsum(x) for v, x in given.items()}
            sums_ = [pa.array(totals[sums[c]] - given[sums[c]]) for c in columns]
            if batch.num_rows:
                at = {v: int(x[-1]) for v, x in totals.items()}
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums_, pa.array(np.full(batch.num_rows, part))], names)

    rows = materialize(rows.mapInArrow(run, schema), name)
    found = sorted(rows.groupBy("__range").agg(*[F.sum(f"__{sums[c]}").alias(c) for c in columns]).collect())
    before = [list(accumulate((r[i + 1] for r in found), initial=0))[:-1] for i in range(len(columns))]
    kinds = ", ".join(["__range long", *[f"__before_{c} long" for c in columns]])
    offsets = df.sparkSession.createDataFrame([(r[0], *[b[n] for b in before]) for n, r in enumerate(found)], kinds)
    # one row per range, so this side may be sent to all executors
    return rows.join(F.broadcast(offsets), "__range").select(*keep, *[(F.col(c) + F.col(f"__before_{c}")).alias(c) for c in columns])


def ordered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, h1, h2, bytes): a conversation's turns from position 0 on."""
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumns({"one": F.lit(1), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role"), "bytes": F.octet_length("text").cast("long")})
    rows = running(rows, ["conv", F.asc_nulls_first("turn"), "role", "text"], {"at": "one"}, ["conv", "h1", "h2", "bytes"], "turns")
    first = rows.groupBy("conv").agg(F.min("at").alias("first"))
    return rows.join(first, "conv").select("conv", (F.col("at") - F.col("first")).alias("pos"), "h1", "h2", "bytes")


def with_shared_starts(turns: DataFrame, family: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """((conv, depth, h1, h2, bytes), (conv)): each conversation c with the first h turns of c - c % family in place of its own.

    h is crc32 of the decimal id modulo ``longest`` + 1; depth counts from 1.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    plan = sizes.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), (F.crc32(F.col("conv").cast("string")) % (longest + 1)).alias("h"))
    plan = materialize(plan.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("given")), "base", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0)))), "plan")
    heads = turns.filter(F.col("pos") < longest).withColumnRenamed("conv", "base").join(plan.select("conv", "base", "h"), "base").filter("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "h1", "h2", "bytes")
    own = turns.join(plan.select("conv", "h", "taken"), "conv").filter("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "h1", "h2", "bytes")
    return heads.unionAll(own), plan.select("conv")


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, n, copies) per distinct sequence, (conv, rep) of those with copies); rep is the least conversation that has it."""
    mark = {f"x{k}": F.bit_xor(F.xxhash64(F.lit(k), "depth", *h)) for k, h in ((1, ("h1", "h2")), (2, ("h2", "h1")))}
    marks = turns.groupBy("conv").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in mark.items()])
    marks = materialize(convs.join(marks, "conv", "left").na.fill(0, ["n", "x1", "x2"]), "marks")
    distinct = materialize(marks.groupBy("n", "x1", "x2").agg(F.min("conv").alias("rep"), F.count("*").alias("copies")), "sequences")
    copies = marks.join(distinct.filter("copies > 1"), ["n", "x1", "x2"]).select("conv", "rep")
    return distinct.select("rep", "n", "copies"), copies


def sorted_sequences(turns: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((rep, at), (at, lcp)): the sequences' places in lexicographic order; lcp is what a place shares with the one before, -1 at place 0."""
    open_, start = distinct.select("rep", F.lit(0).cast("long").alias("tie")), 0
    places, shared = None, distinct.sparkSession.range(1).select(F.col("id").alias("at"), F.lit(-1).cast("long").alias("lcp"))
    while True:
        steps = turns.filter((F.col("depth") > start) & (F.col("depth") <= start + SEGMENT)).join(open_.select(F.col("rep").alias("conv")), "conv")
        steps = steps.groupBy(F.col("conv").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("depth", "h1", "h2"))).alias("steps"))
        rows = open_.join(steps, "rep", "left").select("rep", "tie", F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)).alias("steps"))
        # equal depths compare equal, so the order is that of the hashes
        rows = running(rows.withColumn("one", F.lit(1)), ["tie", "steps", "rep"], {"local": "one"}, ["rep", "tie", "steps"], "sorted")
        first = rows.groupBy("tie").agg(F.min("local").alias("first"))
        rows = rows.join(first, "tie").withColumn("at", F.col("tie") + F.col("local") - F.col("first"))
        last = rows.select("tie", (F.col("at") + 1).alias("at"), F.col("steps").alias("before"))
        differs = F.array_position(F.zip_with("steps", "before", lambda a, b: a.eqNullSafe(b)), False)
        met = rows.join(last, ["tie", "at"], "left").withColumn("common", F.when(F.col("before").isNull(), None).when(differs == 0, F.size("steps")).otherwise(differs - 1))
        met = materialize(met.select("rep", "tie", "at", "common", (F.size("steps") == SEGMENT).alias("full"), F.xxhash64("steps").alias("key")), "neighbours")
        shared = shared.unionAll(met.filter(F.col("common") < SEGMENT).select("at", (F.col("common") + start).cast("long").alias("lcp")))
        ties = met.filter("full").groupBy("tie", "key").agg(F.min("at").alias("next"), F.count("*").alias("n")).filter("n > 1")
        rows = materialize(met.join(ties, ["tie", "key"], "left").select("rep", "at", F.when(F.col("full"), F.col("next")).alias("next")), "placed")
        done = rows.filter("next is null").select("rep", "at")
        places = done if places is None else places.unionAll(done)
        open_ = rows.filter("next is not null").select("rep", F.col("next").alias("tie"))
        start += SEGMENT
        if open_.isEmpty():
            return places, shared


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """Per value the last place before and the first after it with a smaller one, -1 and the length where there is none."""
    n = len(values)
    left, right, stack = [-1] * n, [n] * n, []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = k
        if stack:
            top = stack[-1]
            left[k] = top if values[top] < v else left[top]
        stack.append(k)
    for k in stack:  # equal values on the stack end alike
        right[k] = n
    return left, right


class RangeMinima:
    """Minima of any ranges of an array, by doubled widths."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [np.asarray(values, np.int64)]
        while 2 << (len(self.rows) - 1) <= len(values):
            a, w = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(a[:-w], a[w:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The minima of [a, b); the largest number where that is empty."""
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        out = np.full(len(a), np.iinfo(np.int64).max)
        level = np.frexp(np.maximum(b - a, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[b > a]):
            mine = (level == k) & (b > a)
            out[mine] = np.minimum(self.rows[k][a[mine]], self.rows[k][b[mine] - (1 << k)])
        return out


def boundaries(places: DataFrame, block: int) -> DataFrame:
    """(at, lcp, start, end, low, after, until): the interval [start, end) that shares place at's lcp and its least rep (null if it leaves the block); the least rep of the block from at on, and up to at.

    ``places`` are (at, lcp, rep), at from 0 without gaps.
    """
    rows = places.withColumn("block", F.floor(F.col("at") / block))
    found = rows.groupBy("block").agg(F.min("lcp").alias("lcp"), F.count("*").alias("n")).orderBy("block").collect()
    minima, total = np.array([r["lcp"] for r in found]), sum(r["n"] for r in found)

    def inside(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part, (number,) = part.sort_values("at"), key
        at, lcp, rep = (part[c].to_numpy() for c in ("at", "lcp", "rep"))
        left, right = (np.array(x) for x in nearest_smaller(lcp.tolist()))
        out = pd.DataFrame({"at": at, "lcp": lcp, "start": pd.array(at[0] + left, "Int64"), "end": pd.array(at[0] + right, "Int64"), "from_block": pd.array([pd.NA] * len(at), "Int64"), "to_block": pd.array([pd.NA] * len(at), "Int64")})
        out["low"] = pd.array(RangeMinima(rep).least(np.maximum(left, 0), right), "Int64")
        for value in np.unique(lcp[(left < 0) | (right == len(at))]):
            smaller = np.flatnonzero(minima < value)
            before, after = smaller[smaller < number], smaller[smaller > number]
            same = lcp == value
            out.loc[same & (left < 0), "from_block"] = int(before[-1]) if len(before) else pd.NA
            out.loc[same & (right == len(at)), "to_block"] = int(after[0]) if len(after) else pd.NA
        open_left, open_right = left < 0, right == len(at)
        out.loc[open_left, "start"] = pd.NA
        out.loc[open_right, "end"] = pd.NA
        out.loc[open_right & out["to_block"].isna().to_numpy(), "end"] = total
        out.loc[open_left | open_right, "low"] = pd.NA
        out["after"] = np.minimum.accumulate(rep[::-1])[::-1]
        out["until"] = np.minimum.accumulate(rep)
        return out

    kind = "at long, lcp long, start long, end long, from_block long, to_block long, low long, after long, until long"
    local = materialize(rows.groupBy("block").applyInPandas(inside, kind), "intervals")
    asked = lambda name, left: local.filter(f"{name} is not null").select(F.col(name).alias("block"), "lcp", F.lit(left).alias("left")).distinct()
    asked_all = materialize(asked("from_block", True).unionAll(asked("to_block", False)), "asked")
    if asked_all.isEmpty():
        return local.drop("from_block", "to_block")

    def look_up(questions: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if questions.empty or part.empty:
            return pd.DataFrame({"block": [], "lcp": [], "left": [], "answer": []})
        part = part.sort_values("at")
        at, lcp = part["at"].to_numpy(), part["lcp"].to_numpy()
        value, left = questions["lcp"].to_numpy(), questions["left"].to_numpy()
        last = np.searchsorted(np.minimum.accumulate(lcp[::-1])[::-1], value) - 1
        first = np.searchsorted(-np.minimum.accumulate(lcp), -value, "right")
        return questions.assign(answer=at[np.clip(np.where(left, last, first), 0, len(at) - 1)])

    answers = materialize(asked_all.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(look_up, "block long, lcp long, left boolean, answer long"), "answers")
    side = lambda name, out, left: answers.filter(F.col("left") == left).select(F.col("block").alias(name), "lcp", F.col("answer").alias(out))
    local = local.join(side("from_block", "left_answer", True), ["from_block", "lcp"], "left").join(side("to_block", "right_answer", False), ["to_block", "lcp"], "left")
    return local.select("at", "lcp", F.coalesce("start", "left_answer").alias("start"), F.coalesce("end", "right_answer").alias("end"), "low", "after", "until")


def end_digests(copies: DataFrame) -> DataFrame:
    """(rep, digest): SHA-256 of the conversations (conv, rep) of each rep, ascending, comma-joined."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, conv = (batch.column(k).to_numpy() for k in (0, 1))
            cut = [0, *(np.flatnonzero(rep[1:] != rep[:-1]) + 1).tolist(), len(rep)] if len(rep) else [0]
            spans = [(k, min(k + RUN, b)) for a, b in zip(cut[:-1], cut[1:], strict=True) for k in range(a, b, RUN)]
            yield pa.RecordBatch.from_arrays([pa.array([int(rep[a]) for a, _ in spans], pa.int64()), pa.array([int(conv[a]) for a, _ in spans], pa.int64()), pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in spans], pa.string())], ["rep", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, str]] = []
        rep, state = None, hashlib.sha256()
        for batch in batches:
            for r, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if r != rep:
                    if rep is not None:
                        out.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], ["rep", "digest"])
            out = []
        if rep is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], ["rep", "digest"])
        give_back()

    parts = copies.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv").mapInArrow(runs, "rep long, first long, ids string")
    return parts.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digests, "rep long, digest string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node of the trie of ``convs`` (conv) with ``turns`` (conv, depth from 1 without gaps, h1, h2, bytes).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = materialize(turns, "rebuilt")
    distinct, copies = sequences(turns, convs)
    places, shared = sorted_sequences(turns, distinct)
    placed = materialize(places.join(shared, "at").join(distinct, "rep"), "order")
    bounds = materialize(boundaries(placed.select("at", "lcp", "rep"), block), "bounds")

    # a row per place, and one behind the last
    end = placed.agg(F.max("at").alias("at")).filter("at is not null").select((F.col("at") + 1).alias("at"), F.lit(-1).cast("long").alias("lcp"), *[F.lit(None).cast("long").alias(c) for c in ("rep", "n")], F.lit(0).cast("long").alias("copies"))
    rows = placed.select("at", "lcp", "rep", "n", "copies").unionAll(end)
    after = rows.select((F.col("at") - 1).alias("at"), F.col("lcp").alias("next"))
    rows = rows.join(after, "at", "left").withColumn("leaf", F.coalesce((F.col("n") > F.col("next")).cast("long"), F.lit(0)))
    rows = materialize(running(rows, ["at"], {"convs_before": "copies", "leaves_before": "leaf"}, ["at", "lcp", "rep", "n"], "totals"), "totals")
    digest = F.coalesce("digest", F.sha2(F.col("rep").cast("string"), 256))
    ends = placed.join(end_digests(copies), "rep", "left").select("at", "rep", "n", digest.alias("digest"))

    # nodes of the Cartesian tree: intervals of equal LCPs, and where sequences end
    inner = bounds.filter("at > 0").groupBy(F.col("start").alias("left"), F.col("lcp").alias("depth")).agg(F.max("end").alias("right"), F.count("*").alias("cuts"), F.min("low").alias("low"))
    outer = ends.select(F.col("at").alias("left"), F.col("n").alias("depth"), "rep", "digest")
    nodes = inner.join(outer, ["left", "depth"], "full").select("left", "depth", F.coalesce("right", F.col("left") + 1).alias("right"), F.coalesce("cuts", F.lit(0)).alias("cuts"), F.when(F.col("cuts").isNull(), F.col("rep")).otherwise(F.col("low")).alias("low"), "digest")
    nodes = nodes.join(rows.select(F.col("at").alias("left"), F.col("lcp").alias("left_lcp"), F.col("rep").alias("head"), F.col("convs_before").alias("c0"), F.col("leaves_before").alias("l0")), "left")
    nodes = nodes.join(rows.select(F.col("at").alias("right"), F.col("lcp").alias("right_lcp"), F.col("convs_before").alias("c1"), F.col("leaves_before").alias("l1")), "right")
    nodes = nodes.select("left", "right", "depth", "cuts", "low", "digest", "head", (F.col("c1") - F.col("c0")).alias("n_convs"), (F.col("l1") - F.col("l0")).alias("n_leaves"), F.greatest("left_lcp", "right_lcp").alias("above"), F.when(F.col("left_lcp") >= F.col("right_lcp"), F.col("left")).otherwise(F.col("right")).alias("cut"))
    nodes = materialize(_with_low(materialize(nodes, "nodes"), bounds, block), "nodes")

    # the parent is the node of the LCP that ends the interval
    parent = bounds.select(F.col("at").alias("cut"), F.col("start").alias("parent_left"), F.col("lcp").alias("parent_depth"))
    parent = parent.join(nodes.select(F.col("left").alias("parent_left"), F.col("depth").alias("parent_depth"), F.col("low").alias("parent_low")), ["parent_left", "parent_depth"]).select("cut", "parent_low")
    top = nodes.filter("above < 0").withColumn("parent_low", F.lit(None).cast("long"))
    tree = top.unionByName(nodes.filter("above >= 0").join(parent, "cut"))
    every = tree.select("*", F.explode(F.sequence(F.col("above") + 1, "depth")).alias("d"))

    # what is shared, in the order of the trie from the top: a subtree is a range of it
    saving = nodes.filter("n_convs > 1").select("left", "right", "head", "n_convs", F.explode(F.sequence(F.col("above") + 1, "depth")).alias("d"))
    saving = saving.join(turns.select(F.col("conv").alias("head"), F.col("depth").alias("d"), "bytes"), ["head", "d"], "left").withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0)))
    saving = materialize(running(saving, ["left", "d"], {"before": "saved"}, ["left", "right", "d", "saved"], "saving"), "saving")
    sums = rows.select("at").join(saving.groupBy(F.col("left").alias("at")).agg(F.sum("saved").alias("saved")), "at", "left").na.fill(0, ["saved"])
    upto = running(sums, ["at"], {"total": "saved"}, ["at"], "upto").withColumnRenamed("at", "right")
    saved = saving.join(upto, "right").select("left", "d", (F.col("total") - F.col("before")).alias("saved_tokens"))

    last = F.col("d") == F.col("depth")
    out = every.join(saved, ["left", "d"], "left").select(
        F.col("low").alias("conv_id"),
        F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") == F.col("above") + 1, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        "n_convs",
        F.when(~last, 1).when(F.col("cuts") == 0, 0).otherwise(F.col("cuts") + 1 - F.col("digest").isNotNull().cast("long")).cast("long").alias("n_children"),
        "n_leaves",
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        F.when(last & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return out


def _with_low(nodes: DataFrame, bounds: DataFrame, block: int) -> DataFrame:
    """``nodes`` with the least conversation of those intervals too that cross blocks: of the blocks' ends that they take, and of whole blocks between."""
    wide = nodes.filter("low is null")
    if wide.isEmpty():
        return nodes
    minima = [r["low"] for r in bounds.filter(F.col("at") % block == 0).orderBy("at").select(F.col("after").alias("low")).collect()]

    @F.pandas_udf("long")
    def between(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(RangeMinima(np.array(minima)).least(a.to_numpy(), b.to_numpy()))

    wide = wide.drop("low").join(bounds.select(F.col("at").alias("left"), "after"), "left").join(bounds.select((F.col("at") + 1).alias("right"), "until"), "right")
    of = lambda c: F.floor(c / block)
    one = of(F.col("left")) == of(F.col("right") - 1)
    low = F.when(one, F.col("after")).otherwise(F.least("after", "until", between(of(F.col("left")) + 1, of(F.col("right") - 1))))
    return nodes.filter("low is not null").unionByName(wide.withColumn("low", low).drop("after", "until"))


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The trie of ``conversations``, each rebuilt with its family's first turns (``with_shared_starts``)."""
    turns = materialize(ordered_turns(conversations, conv, turn, role, text), "positions")
    rebuilt, convs = with_shared_starts(turns)
    return prefix_trie(rebuilt, convs, block)
