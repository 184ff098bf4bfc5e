"""Request quotas as data: which requests a limiter would grant."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toolweave.operators.order import count_before
from toolweave.sources.shared import materialize

#: Positions that one task follows in memory at once, in ``spaced``.
BLOCK = 250_000


def per_minute(requests: DataFrame, limit: int, by: list[str] | None = None, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``requests`` with ``minute`` and ``granted``: the first ``limit`` of each clock minute (and ``by``) by (ts, tie).

    Spark cuts each minute to its first requests before the shuffle; the last of
    these is all that the other rows are compared with, so no minute is gathered
    in one place. Requests of one minute that agree in both columns go together.
    """
    key = [*(by or []), "minute"]
    rows = requests.withColumn("minute", F.date_trunc("minute", F.col(ts)).cast(requests.schema[ts].dataType))
    at = F.struct(F.col(ts), F.col(tie))
    first = rows.select(*key, ts, tie).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(ts, tie))).filter(F.col("place") <= limit)
    last = first.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.max(at).alias("__last"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return rows.join(last, same, "left").withColumn("granted", F.coalesce(at <= F.col("__last"), F.lit(False))).select(*rows.columns, "granted")


def spaced(requests: DataFrame, key: str, seconds: float, ts: str = "ts", tie: str = "event_id", block: int = BLOCK) -> DataFrame:
    """(key, tie, granted): granted if ``seconds`` or more have passed since the last grant of the key.

    A grant at one time leads to the first later time that is far enough, so the
    times of a key are a list with pointers, and the grants are the ones reached
    from its first. Times have positions in one order over all keys; blocks of
    ``block`` positions turn their pointers into pointers out of the block, and
    the places where keys' lists enter a block are found by doubling these, in
    as many rounds as the logarithm of the blocks that one key covers. No step
    holds a key in one task, so a key may have any share of the rows.

    Requests without a time are left out; null is a key like any other; of
    several requests at one time the first by ``tie`` is granted, and rows that
    agree in all three are one request and go together; with no spacing all are
    granted; an empty table gives an empty one.
    """
    gap = round(seconds * 1_000_000)
    slim = requests.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("__at")).filter("__at is not null")
    if gap <= 0:
        return slim.select(key, tie, F.lit(True).alias("granted"))
    times = materialize(slim.groupBy(F.col(key).alias("k"), F.col("__at").alias("at")).agg(F.min(tie).alias("first")), "times")
    points = _pointers(times, gap, block)
    chosen = _reached(points, block)
    won = points.join(chosen, "pos").select(F.col("k").alias("__k"), F.col("at").alias("__t"), F.col("first").alias("__first"))
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__at") == F.col("__t")) & F.col(tie).eqNullSafe(F.col("__first"))
    return slim.join(won, same, "left").select(key, tie, F.col("__t").isNotNull().alias("granted"))


def _pointers(times: DataFrame, gap: int, block: int) -> DataFrame:
    """(pos, k, at, first, head, next, block): positions by (k, at), and that of the key's first time ``gap`` or more later, null if none."""
    asked = times.select("k", (F.col("at") + gap).alias("time"), F.lit(0).alias("real"), "at", F.lit(None).cast(times.schema["first"].dataType).alias("first"))
    both = times.select("k", F.col("at").alias("time"), F.lit(1).alias("real"), "at", "first").unionByName(asked)
    placed = materialize(count_before(both, ["k", "time", "real"], F.col("real") == 1, "pos"), "placed")
    real = placed.filter("real = 1").select("k", "at", "first", "pos")
    later = placed.filter("real = 0").select(F.col("k").alias("k2"), F.col("at").alias("at2"), F.col("pos").alias("next"))
    ends = real.groupBy(F.col("k").alias("k2")).agg(F.min("pos").alias("head"), F.max("pos").alias("end"))
    out = real.join(later, F.col("k").eqNullSafe(F.col("k2")) & (F.col("at") == F.col("at2"))).drop("k2", "at2")
    out = out.join(ends, F.col("k").eqNullSafe(F.col("k2"))).withColumn("next", F.when(F.col("next") <= F.col("end"), F.col("next")))
    return materialize(out.select("pos", "k", "at", "first", (F.col("pos") == F.col("head")).alias("head"), "next", F.floor(F.col("pos") / block).alias("block")), "pointers")


def _leaving(rows: pd.DataFrame) -> pd.DataFrame:
    """(pos, next): where each position's list leaves the block, by doubling; -1 where it ends before."""
    rows = rows.sort_values("pos")
    start, n = int(rows["pos"].iloc[0]), len(rows)
    out = rows["next"].to_numpy(np.int64).copy()
    while len(inside := np.flatnonzero((out >= 0) & (out < start + n))):
        out[inside] = out[out[inside] - start]
    return pd.DataFrame({"pos": rows["pos"].to_numpy(), "next": out})


def _marked(rows: pd.DataFrame) -> pd.DataFrame:
    """(pos): what the block's lists reach from its entries, along each list once."""
    rows = rows.sort_values("pos")
    start, n = int(rows["pos"].iloc[0]), len(rows)
    following, seen = rows["next"].to_numpy(np.int64), np.zeros(n, bool)
    for p in np.flatnonzero(rows["entry"].to_numpy(bool)):
        while p < n and not seen[p]:
            seen[p] = True
            p = following[p] - start if following[p] >= 0 else n
    return pd.DataFrame({"pos": start + np.flatnonzero(seen)})


def _reached(points: DataFrame, block: int) -> DataFrame:
    """(pos): the positions that the keys' lists reach from their first ones."""
    linked = points.select("pos", F.coalesce("next", F.lit(-1)).cast("long").alias("next"), "block", "head")
    out_of = materialize(linked.groupBy("block").applyInPandas(_leaving, "pos long, next long").filter("next >= 0"), "leaving")
    heads = linked.filter("head").select("pos")
    nodes = heads.union(out_of.select(F.col("next").alias("pos"))).distinct()
    jump = materialize(out_of.join(nodes, "pos", "left_semi"), "jumps")
    entries = materialize(heads, "entries")
    while not jump.isEmpty():
        entries = materialize(entries.union(entries.join(jump, "pos").select(F.col("next").alias("pos"))).distinct(), "entries")
        onward = jump.select(F.col("pos").alias("next"), F.col("next").alias("far"))
        jump = materialize(jump.join(onward, "next").select("pos", F.col("far").alias("next")), "jumps")
    inside = linked.join(entries.withColumn("entry", F.lit(True)), "pos", "left").select("pos", "next", "block", F.coalesce("entry", F.lit(False)).alias("entry"))
    return inside.groupBy("block").applyInPandas(_marked, "pos long")
