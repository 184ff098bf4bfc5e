"""Spacing with one key that holds every row, over many blocks; a quota over all tasks of a call."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from toolweave.operators import quota, requests


def expected(rows: list[tuple], gap: int) -> set:
    """The limiter as a loop: ids that are granted."""
    last, out = {}, set()
    for key, tie, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1])):
        if key not in last or at - last[key] >= gap:
            last[key] = at
            out.add(tie)
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "user string, event_id long, at long")
    return df.select("user", "event_id", F.timestamp_seconds("at").alias("ts"))


@pytest.mark.parametrize("gap", [7, 60])
@pytest.mark.parametrize("block", [5, 64, 250_000])
def test_spacing_of_hot_and_small_keys(spark, gap, block):
    rnd = random.Random(gap * block)
    rows = [("hot", i, rnd.randrange(2000)) for i in range(600)]
    rows += [(rnd.choice(["a", "b", None]), i, rnd.randrange(900)) for i in range(600, 700)]
    rows += [("once", 700, 5), ("none", 701, None)]
    got = quota.spaced(frame(spark, rows), "user", gap, block=block).collect()
    assert {r.event_id for r in got if r.granted} == expected(rows, gap)
    assert sorted(r.event_id for r in got) == list(range(701))


def test_spacing_edges(spark):
    assert quota.spaced(frame(spark, []), "user", 5).count() == 0
    rows = [("a", 1, 0), ("a", 2, 0), ("a", 2, 0), ("a", 3, 5), ("a", 3, 5)]
    got = sorted((r.event_id, r.granted) for r in quota.spaced(frame(spark, rows), "user", 5).collect())
    assert got == [(1, True), (2, False), (2, False), (3, True), (3, True)]
    assert all(r.granted for r in quota.spaced(frame(spark, rows), "user", 0).collect())


def test_slots_are_used_once():
    tasks = [requests.Slots(t, 4, 600.0) for t in range(4)]
    used = []
    for now in [0.0, 0.05, 0.05, 3.21, 3.2]:
        for s in tasks:
            s.last = s.following(now)
            used.append(s.last)
            assert s.last * s.gap >= now - 1e-9 and s.last % 4 == s.task
    assert len(set(used)) == len(used)


def stamp(body: str) -> str:
    return json.dumps(time.time())


def test_quota_over_all_tasks(spark):
    rows = spark.range(60).repartition(7).select("id", F.lit("x").alias("body"))
    per_minute = 1200.0
    got = requests.call_service(rows, stamp, per_minute=per_minute).collect()
    at = sorted(float(r.response) for r in got)
    assert sorted(r.id for r in got) == list(range(60))
    assert at[-1] - at[0] >= 59 * 60 / per_minute * 0.9
    # in any second no more than its share of slots, one more for a call that woke up late
    assert all(sum(t <= x < t + 1 for x in at) <= per_minute / 60 + 1 for t in at)
