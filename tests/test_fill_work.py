"""Filling from ranked lists: few rows meet by customer, and the best are the right ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from toolweave.operators import grouping
from toolweave.plans import queries


def test_best_unknown_is_exact(spark):
    """Against plain unions, with ties, null scores, known items and items that aren't counted."""
    rng = random.Random(3)
    lists = [(k, i, rng.choice([None, *map(float, range(5))]), i % 4 > 0) for k in range(6) for i in rng.sample(range(40), rng.choice([1, 5, 30]))]
    cases = [(c, rng.sample(range(6), m), rng.sample(range(40), 8 * (c % 2)), need) for c, (m, need) in enumerate([(1, 1), (2, 3), (3, 8), (6, 2), (6, 20), (6, 60)])]
    got = grouping.best_unknown(spark.createDataFrame(cases, "c int, keys array<int>, known array<int>, need int"), spark.createDataFrame(lists, "k int, i int, s double, counted boolean"), "c", "k", "i", "s", 60)
    best = {}
    for r in got.collect():
        best.setdefault(r.c, []).append((r.s is None, -(r.s or 0), r.i, r.counted))
    for c, keys, known, need in cases:
        whole = {}
        for k, i, s, counted in lists:
            if k in keys and i not in known:
                whole[i] = min((s is None, -(s or 0), i, counted), whole.get(i, (True, 0, i, counted)))
        want = sorted(whole.values())
        last = next((at for at in range(len(want)) if sum(w[3] for w in want[: at + 1]) == need), len(want))
        found = sorted(best.get(c, []))
        assert found[: last + 1] == want[: last + 1] and set(found) <= set(want), c


def filled(spark, folder, part):
    """One supplier sells parts 1 to 200, each once, by falling quantity; customer 7 bought the last."""
    lines = [(1 if p == 200 else 2, p, 5, float(1000 - p)) for p in range(1, 201)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 8)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    part.write.parquet(f"{folder}/part.parquet")
    return [r.item for r in queries.candidate_fill(spark, str(folder)).orderBy("fill_rank").collect()]


def test_lines_of_no_part_take_no_place(spark, tmp_path):
    """The first 60 parts sold aren't in the table of parts; the others fill all the same."""
    part = spark.range(61, 201).select(F.col("id").alias("p_partkey"), F.lit("Brand#2").alias("p_brand"))
    assert filled(spark, tmp_path, part) == list(range(61, 80))


def test_first_look_takes_few_entries_of_a_list(spark, tmp_path):
    """Customer 7 lacks 19 parts; of the list of 200 only those that it may get are put together."""
    part = spark.range(1, 201).select(F.col("id").alias("p_partkey"), F.lit("Brand#2").alias("p_brand"))
    assert filled(spark, tmp_path, part) == list(range(1, 20))
    cases = spark.createDataFrame([(7, [5], [200], 19)], "c int, keys array<int>, known array<int>, need int")
    lists = spark.range(1, 201).select(F.lit(5).alias("k"), F.col("id").cast("int").alias("i"), F.lit(1.0).alias("s"), F.lit(True).alias("counted"))
    assert grouping.best_unknown(cases, lists, "c", "k", "i", "s", 60).count() == 19
