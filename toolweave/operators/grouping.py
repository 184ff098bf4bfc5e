"""Dividing a case's ranked functions into groups, in closed form on the rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_of(rank: Column, n: Column, chunks: Column) -> Column:
    """Number of the balanced contiguous chunk of a rank from 0; the first n mod chunks are one longer."""
    m = F.greatest(F.least(chunks, n), F.lit(1))
    base, extra = F.floor(n / m), F.pmod(n, m)
    long_part = extra * (base + 1)
    return F.when(rank < long_part, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - long_part) / F.greatest(base, F.lit(1)))).cast("int")


def assign_groups(items: DataFrame, case: str, order: list[Column], k: int) -> DataFrame:
    """(case row columns, rank, n, group_id): each item in a round-robin group and the best chunk also as group 0.

    With n items and kk = min(k, n): n div kk contiguous chunks of the ranking
    are dealt round robin over kk groups, numbered kk .. 1 by place in the
    chunk; the first chunk is group 0 besides.
    """
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy(*order)) - 1)
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy(case)))
    kk = F.least(F.lit(k), F.col("n"))
    chunks = F.floor(F.col("n") / kk)
    ranked = ranked.withColumn("chunk", chunk_of(F.col("rank"), F.col("n"), chunks))
    inside = F.col("rank") - F.min("rank").over(Window.partitionBy(case, "chunk"))
    ranked = ranked.withColumn("dealt", (kk - F.pmod(inside, kk)).cast("int"))
    groups = F.when(F.col("chunk") == 0, F.array(F.col("dealt"), F.lit(0))).otherwise(F.array("dealt"))
    return ranked.withColumn("group_id", F.explode(groups)).drop("chunk", "dealt")


def fill_to_targets(existing: DataFrame, candidates: DataFrame, case: str, targets: list[int], limit: int | None = None) -> DataFrame:
    """(case, target, item, fill_rank): eligible candidates in rank order until a case has ``target`` items.

    ``existing`` (case, n) counts what each case has; ``candidates`` (case, item,
    rank, eligible) may be cut to the first ``limit`` by rank. Cases at or above
    a target get nothing for it. The candidates are ranked once for all targets.
    """
    cut = candidates if limit is None else candidates.filter(F.col("rank") <= limit)
    w = Window.partitionBy(case).orderBy("rank")
    taken = cut.filter("eligible").withColumn("fill_rank", F.row_number().over(w))
    filled = taken.join(existing, case).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    return filled.filter(F.col("fill_rank") <= F.col("target") - F.col("n")).select(case, "target", "item", "fill_rank")


def best_of_lists(members: DataFrame, lists: DataFrame, case: str, key: str, item: str, score: str, need: str, most: int) -> DataFrame:
    """(case, item, score): each case's ``need`` best items, at least, of the union of its ranked lists; an item counts with its best score.

    ``members`` (case, key, need) name each case's lists, ``lists`` (key, item,
    score) hold them; ``need`` is at most ``most``.
    """
    cases = members.groupBy(case).agg(F.collect_set(key).alias("keys"), F.first(need).alias("need"))
    cases = cases.withColumn("known", F.array().cast(T.ArrayType(lists.schema[item].dataType)))
    return best_unknown(cases, lists.withColumn("counted", F.lit(True)), case, key, item, score, most).drop("counted")


def best_unknown(cases: DataFrame, lists: DataFrame, case: str, key: str, item: str, score: str, most: int) -> DataFrame:
    """(case, item, score, counted): each case's best items, by (score desc, item), of the union of its lists without those it knows, until ``need`` of them are counted.

    ``cases`` (case, keys, known, need) is read several times; ``lists`` (key,
    item, score, counted) are cut to their first ``most``, beyond which no item
    may be asked for: an item among the best of the union is among the best of
    the list that gives its score. A first look at a few entries of each list
    finds an item that all wanted ones are as good as; only entries from there
    on are put together. A case's rows meet once a step, in its own part.
    """
    place = Window.partitionBy(key).orderBy(F.desc(score), item)
    ranked = lists.withColumn("__place", F.row_number().over(place)).filter(F.col("__place") <= most)
    tops = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__place", item, score, "counted"))).alias("__top"))

    def unknown(entries: DataFrame) -> DataFrame:
        best = entries.repartition(case).groupBy(case, item).agg(F.max(score).alias(score), F.max("counted").alias("counted"))
        return best.join(cases.select(case, "known"), case).filter(~F.array_contains("known", F.col(item))).drop("known")

    # half as many again as are needed, since lists share items and some are known or not counted
    look = F.ceil(F.col("need") * 1.5 / F.size("keys")).cast("int")
    first = cases.select(case, look.alias("__look"), F.explode("keys").alias(key)).join(tops, key)
    first = unknown(first.select(case, F.inline(F.slice("__top", F.lit(1), F.col("__look")))).drop("__place"))
    so_far = Window.partitionBy(case).orderBy(F.desc(score), item).rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumn("__counted", F.sum(F.col("counted").cast("int")).over(so_far)).filter("counted")
    bound = first.join(cases.select(case, "need"), case).filter(F.col("__counted") == F.col("need")).select(case, F.col(score).alias("__score"), F.col(item).alias("__item"))
    rest = cases.select(case, "keys").join(bound, case, "left").select(case, "__score", "__item", F.explode("keys").alias(key)).join(tops, key)
    rest = rest.select(case, "__score", "__item", F.inline("__top"))
    # scores that are null come last
    better = F.col("__score").isNull() & F.col(score).isNotNull() | (F.col(score) > F.col("__score"))
    rest = rest.filter(F.col("__item").isNull() | better | F.col(score).eqNullSafe(F.col("__score")) & (F.col(item) <= F.col("__item")))
    return unknown(rest.select(case, item, score, "counted"))


def similarity_pairs(cases: DataFrame, candidates: str = "candidates", existing: str = "existing") -> DataFrame:
    """Every (new candidate, existing function) of each case, a bounded product inside one row."""
    new = F.array_except(F.col(candidates), F.col(existing))
    return cases.withColumn("candidate", F.explode(new)).withColumn("function", F.explode(F.col(existing))).drop(candidates, existing)


def drop_similar(candidates: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a verdict text of ``1`` or ``2`` (alike) on any pair."""
    bad = verdicts.filter(F.trim("verdict").isin("1", "2")).select(*keys).distinct()
    return candidates.join(bad, keys, "left_anti")
