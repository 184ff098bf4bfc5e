"""Ranking and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(hits: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = (5, 10), queries: DataFrame | None = None, corpus_size: int | None = None) -> DataFrame:
    """(qid, ndcg_5, ndcg_10, ..., ndcg, ndcg_sum) per query of ``hits`` (qid, docid, score).

    Tied scores share the mean gain of their places. A query with no judged
    document has null metrics; one with judged but no relevant hits has 0.
    ndcg is the mean over the cuts; ndcg_sum their sum.

    With ``queries`` (qid) and ``corpus_size`` the documents that are no hits
    count as one tie at the end of the list, without being listed: the hits must
    then be all matches of a query, or as many as the largest cut at least.
    """
    relevant = qrels.select("qid", "docid").distinct().withColumn("rel", F.lit(1.0))
    judged = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    rows = hits.join(relevant, ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    return judged_ndcg(rows, judged, cuts, queries, corpus_size)


def judged_ndcg(rows: DataFrame, judged: DataFrame, cuts: tuple[int, ...] = (5, 10), queries: DataFrame | None = None, corpus_size: int | None = None) -> DataFrame:
    """``ndcg`` of hits that carry their relevance ``rel``, with the number of relevant documents per query (qid, n_rel).

    It needs no list of relevant pairs, which can be far longer than the hits.
    """
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))
    rows = rows.select("qid", "rel", place.alias("place"), F.avg("rel").over(Window.partitionBy("qid", "score")).alias("gain"))
    discount = lambda place: F.lit(1.0) / F.log2(place.cast("double") + 1)
    total_discount = lambda low, high: F.when(low <= high, F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, i: s + discount(i))).otherwise(0.0)
    sums = [F.sum(F.when(F.col("place") <= k, F.col("gain") * discount(F.col("place"))).otherwise(0.0)).alias(f"dcg_{k}") for k in cuts]
    out = rows.groupBy("qid").agg(*sums, F.count("*").alias("n_hits"), F.sum("rel").alias("found"))
    rest = lambda k: F.lit(0.0)
    if queries is not None and corpus_size is not None:
        out = queries.select("qid").distinct().join(out, "qid", "left").na.fill(0)
        share = (F.col("n_rel") - F.col("found")) / F.greatest(F.lit(corpus_size) - F.col("n_hits"), F.lit(1))
        rest = lambda k: share * total_discount((F.col("n_hits") + 1).cast("int"), F.lit(min(k, corpus_size)))
    out = out.join(judged, "qid", "left")
    best = lambda k: total_discount(F.lit(1), F.least(F.lit(k), F.greatest(F.col("n_rel"), F.lit(1)).cast("int")))
    values = {k: F.when(F.col("n_rel").isNotNull(), (F.col(f"dcg_{k}") + rest(k)) / best(k)) for k in cuts}
    total = sum((values[k] for k in cuts[1:]), values[cuts[0]])
    return out.select("qid", *[F.round(v, 6).alias(f"ndcg_{k}") for k, v in values.items()], F.round(total / len(cuts), 6).alias("ndcg"), F.round(total, 6).alias("ndcg_sum"))


def mean_ndcg(scores: DataFrame, cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row with the mean of each metric over queries that have one."""
    return scores.agg(*[F.round(F.avg(f"ndcg_{k}"), 6).alias(f"ndcg_{k}") for k in cuts], F.round(F.avg("ndcg"), 6).alias("ndcg"))


def session_scores(rows: DataFrame, session: list[str], valid: str = "valid") -> DataFrame:
    """Per session: ``accuracy`` 1 if every row is valid, ``process`` the share that is, rounded to five."""
    share = F.avg(F.col(valid).cast("int").cast("double"))
    return rows.groupBy(*session).agg(F.min(F.col(valid).cast("int")).alias("accuracy"), F.round(share, 5).alias("process"), F.count("*").alias("n"))


def session_accuracy(rows: DataFrame, session: list[str], by: list[str], valid: str = "valid") -> DataFrame:
    """Means over sessions, per ``by``, rounded to five."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 5).alias(c)
    return session_scores(rows, [*by, *session], valid).groupBy(*by).agg(mean("accuracy"), mean("process"), F.count("*").alias("sessions"))


def islands(rows: DataFrame, key: str, order: list[str], value: str, name: str = "island") -> DataFrame:
    """``rows`` with the number, from 1, of the run of equal ``value`` each belongs to, per key."""
    w = Window.partitionBy(key).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def weighted_accuracy(rows: DataFrame, by: list[str], accuracy: str = "accuracy", n: str = "n") -> DataFrame:
    """Mean weighted by row counts; 0 where there are none."""
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.sum(F.col(accuracy) * F.col(n)) / F.nullif(F.sum(n).cast("double"), F.lit(0.0)), F.lit(0.0)), 6).alias("accuracy"))


def unweighted_accuracy(scores: DataFrame, model: str, category: str, accuracy: str, required: list[str]) -> DataFrame:
    """(model, accuracy): mean over the required categories; one that a model lacks counts as 0."""
    total = sum((F.coalesce(F.max(F.when(F.col(category) == c, F.col(accuracy))), F.lit(0.0)) for c in required), F.lit(0.0))
    return scores.groupBy(model).agg(F.round(total / len(required), 6).alias("accuracy"))


def key_counts(calls: DataFrame, by: list[str], func: str = "func") -> DataFrame:
    """The multiset of function names, per ``by``."""
    return calls.groupBy(*by, func).agg(F.count("*").alias("n"))


def percent(value: Column) -> Column:
    """``0.1234`` as ``12.34%``."""
    return F.concat(F.format_string("%.2f", value * 100), F.lit("%"))


def milestone_rows(rows: DataFrame, key: str, order: list[str], value: str, stones: list[str]) -> DataFrame:
    """(key, share): ``milestone_share`` of traces given as rows, of any length.

    Stone by stone the earliest row after the last one found; minima combine
    before each shuffle and no trace is gathered in one place.
    """
    at = F.struct(*order)
    out = rows.select(key).distinct().withColumn("__last", F.lit(None).cast(rows.select(at.alias("a")).schema["a"].dataType)).withColumn("__hits", F.lit(0))
    for i, stone in enumerate(stones):
        after = rows.filter(F.col(value) == stone).select(key, at.alias("__at")).join(out, key)
        nxt = after.filter((F.col("__hits") == i) & (F.lit(i == 0) | (F.col("__at") > F.col("__last")))).groupBy(key).agg(F.min("__at").alias("__next"))
        found = F.col("__next").isNotNull()
        out = out.join(nxt, key, "left").select(key, F.when(found, F.col("__next")).otherwise(F.col("__last")).alias("__last"), F.when(found, F.lit(i + 1)).otherwise(F.col("__hits")).alias("__hits"))
    return out.select(key, (F.col("__hits") / F.lit(float(len(stones))) if stones else F.lit(1.0)).alias("share"))


def milestone_share(trace: Column, stones: Column) -> Column:
    """Share of the longest prefix of ``stones`` that is a subsequence of ``trace``; 1 without stones."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hit"), F.lit(False).alias("lost"))

    def step(s: Column, stone: Column) -> Column:
        rest = F.slice(trace, s["at"] + 1, F.greatest(F.size(trace) - s["at"], F.lit(0)))
        found = F.array_position(rest, stone).cast("int")
        ok = ~s["lost"] & (found > 0)
        return F.struct(F.when(ok, s["at"] + found).otherwise(s["at"]).alias("at"), F.when(ok, s["hit"] + 1).otherwise(s["hit"]).alias("hit"), (~ok).alias("lost"))

    return F.when(F.size(stones) == 0, F.lit(1.0)).otherwise(F.aggregate(stones, start, step)["hit"] / F.size(stones).cast("double"))
