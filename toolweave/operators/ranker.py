"""A learnt reranker: a pairwise linear model over features of a query's hits.

A hit's features are its dense score, distance and place, and how close it is to
the mean of the query's first hits (a wanted document is close to the others that
are). The model is fitted in numpy on differences between wanted and unwanted hits
of the training queries, at most about ``ROWS`` hits, drawn by a hash of the query.
Scoring is a Spark expression; features are made per query, whose hits are bounded
by the search's k.

Defined cases: hits without a vector have no closeness (0); a training set without
both kinds of hits gives the dense order; zero vectors are close to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, ROUNDS, RATE, PENALTY = 50_000, 400, 0.5, 1e-3
#: Hits whose mean a hit is compared with.
HEADS = (5, 10, 20)
NAMES = ["score", "distance", "place", *[f"close_{n}" for n in HEADS]]


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(-1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def features(hits: DataFrame, corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """``hits`` (qid, docid, score, distance, rank) with ``features``, an array in the order of ``NAMES``."""
    rows = hits.select("qid", "docid", "score", "distance", "rank").join(corpus.select("docid", F.col(vector).cast("array<double>").alias("v")), "docid", "left")

    def of_query(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        width = max((len(v) for v in part["v"] if v is not None), default=1)
        unit = _unit(np.array([v if v is not None else np.zeros(width) for v in part["v"]], np.float64))
        columns = [part["score"], -part["distance"], 1 / part["rank"]]
        columns += [unit @ _unit(unit[:n].mean(0)) for n in HEADS]
        part["features"] = list(np.stack([np.nan_to_num(np.asarray(c, np.float64)) for c in columns], 1))
        return part[["qid", "docid", "score", "distance", "rank", "features"]]

    return rows.groupBy("qid").applyInPandas(of_query, "qid long, docid long, score double, distance double, rank int, features array<double>")


@dataclass(frozen=True)
class Ranker:
    """Weights over the features of a hit."""

    weights: tuple[float, ...]

    def score(self, column: str = "features") -> Column:
        parts = [F.lit(float(w)) * F.col(column)[i] for i, w in enumerate(self.weights)]
        return F.round(sum(parts[1:], parts[0]), 9)


def fitted(rows: pd.DataFrame) -> Ranker:
    """The ranker of hits (qid, features, rel): logistic loss over pairs of a wanted and an unwanted hit of one query."""
    rows = rows.sort_values("qid", kind="stable")
    x = np.stack(rows["features"].tolist()) if len(rows) else np.zeros((0, len(NAMES)))
    scale = x.std(0) + 1e-9 if len(x) else np.ones(len(NAMES))
    differences, weight = [], []
    for _, part in rows.assign(at=np.arange(len(rows))).groupby("qid"):
        good, bad = (part["at"].to_numpy()[(part["rel"] > 0).to_numpy() == k] for k in (True, False))
        if len(good) and len(bad):
            # wanted hits against the mean and against every unwanted one in turn, as many pairs as hits
            turn = np.arange(max(len(good), len(bad)))
            differences.append((x[good[turn % len(good)]] - x[bad[turn % len(bad)]]) / scale)
            weight.append(np.full(len(turn), 1 / len(turn)))
    w = np.zeros(len(NAMES))
    if not differences:
        w[0] = 1.0
        return Ranker(tuple(w.tolist()))
    d, share = np.concatenate(differences), np.concatenate(weight)
    share /= share.sum()
    for _ in range(ROUNDS):
        slope = share / (1 + np.exp(np.clip(d @ w, -50, 50)))
        w += RATE * (slope @ d - PENALTY * w)
    return Ranker(tuple((w / scale).tolist()))


def train(hits: DataFrame, relevant: DataFrame, rows: int = ROWS) -> Ranker:
    """Fit on ``hits`` (qid, docid, features) of the training queries; ``relevant`` (qid, docid) are the wanted ones."""
    n = hits.count()
    share = int(min(1.0, rows / max(1, n)) * (1 << 20)) + 1
    drawn = hits.filter(F.pmod(F.xxhash64("qid"), F.lit(1 << 20)) < share).limit(2 * rows)
    judged = drawn.join(relevant.select("qid", "docid").distinct().withColumn("rel", F.lit(1)), ["qid", "docid"], "left")
    return fitted(judged.select("qid", "docid", "features", F.coalesce("rel", F.lit(0)).alias("rel")).orderBy("qid", "docid").toPandas())
