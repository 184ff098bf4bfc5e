"""Exact late interaction over a whole corpus: a kept index of token vectors that lets most of them unread.

A document's score for a query is the sum, over the query's vectors, of the best
dot product with any of the document's vectors. Centroids are fitted on a bounded
sample of vectors; every vector belongs to its nearest one, and a document to the
list of the centroid that most of its vectors have. Written are, per list,

* ``bounds``: each centroid of its documents and the greatest distance of one of
  their vectors from it: <q, centroid> + |q| * distance bounds every product;
* ``codes``: a byte per number for what a vector has beyond its centroid, and how
  far it is from what the code says, which bounds a document's score closely;
* ``vectors``: the vectors themselves.

A search reads the codes of the lists with the best bounds, scores the documents
that look best there, and has a threshold for each query: its k-th best score.
Lists whose bound is lower are not read, documents of the others whose bound is
lower are not scored. No candidate is cut that could be among the k best.

Defined cases: null vectors are left out; a document without vectors is no hit and
a query without has none; with ``others_only`` a document is no hit of a query
with its id; equal scores go by id; ids are unique; an empty corpus has no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.operators.order import spread, top_k
from toolweave.operators.retrieval import BLOCK_NUMBERS, Best, late_interaction
from toolweave.sources.shared import materialize

#: Numbers of the sample that centroids are fitted on, centroids at most, rounds of fitting.
SAMPLE_NUMBERS, CENTROIDS, ROUNDS = 1 << 22, 1024, 8
#: Lists per query that are read for its threshold.
FIRST_LISTS = 4
#: Products that a task works on at once.
PRODUCTS = 1 << 21
#: Scores are rounded to six digits.
SLACK = 2e-6
CODES = "docid bigint, list int, centroid array<int>, radius array<double>, scale array<double>, error array<double>, codes binary"
TABLES = {"codes": CODES, "vectors": "docid bigint, vectors array<array<double>>, list int", "bounds": "list int, centroid int, radius double, n bigint", "centroids": "centroid int, vector array<double>"}


@dataclass(frozen=True)
class Index:
    """An index that is written under ``path``; ``centroids`` are a row each."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")

    def centroids(self) -> np.ndarray:
        return np.array([r["vector"] for r in self.table("centroids").orderBy("centroid").collect()], np.float64)


def fitted(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``n`` centroids of the sample's rows, fewer if it has fewer distinct ones."""
    distinct = np.unique(sample, axis=0)
    out = distinct[np.random.default_rng(seed).permutation(len(distinct))[:n]]
    for _ in range(rounds):
        nearest = nearest_of(sample, out)
        count = np.bincount(nearest, minlength=len(out))
        total = np.zeros_like(out)
        np.add.at(total, nearest, sample)
        out = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], out)
    return out


def nearest_of(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    half = (centroids * centroids).sum(1) / 2
    step = max(1, PRODUCTS // max(1, len(centroids)))
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(rows[k : k + step] @ centroids.T - half, axis=1) for k in range(0, len(rows), step))])


def _usable(df: DataFrame, key: str) -> DataFrame:
    vectors = F.filter(F.col("vectors").cast("array<array<double>>"), lambda v: v.isNotNull())
    return df.select(F.col(key).cast("long").alias(key), vectors.alias("vectors")).filter(f"{key} is not null and size(vectors) > 0")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of all vectors, where each list of vectors begins, and the end) of an array<array<double>> column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    inner = column.flatten()
    width = len(inner[0]) if len(inner) else 0
    return inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), width), np.append(0, np.cumsum(sizes))


def build(corpus: DataFrame, path: str, centroids: int | None = None) -> Index:
    """Write the index of ``corpus`` (docid, vectors), in place of one that is there."""
    spark = corpus.sparkSession
    docs = _usable(corpus, "docid")
    tokens, width = docs.agg(F.coalesce(F.sum(F.size("vectors")), F.lit(0)), F.max(F.size(F.col("vectors")[0]))).first()
    rows = max(1, SAMPLE_NUMBERS // max(1, width or 1))
    share = min(1.0, rows / max(1, tokens))
    drawn = docs.filter(F.pmod(F.xxhash64("docid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.explode("vectors").alias("v")).limit(rows)
    drawn = drawn.toArrow().column("v").combine_chunks()
    sample = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, width or 1)
    middle = fitted(sample, centroids or min(CENTROIDS, max(1, int(2 * tokens**0.5))))
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(middle)], "centroid int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, start = _flat(batch.column(1))
            near = nearest_of(v, middle)
            beyond = v - middle[near]
            scale = np.maximum(np.abs(beyond).max(1, initial=0.0) / 127, 1e-300)
            codes = np.round(beyond / scale[:, None]).astype(np.int8)
            error = np.sqrt(((beyond - codes * scale[:, None]) ** 2).sum(1))
            first = [int(np.bincount(near[a:b]).argmax()) for a, b in zip(start[:-1], start[1:], strict=True)]
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first, pa.int32()), lists(near, pa.int32()), lists(np.sqrt((beyond * beyond).sum(1)), pa.float64()), lists(scale, pa.float64()), lists(error, pa.float64()), pa.array([codes[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())],
                ["docid", "list", "centroid", "radius", "scale", "error", "codes"],
            )

    coded = materialize(docs.mapInArrow(code, CODES), "coded")
    dealt = lambda df: df.repartition("list", F.pmod(F.xxhash64("docid"), F.lit(4)))
    dealt(coded).write.partitionBy("list").mode("overwrite").parquet(f"{path}/codes")
    dealt(docs.join(coded.select("docid", "list"), "docid")).write.partitionBy("list").mode("overwrite").parquet(f"{path}/vectors")
    pairs = coded.select("list", F.explode(F.arrays_zip("centroid", "radius")).alias("p")).groupBy("list", F.col("p.centroid").alias("centroid")).agg(F.max("p.radius").alias("radius"), F.count("*").alias("n"))
    pairs.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")
    return Index(spark, path)


class Queries:
    """Queries with their vectors as one matrix."""

    def __init__(self, rows: list) -> None:
        self.ids = np.array([r["qid"] for r in rows], np.int64)
        self.matrix = np.array([v for r in rows for v in r["vectors"]], np.float64)
        self.start = np.append(0, np.cumsum([len(r["vectors"]) for r in rows]))
        self.norms = np.sqrt((self.matrix * self.matrix).sum(1))

    def sums(self, best: np.ndarray) -> np.ndarray:
        """Per query the sum of its vectors' rows."""
        return np.add.reduceat(best, self.start[:-1], axis=0)


def blocks_of(queries: DataFrame) -> Iterator[Queries]:
    """The queries in blocks of at most BLOCK_NUMBERS numbers, about."""
    size = queries.agg(F.sum(F.aggregate("vectors", F.lit(0), lambda n, v: n + F.size(v)))).first()[0] or 0
    blocks = -(-2 * size // BLOCK_NUMBERS)
    for b in range(blocks):
        if rows := queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect():
            yield Queries(rows)


def _list_bounds(bounds: DataFrame, q: Queries, centroids: np.ndarray, least: np.ndarray | None, first_lists: int) -> DataFrame:
    """(qid, list, score): each task's lists with the best bounds for each query, or (with ``least``) one row for each list whose bound reaches it for some query.

    A list has as many entries as there are centroids at most; a task meets the queries in steps of about PRODUCTS numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(q.ids), first_lists)
        per = max(1, PRODUCTS // max(1, len(centroids) * int(np.diff(q.start).max(initial=1))))
        for batch in batches:
            lists = batch.column(0).to_numpy()
            start = np.append(0, np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)))
            of, radius = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            reached = np.zeros(len(lists), bool)
            for at in range(0, len(q.ids) if len(lists) else 0, per):
                rows = q.start[at : at + per + 1]
                products, norms = q.matrix[rows[0] : rows[-1]] @ centroids.T, q.norms[rows[0] : rows[-1], None]
                most = np.stack([(products[:, of[x:y]] + norms * radius[x:y]).max(1) for x, y in zip(start[:-1], start[1:], strict=True)], axis=1)
                bound = np.add.reduceat(most, rows[:-1] - rows[0], axis=0)
                if least is not None:
                    reached |= (bound >= least[at : at + per, None]).any(0)
                else:
                    i, j = np.nonzero(bound >= best.least[at : at + per, None])
                    best.add(i + at, lists[j], bound[i, j])
            if reached.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(reached.sum(), -1)), pa.array(lists[reached], pa.int32()), pa.array(np.zeros(reached.sum()))], ["qid", "list", "score"])
        if found := best.result():
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[found[0]]), pa.array(found[1], pa.int32()), pa.array(found[2])], ["qid", "list", "score"])

    return bounds.select("list", "centroid", "radius").mapInArrow(run, "qid bigint, list int, score double")


def _scan(codes: DataFrame, q: Queries, centroids: np.ndarray, least: np.ndarray | None, k: int, others_only: bool) -> DataFrame:
    """(qid, docid, list, score): of each task the k documents that look best, or all whose bound reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, place = Best(len(q.ids), k), ["qid", "docid", "list", "score"]
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, np.int64)
            per = max(1, PRODUCTS // max(1, len(q.matrix) * int(sizes.max(initial=1))))
            for at in range(0, batch.num_rows, per):
                part = batch.slice(at, per)
                docs, lists = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
                near, scale, error = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                start = np.append(0, np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False)))[:-1]
                residual = np.frombuffer(b"".join(part.column(5).to_pylist()), np.int8).reshape(len(near), -1)
                products = q.matrix @ (centroids[near] + residual * scale[:, None]).T
                if least is not None:
                    products += q.norms[:, None] * error
                score = q.sums(np.maximum.reduceat(products, start, axis=1))
                if others_only:
                    score[q.ids[:, None] == docs] = -np.inf
                if least is None:
                    i, j = best.candidates(score)
                    best.add(i, docs[j], score[i, j], lists[j])
                else:
                    i, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(docs[j]), pa.array(lists[j], pa.int32()), pa.array(score[i, j])], place)
        if found := best.result():
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[found[0]]), pa.array(found[1]), pa.array(found[3], pa.int32()), pa.array(found[2])], place)

    return codes.select("docid", "list", "centroid", "scale", "error", "codes").mapInArrow(run, "qid bigint, docid bigint, list int, score double")


def search(index: Index, queries: DataFrame, k: int, others_only: bool = False, first_lists: int = FIRST_LISTS) -> DataFrame:
    """The k best (qid, docid, score, rank) of each of ``queries`` (qid, vectors) over the whole corpus."""
    return search_counted(index, queries, k, others_only, first_lists)[0]


def search_counted(index: Index, queries: DataFrame, k: int, others_only: bool = False, first_lists: int = FIRST_LISTS) -> tuple[DataFrame, DataFrame]:
    """(hits, (kind, n)): as ``search``, with the vectors there are for each block of queries ("vectors") and of how many the codes were read ("codes"), and the pairs of a query and a document there are ("pairs") and of how many the vectors were read ("scored")."""
    spark, asked = index.spark, _usable(queries, "qid")
    centroids, codes, vectors = index.centroids(), index.table("codes"), index.table("vectors")
    # a row per list, CENTROIDS at most; their entries stay with the tasks
    entries = F.array_sort(F.collect_list(F.struct("centroid", "radius")))
    bounds = index.table("bounds").groupBy("list").agg(entries.alias("e"), F.sum("n").alias("n"))
    bounds = materialize(bounds.select("list", F.col("e.centroid").alias("centroid"), F.col("e.radius").alias("radius"), "n"), "list_bounds")
    size = {r["list"]: r["n"] for r in bounds.select("list", "n").collect()}
    bounds = spread(bounds)
    docs = vectors.count() if size else 0
    found, counts = [], []

    def scored(pairs: DataFrame, lists: list[int]) -> DataFrame:
        pairs = pairs.select("qid", "docid", "list").distinct().join(vectors.filter(F.col("list").isin(lists)), ["list", "docid"])
        keyed = pairs.select("qid", "docid", "vectors", F.col("qid").alias("key"))
        return late_interaction(asked.select(F.col("qid").alias("key"), "qid", "vectors"), keyed.select("key", "docid", "vectors"), "key")

    for q in blocks_of(asked) if size else ():
        first = top_k(_list_bounds(bounds, q, centroids, None, first_lists), first_lists, doc="list").select("list").distinct()
        first = sorted(r["list"] for r in first.collect())
        # any k documents give a threshold: those that look best
        begun = materialize(top_k(_scan(codes.filter(F.col("list").isin(first)), q, centroids, None, k, others_only), k).select("qid", "docid", "list"), "begun")
        begun = scored(begun, first)
        best = {r["qid"]: r["least"] for r in begun.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).collect()}
        least = np.array([best.get(i, -np.inf) - SLACK for i in q.ids.tolist()])
        wanted = sorted(r["list"] for r in _list_bounds(bounds, q, centroids, least, first_lists).select("list").distinct().collect())
        pairs = materialize(_scan(codes.filter(F.col("list").isin(wanted)), q, centroids, least, k, others_only), "pairs")
        found.append(top_k(scored(pairs, wanted), k).select("qid", "docid", "score", "rank"))
        counts.append((sum(size.values()), sum(size[x] for x in {*first, *wanted}), len(q.ids) * docs, pairs.count()))
    hits = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "qid bigint, docid bigint, score double, rank int")
    total = [sum(c) for c in zip(*counts, strict=True)] or [0, 0, 0, 0]
    return hits, spark.createDataFrame(list(zip(("vectors", "codes", "pairs", "scored"), total, strict=True)), "kind string, n long")
