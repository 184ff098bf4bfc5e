"""The command line's steps as functions: prepare, retrieve, evaluate, leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.operators import metrics
from toolweave.operators.catalog import category_of
from toolweave.operators.leaderboard import leaderboard
from toolweave.operators.order import dense_index
from toolweave.plans import evaluate, extend
from toolweave.sources import readers, writers
from toolweave.sources.shared import materialize


def result_path(base: str, model: str, category: str, suffix: str = "_score.json") -> str:
    """Where a model's file of a category lies."""
    return f"{base.rstrip('/')}/{model}/data_{category}{suffix}"


def read_cases(spark: SparkSession, pattern: str) -> DataFrame:
    """(id, file, ordinal, question, functions_json, functions) of test cases; a single function counts as a list."""
    rows = readers.read_json_lines(spark, pattern, {"id": "string", "question": "json", "function": "json", "time": "string", "profile": "string"})
    listed = F.when(F.col("function").startswith("["), F.col("function")).otherwise(F.concat(F.lit("["), F.coalesce("function", F.lit("")), F.lit("]")))
    rows = rows.withColumn("functions_json", listed)
    bodies = F.from_json("functions_json", "array<string>")
    functions = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.description").alias("description"), b.alias("json")))
    turns = F.flatten(F.from_json("question", "array<array<struct<role:string,content:string>>>"))
    joined = F.array_join(F.transform(turns, lambda t: F.trim(F.replace(t["content"], F.lit("\n"), F.lit("")))), " ")
    plain = F.trim(F.replace("question", F.lit("\n"), F.lit("")))
    return rows.withColumn("functions", functions).withColumn("question", F.when(F.col("question").startswith("[["), joined).otherwise(plain))


def read_answers(spark: SparkSession, pattern: str) -> DataFrame:
    return readers.read_json_lines(spark, pattern, {"id": "string", "ground_truth": "json", "mile_stone": "json"})


def prepare(spark: SparkSession, cases: str, answers: str, output: str, exact: bool = False, all_functions: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write ``corpus``, ``queries`` and ``qrels`` from case and answer files, and return them.

    Query ids count the answers that have a case, in file and line order.
    """
    read = read_cases(spark, cases)
    corpus = extend.build_corpus(dense_index(read, ["file", "ordinal"], "at").select(F.col("at").alias("ordinal"), F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["json"].alias("json"))).alias("functions")))
    golden = read_answers(spark, answers).join(read.select("id", "question"), "id")
    golden = dense_index(golden.select("id", "file", "ordinal", "question", "ground_truth"), ["file", "ordinal"], "qid")
    listed = F.when(F.col("ground_truth").startswith("["), F.from_json("ground_truth", "array<string>")).otherwise(F.array("ground_truth"))
    qrels = extend.build_qrels(golden.select("qid", listed.alias("alternatives")), corpus, exact, all_functions)
    queries = golden.select("qid", F.col("question").alias("query"), category_of("id").alias("subset"))
    writers.write_tsv(corpus.select("docid", "document_content"), f"{output}/corpus")
    writers.write_tsv(queries.select("qid", "query"), f"{output}/queries")
    writers.write_tsv(qrels, f"{output}/qrels", header=False)
    return corpus, queries, qrels


#: Retrievers and the column that each needs beside the text.
RETRIEVERS = {"bm25": None, "TF-IDF": None, "index": None, "dense": "embedding", "hybrid": "embedding", "reranker": "embedding", "colbert": "vectors"}


def retrieve(spark: SparkSession, data: str, output: str, kind: str = "bm25", k: int = extend.TOP_K, vectors: str | None = None) -> DataFrame:
    """Rank the prepared corpus for the prepared queries; write the hits per query and the metrics, and return these.

    Retrievers by vectors find them in ``vectors``: Parquet tables ``corpus`` (docid)
    and ``queries`` (qid) with ``embedding`` (array<double>), or for late interaction
    ``vectors`` (array<array<double>>). What has none there is no hit and has none.
    """
    corpus = readers.read_corpus(spark, f"{data}/corpus").select(F.col("docid").cast("long").alias("docid"), F.col("document_content").alias("text"))
    queries = readers.read_queries(spark, f"{data}/queries").select(F.col("qid").cast("long").alias("qid"), F.col("query").alias("text"))
    if column := RETRIEVERS[kind]:
        if not vectors:
            raise ValueError(f"{kind} needs a folder of vectors")
        read = lambda name, key: spark.read.parquet(f"{vectors}/{name}").select(F.col(key).cast("long").alias(key), column)
        corpus, queries = corpus.join(read("corpus", "docid"), "docid", "left"), queries.join(read("queries", "qid"), "qid", "left")
    hits = extend.retrieve(kind, queries, corpus, k, others_only=False)
    if kind == "reranker":
        hits = hits.select("qid", "docid", F.col("rerank_score").alias("score"), F.col("rerank_rank").alias("rank"))
    scores = metrics.ndcg(hits, readers.read_qrels(spark, f"{data}/qrels"), queries=queries, corpus_size=corpus.count())
    mean = metrics.mean_ndcg(scores)
    writers.write_json_lines(writers.retrieval_results(hits), f"{output}/hits")
    writers.write_json_lines(mean, f"{output}/metrics", single=True)
    return mean


def evaluate_model(spark: SparkSession, model: str, cases: str, results: str, answers: str, output: str, strict: bool = False) -> DataFrame:
    """Check recorded results, write ``<output>/<model>`` summary and failures, and return the summary (model, category, ...).

    Special cases are checked by their phrases, agents by end states and
    milestones, all others by their calls; multi-turn ones count by session.
    """
    outputs = readers.read_json_lines(spark, results, {"id": "string", "result": "json", "process": "json"}).select("id", "result", "process")
    golden = read_answers(spark, answers).select("id", category_of("id").alias("category"), "ground_truth", "mile_stone")
    special, agent, multi = (F.col("category").contains(c) for c in ("special", "agent", "multi_turn"))
    called = evaluate.evaluate_calls(read_cases(spark, cases).select("id", "functions_json"), outputs.select("id", "result"), golden.filter(~special & ~agent).select("id", "ground_truth"), model, strict)
    phrased, agents = evaluate.checked_special(golden.filter(special), outputs), evaluate.checked_agents(golden.filter(agent & ~special), outputs)
    # every case is read and checked once; scores, failures and the summary that is returned read the verdicts
    called, phrased, agents = (materialize(rows, "checked") for rows in (called, phrased, agents))
    single = evaluate.single_turn_scores(called.filter(~multi).unionAll(phrased)).select("category", "accuracy", F.lit(None).cast("double").alias("process_accuracy"), "total_count")
    sessions = evaluate.multi_turn_scores(called.filter(multi)).select("category", "accuracy", F.col("process").alias("process_accuracy"), F.col("sessions").alias("total_count"))
    summary = materialize(single.unionByName(sessions).unionByName(evaluate.agent_scores(agents)).select(F.lit(model).alias("model"), "*"), "summary")
    failures = evaluate.failed_rows(called.unionAll(phrased).unionAll(agents.drop("process")))
    writers.write_scores(summary, failures, f"{output}/{model}")
    return summary


def rank_models(spark: SparkSession, scores: str, closed_models: list[str] | None = None) -> DataFrame:
    """The leaderboard of all summaries under ``scores``."""
    rows = spark.read.schema("model string, category string, accuracy double, process_accuracy double, total_count long").json(f"{scores}/*/summary")
    return leaderboard(rows, closed_models)
