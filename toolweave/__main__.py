"""python -m toolweave prepare | retrieve | evaluate | leaderboard"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from toolweave.plans import commands, extend
from toolweave.sources.shared import drop_tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="toolweave")
    step = out.add_subparsers(dest="step", required=True)
    p = step.add_parser("prepare", help="corpus, queries and qrels from case and answer files")
    for name in ("cases", "answers", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--exact", action="store_true", help="resolve names by equality or dotted suffix only")
    p.add_argument("--all-functions", action="store_true", help="all functions of an answer are relevant, not only the first")
    p = step.add_parser("retrieve", help="rank the corpus for the queries and score the ranking")
    for name in ("data", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--retriever", default="bm25", choices=[*commands.RETRIEVERS])
    p.add_argument("--vectors", help="folder with the vectors of corpus and queries, for retrievers that rank by them")
    p.add_argument("--top-k", type=int, default=extend.TOP_K)
    p = step.add_parser("evaluate", help="check recorded results against golden answers")
    for name in ("model", "cases", "results", "answers", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--strict", action="store_true", help="compare numbers, booleans and enums too")
    p = step.add_parser("leaderboard", help="rank all evaluated models")
    p.add_argument("--scores", required=True)
    p.add_argument("--closed", nargs="*", default=[])
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("toolweave").getOrCreate()
    try:
        run(spark, a)
    finally:
        drop_tables(spark)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.step == "prepare":
        commands.prepare(spark, a.cases, a.answers, a.output, a.exact, a.all_functions)
    elif a.step == "retrieve":
        commands.retrieve(spark, a.data, a.output, a.retriever, a.top_k, a.vectors).show()
    elif a.step == "evaluate":
        commands.evaluate_model(spark, a.model, a.cases, a.results, a.answers, a.output, a.strict).show(truncate=False)
    else:
        commands.rank_models(spark, a.scores, a.closed).show(truncate=False)


if __name__ == "__main__":
    main()
