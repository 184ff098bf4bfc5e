"""The two larger flows: extending a benchmark with retrieved functions, and try-check-retry prompting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolweave.functions.calls import parse_calls
from toolweave.functions.text import argument_difference, python_literals
from toolweave.operators import catalog, grouping, index, maxsim, ranker, responses, retrieval
from toolweave.operators.order import dealt, top_k
from toolweave.operators.prompts import without_thoughts
from toolweave.sources.shared import scratch

# Sizes of the extension step.
TOP_K, CANDIDATES, TARGETS = 50, 60, [10, 20, 30, 40, 50]
#: Cases that a task extends, about.
CASES_A_TASK = 50_000


def build_corpus(cases: DataFrame) -> DataFrame:
    """(docid, name, document_content) of all functions of ``cases`` (ordinal, functions: array of (name, json))."""
    rows = cases.select("ordinal", F.posexplode("functions").alias("at", "f")).select("ordinal", "at", F.col("f.name").alias("name"), F.col("f.json").alias("document_content"))
    return catalog.build_catalog(rows, ["name"], ["ordinal", "at"], "document_content")


def build_qrels(answers: DataFrame, corpus: DataFrame, exact: bool = False, all_functions: bool = False) -> DataFrame:
    """(qid, head, docid, tail) from ``answers`` (qid, alternatives: array of JSON objects of calls).

    The first function of each alternative is relevant, or all with ``all_functions``.
    ``exact`` resolves names by equality or dotted suffix only.
    """
    names = F.explode("alternatives").alias("answer")
    keys = F.json_object_keys("answer")
    called = answers.select("qid", names).select("qid", F.explode(keys if all_functions else F.slice(keys, 1, 1)).alias("gt"))
    resolve = catalog.resolve_by_suffix if exact else catalog.resolve_by_prefix
    found = called.join(resolve(called, corpus), "gt").filter("docid is not null").withColumn("rel", F.lit(1))
    return catalog.qrels(found, "qid", "docid", "rel")


def retrieve(kind: str, queries: DataFrame, corpus: DataFrame, k: int = TOP_K, others_only: bool = True, model: ranker.Ranker | None = None) -> DataFrame:
    """Ranked hits by one of the retrievers over (qid, text, embedding) and (docid, text, embedding).

    ``reranker`` goes by ``model`` (``operators.ranker``), by distance where there is none.
    With ``others_only`` both sides share their ids, and none finds itself.
    ``colbert`` takes (qid, vectors) and (docid, vectors) and ranks the whole corpus by late interaction.
    """
    dense = lambda: retrieval.dense_top_k(queries, corpus, k, others_only=others_only)
    lexical = {"bm25": retrieval.bm25, "TF-IDF": retrieval.tf_idf}
    if kind in lexical:
        return top_k(lexical[kind](queries, corpus), k)
    if kind in ("dense", "ada", "ToolRetriever"):
        return dense()
    if kind == "hybrid":
        return top_k(retrieval.fuse_ranks([retrieval.bm25(queries, corpus), dense()], corpus.count()), k)
    if kind == "reranker":
        return retrieval.rerank(ranker.features(dense(), corpus), model.score()) if model else retrieval.rerank(dense(), -F.col("distance"))
    if kind == "index":
        kept = index.build(corpus.select("docid", "text"), scratch(corpus.sparkSession, "index"))
        return index.search(kept, queries.select("qid", "text"), k)
    if kind == "colbert":
        kept = maxsim.build(corpus.select("docid", "vectors"), scratch(corpus.sparkSession, "maxsim"))
        return maxsim.search(kept, queries.select("qid", "vectors"), k, others_only)
    raise ValueError(f"no such retriever: {kind}")


def extend_cases(cases: DataFrame, hits: DataFrame, corpus: DataFrame, verdicts: DataFrame | None = None, limit: int = CANDIDATES, targets: list[int] | None = None) -> DataFrame:
    """(qid, target, functions): each case's functions and retrieved ones that are neither present nor alike.

    ``cases`` (qid, functions: array of (name, json)), ``hits`` (qid, docid, rank),
    ``verdicts`` (qid, candidate, verdict). The cut to ``limit`` comes after
    missing docids are gone, as ranks of what is left. A case's hits, at most
    ``limit``, are one list beside its functions: hits, verdicts and cases meet once, by case.
    """
    dealt_by_case = lambda df, size=cases.count(): dealt(df, size, "qid", each=CASES_A_TASK)
    found = dealt_by_case(hits.join(corpus.select("docid", F.col("name").alias("item"), "document_content"), "docid")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    found = found.filter(F.col("rank") <= limit).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item").alias("name"), F.col("document_content").alias("json")))).alias("found"))
    whole = dealt_by_case(cases).join(found, "qid", "left")
    new = lambda f: ~F.array_contains(F.transform("functions", lambda g: g["name"]), f["name"])
    added = F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), new)
    if verdicts is not None:
        # as grouping.drop_similar, whose keys are here a case's list
        bad = dealt_by_case(verdicts.filter(F.trim("verdict").isin("1", "2")).select("qid", "candidate")).groupBy("qid").agg(F.collect_set("candidate").alias("alike"))
        whole = whole.join(bad, "qid", "left")
        added = F.filter(added, lambda f: ~F.array_contains(F.coalesce("alike", F.array().cast("array<string>")), f["name"]))
    added = F.transform(added, lambda f: F.struct(f["name"].alias("name"), f["json"].alias("json")))
    filled = whole.select("qid", "functions", added.alias("added")).withColumn("target", F.explode(F.array(*map(F.lit, targets or TARGETS))))
    room = F.greatest(F.col("target") - F.size("functions"), F.lit(0))
    return filled.select("qid", "target", F.concat("functions", F.slice("added", F.lit(1), room)).alias("functions"))


def divide(cases: DataFrame, k: int) -> DataFrame:
    """(id, group_id, functions): each case's functions in groups by their likeness to the question.

    ``cases`` (id, question, functions: array of (name, description, json)).
    """
    one = cases.select("id", "question", F.posexplode("functions").alias("at", "f"))
    texts = one.select("id", F.col("at").cast("long").alias("docid"), F.coalesce(F.col("f.description"), F.col("f.json")).alias("text"))
    asked = cases.select("id", F.lit(0).alias("qid"), F.col("question").alias("text"))
    scores = retrieval.bm25(asked, texts, ["id"], lower=True).select("id", F.col("docid").alias("at"), "score")
    ranked = one.join(scores, ["id", "at"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    grouped = grouping.assign_groups(ranked.select("id", "at", "f", "score"), "id", [F.desc("score"), F.asc("at")], k)
    return grouped.groupBy("id", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "f"))), lambda x: x["f"]).alias("functions"))


def hints(name: Column, missing: Column, redundant: Column) -> Column:
    """The advice on one call: its missing parameters, else its redundant ones; null if it is sound."""
    say = lambda what, names: F.concat(name, F.lit(f": {what} "), F.array_join(names, ", "))
    return F.when(F.size(missing) > 0, say("missing", missing)).when(F.size(redundant) > 0, say("not declared", redundant))


def check_tries(tries: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, names, hints) from the first answers ``tries`` (id, group_id, text) of all groups of a case.

    ``functions`` (id, name, declared: array, required: array). Names are kept in
    the order of group and call; unknown functions are left out.
    """
    calls = tries.select("id", "group_id", F.posexplode(parse_calls(python_literals(without_thoughts(F.col("text"))))).alias("at", "c"))
    known = calls.select("id", "group_id", "at", F.col("c.func").alias("name"), F.json_object_keys("c.kwargs_json").alias("given")).join(functions, ["id", "name"])
    missing, redundant = argument_difference(F.coalesce("given", F.array().cast("array<string>")), F.col("declared"), F.col("required"))
    known = known.withColumn("hint", hints(F.col("name"), missing, redundant))
    ordered = F.array_sort(F.collect_list(F.struct("group_id", "at", "name", "hint")))
    out = known.groupBy("id").agg(ordered.alias("calls"))
    return out.select("id", F.array_distinct(F.transform("calls", lambda c: c["name"])).alias("names"), F.array_distinct(F.filter(F.transform("calls", lambda c: c["hint"]), lambda h: h.isNotNull())).alias("hints"))


def try_check_retry(cases: DataFrame, functions: DataFrame, first: DataFrame, second: DataFrame, k: int = 3) -> DataFrame:
    """(id, functions, hints, result): the retained functions of each case, and the recorded second answer.

    ``first`` (id, group_id, text) and ``second`` (id, text) are recorded or generated answers.
    """
    tries = responses.from_table(divide(cases, k), first, ["id", "group_id"])
    checked = check_tries(tries.filter("text is not null").select("id", "group_id", "text"), functions)
    body = lambda n: F.try_element_at(F.filter("functions", lambda f: f["name"] == n), F.lit(1))
    kept = cases.join(checked, "id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    kept = kept.select("id", F.filter(F.transform("names", body), lambda f: f.isNotNull()).alias("functions"), F.coalesce("hints", F.array().cast("array<string>")).alias("hints"))
    return kept.join(second.select("id", F.col("text").alias("result")), "id", "left")
