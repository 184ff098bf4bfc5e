"""Sources, sinks and flows bound to the driver's tables: files are written to the shared folder and read again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toolweave.functions import calls, text
from toolweave.functions.checker import check_calls
from toolweave.operators import catalog as cat
from toolweave.operators import containment, metrics, prompts, requests, responses, retrieval, traces, training
from toolweave.operators.order import dealt, dense_index, seeded_shuffle, top_k
from toolweave.plans import commands, evaluate, extend
from toolweave.plans.queries import EVENT_TYPES, _call_text, _search_tables, _whole, ndcg_cosine, table
from toolweave.sources import readers, workbooks, writers
from toolweave.sources.shared import materialize, scratch
from toolweave.streaming import results as stream


def picked(values: list[str], number: Column) -> Column:
    """The value at a number modulo their count."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


# files


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.round("value").cast("long").alias("whole"))
    writers.write_json_lines(rows, path)
    return readers.read_json_lines(spark, path, {"event_id": "bigint", "event_type": "string", "props": "json", "whole": "bigint"}, tolerant=False).select(*rows.columns)


def jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per bucket of users, in the order of ids, some lines broken: rows after the first of these are gone."""
    path = scratch(spark, "tolerant")
    line = F.when(F.col("event_id") % 97 == 60, "broken {").otherwise(F.to_json(F.struct("event_id", "event_type")))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("bucket"), "event_id", line.alias("line"))
    rows.repartition(5, "bucket").sortWithinPartitions("bucket", "event_id").select("bucket", "line").write.partitionBy("bucket").text(path)
    read = readers.read_json_lines(spark, f"{path}/*/part-*", {"event_id": "bigint", "event_type": "string"})
    return read.select("event_id", "event_type", "ordinal")


def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus with header, queries quoted, qrels without header."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    paths = [scratch(spark, n) for n in ("corpus", "queries", "qrels")]
    writers.write_tsv(docs.select(F.col("doc_id").alias("docid"), F.col("text").alias("document_content")), paths[0])
    writers.write_tsv(bench.select(F.col("item_id").alias("qid"), F.col("text").alias("query")), paths[1])
    writers.write_tsv(docs.select((F.col("doc_id") % 7).alias("qid"), F.lit(0).alias("head"), F.col("doc_id").alias("docid"), F.lit(1).alias("tail")), paths[2], header=False)
    digest = lambda kind, rows, key, body: rows.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("key"), F.md5(F.coalesce(body, F.lit(""))).alias("digest"))
    corpus = digest("corpus", readers.read_corpus(spark, paths[0]), "docid", F.col("document_content"))
    queries = digest("queries", readers.read_queries(spark, paths[1]), "qid", F.col("query"))
    qrels = digest("qrels", readers.read_qrels(spark, paths[2]), "docid", F.col("qid").cast("string"))
    return corpus.unionAll(queries).unionAll(qrels)


def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "array")
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    table(spark, sf_dir, "nation").agg(F.to_json(rows).alias("value")).write.text(path)
    return readers.read_json_array(spark, f"{path}/part-*", "n_nationkey int, n_name string").select("ordinal", "n_nationkey", "n_name")


def json_array_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as files that are a JSON array each, over many lines, with commas, quotes and brackets in texts; read in splits."""
    row = F.struct("event_id", F.concat(F.col("event_type"), F.lit(' ["'), F.col("user_id"), F.lit('", {\\]')).alias("label"), "value", "props")
    lines = table(spark, sf_dir, "events").select(F.to_json(row).alias("value"))

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(before if k == 0 else ",") + v for k, v in enumerate(values)], pa.string())], ["value"])
            before = "," if values else before
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], ["value"])

    lines.mapInArrow(bracketed, "value string").write.text(path := scratch(spark, "arrays"))
    return readers.read_json_array(spark, f"{path}/part-*", "event_id long, label string, value double, props string").select("event_id", "label", "value", "props")


def directory_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as queries in a folder per region and parity."""
    root = scratch(spark, "subsets")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select("n_regionkey", "c_custkey", "c_name")
    for region in range(5):
        for parity in range(2):
            one = rows.filter((F.col("n_regionkey") == region) & (F.col("c_custkey") % 2 == parity)).select("c_custkey", "c_name")
            writers.write_tsv(one, f"{root}/r{region}/p{parity}/test.query.txt", header=False)
    return readers.subsets(spark, root)


def score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score file per model and category: the summary line, then the failures."""
    root = scratch(spark, "scores")
    rows = table(spark, sf_dir, "events").withColumn("valid", F.col("value") > 50)
    for model in range(2):
        for category in EVENT_TYPES:
            one = rows.filter((F.col("user_id") % 2 == model) & (F.col("event_type") == category))
            summary = one.agg(F.round(F.avg(F.col("valid").cast("int")), 5).alias("accuracy"), F.count("*").alias("total_count")).select(F.lit(0).alias("at"), F.to_json(F.struct("accuracy", "total_count")).alias("value"))
            failed = one.filter("not valid").select(F.lit(1).alias("at"), F.to_json(F.struct("event_id", "value")).alias("value"))
            summary.unionAll(failed).coalesce(1).sortWithinPartitions("at").select("value").write.text(f"{root}/m{model}/data_{category}_score.json")
    return readers.read_scores(spark, root).select("model", "category", "accuracy", "total_count")


def _category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = [c for cs in cat.TAXONOMY.values() for c in cs]
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("user_id") % 4).alias("model"), picked(every, F.col("event_id")).alias("category"), (F.col("value") > 50).alias("valid"))
    return rows.groupBy("model", "category").agg(F.round(F.avg(F.col("valid").cast("int").cast("double")), 5).alias("accuracy"), F.count("*").alias("total_count")).withColumn("process_accuracy", F.lit(None).cast("double"))


BOARD = ["special_mean", "normal_mean", "agent_mean", "atom_mean", "single_turn_mean", "multi_turn_mean", "summary"]


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written per model, read as the board of all models."""
    root, scores = scratch(spark, "board"), _category_scores(spark, sf_dir)
    for m in range(4):
        mine = scores.filter(F.col("model") == f"m{m}")
        writers.write_scores(mine, mine.filter("accuracy < 0.5").select("model", "category"), f"{root}/m{m}")
    board = commands.rank_models(spark, root, closed_models=["m2"])
    return board.select("model", "is_closed", "summary_pct", *[F.round(c, 4).alias(c) for c in BOARD])


def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board as workbooks, one per model, merged again."""
    folder, board = scratch(spark, "books"), _category_scores(spark, sf_dir).select("model", "category", "accuracy", "total_count")
    for name, rows in (("data_special", board.filter("category like '%special%'")), ("data_normal", board.filter("category not like '%special%'"))):
        workbooks.write_workbook(rows, f"{folder}/{name}.xlsx")
    merged = workbooks.merge_workbooks(spark, folder, {"model": "string", "category": "string", "accuracy": "double", "total_count": "bigint"})
    return merged.select("model", "category", "accuracy", "total_count", F.col("at.last").alias("last"))


def _result_ids(events: DataFrame) -> DataFrame:
    multi = F.concat_ws("_", F.lit("normal_multi_turn"), "event_type", "user_id", "event_id")
    return events.select(F.when(F.col("user_id") % 2 == 0, multi).otherwise(F.concat_ws("_", F.lit("normal"), "event_type", "event_id")).alias("id"), "event_id")


def category_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended in two goes by category, read back in natural order."""
    path, ids = scratch(spark, "appended"), _result_ids(table(spark, sf_dir, "events"))
    for parity in (1, 0):
        writers.append_results(ids.filter(F.col("event_id") % 2 == parity), path)
    read = spark.read.schema("id string, event_id bigint, category string").json(path)
    return dense_index(read, writers.natural_keys("id"), "position", 1).select("id", "category", "position")


def retrieval_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "hits")
    hits = writers.retrieval_results(top_k(retrieval.bm25(*_search_tables(spark, sf_dir)), 10))
    writers.write_json_lines(hits, path)
    read = readers.read_json_lines(spark, path, {"qid": "bigint", "corpus_id_list": "array<bigint>"})
    return read.select("qid", joined(F.col("corpus_id_list").cast("array<string>")).alias("docids"))


def mean_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metrics")
    writers.append_metrics(metrics.mean_ndcg(ndcg_cosine(spark, sf_dir)), path, epoch=1, steps=20)
    return spark.read.schema("epoch int, steps int, ndcg_5 double, ndcg_10 double, ndcg double").csv(path, header=True)


def result_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that arrive as files, some twice: one row an id, scored batch by batch."""
    source, target, state = (scratch(spark, n) for n in ("arrivals", "scored", "state"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("result"), "ts")
    rows.unionAll(rows.filter("cast(id as bigint) % 3 = 0")).write.json(source)
    scored = stream.score_stream(stream.result_stream(spark, source, "3650 days"), lambda batch: batch.select("id", (F.col("result") == "click").alias("valid")), target, state)
    scored.awaitTermination()
    return spark.read.parquet(target).select("id", "valid")


# catalogue and evaluation flows


def prepare_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case and answer files of parts as functions: corpus, queries and qrels of the preparation step."""
    root = scratch(spark, "prepared")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("f"), F.col("p_partkey")).alias("name")).orderBy("p_partkey").coalesce(1)
    ident = F.concat(F.lit("normal_atom_bool_"), F.col("p_partkey")).alias("id")
    function = F.struct("name", F.col("p_name").alias("description"))
    writers.write_json_lines(parts.select(ident, F.concat(F.lit("find\n"), "p_name").alias("question"), F.array(function).alias("function")), f"{root}/cases")
    called = F.concat(F.lit('{"id": "normal_atom_bool_'), "p_partkey", F.lit('", "ground_truth": {"'), "name", F.lit('_1": {"q": 1}}}'))
    parts.filter("p_partkey % 3 <> 0").select(called.alias("value")).write.text(f"{root}/answers")
    corpus, queries, qrels = commands.prepare(spark, f"{root}/cases/part-*", f"{root}/answers/part-*", f"{root}/out")
    return (
        corpus.select(F.lit("corpus").alias("kind"), F.col("docid").cast("bigint").alias("a"), F.col("name").alias("b"))
        .unionAll(queries.select(F.lit("queries"), F.col("qid").cast("bigint"), F.concat_ws("/", "subset", "query")))
        .unionAll(qrels.select(F.lit("qrels"), F.col("qid").cast("bigint"), F.col("docid").cast("string")))
    )


def evaluate_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded results of two categories against golden answers, from files to the summary."""
    root, events = scratch(spark, "evaluated"), table(spark, sf_dir, "events")
    ident = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("normal_atom_number_"), "event_id")).otherwise(F.concat_ws("_", F.lit("normal_multi_turn_user_adjust"), "user_id", "event_id"))
    function = '[{"name": "find", "parameters": {"properties": {"tag": {"type": "string"}, "n": {"type": "integer"}}, "required": ["tag"]}}]'
    writers.write_json_lines(events.select(ident.alias("id"), F.lit("?").alias("question"), F.lit(function).alias("function")), f"{root}/cases")
    answer = F.concat(F.lit('{"id": "'), ident, F.lit('", "ground_truth": {"find": {"tag": "'), "event_type", F.lit('", "n": '), "user_id", F.lit("}}}"))
    events.select(answer.alias("value")).write.text(f"{root}/answers")
    said = F.when(F.col("value") > 50, F.col("event_type")).otherwise(F.lit("nothing"))
    result = F.when(F.col("value") > 300, "[find(").otherwise(F.concat(F.lit("[find( tag='"), said, F.lit("', n="), "user_id", F.lit(")]")))
    writers.write_json_lines(events.select(ident.alias("id"), result.alias("result")), f"{root}/results")
    out = commands.evaluate_model(spark, "m", f"{root}/cases", f"{root}/results", f"{root}/answers", f"{root}/scores")
    return out.select("model", "category", "accuracy", "process_accuracy", "total_count")


def case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases, answers for some, results for others: the table for reading, and what has no counterpart."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("question"))
    answers = cases.filter("id % 3 <> 0").select("id", F.col("question").alias("ground_truth"))
    checked = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    checked = checked.select("id", (F.col("n") > 1).alias("valid"), F.lit(None).cast("string").alias("error_type"), F.col("n").cast("string").alias("result"))
    only = evaluate.unmatched(answers, checked).withColumnRenamed("only_in", "side")
    return evaluate.case_table(cases, answers, checked).join(only, "id", "left").select("id", "question", "ground_truth", "valid", "result", "side")


def agent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as agents' runs: end states by number of turns, milestones by roles."""
    turns = table(spark, sf_dir, "conversations")
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    runs = turns.groupBy("conv_id").agg(roles.alias("process"), F.count("*").alias("n")).withColumn("id", F.concat(picked(["agent_multi_step_", "agent_multi_turn_"], F.col("conv_id")), F.col("conv_id")))
    state = lambda n: F.concat(F.lit('{"Box": {"n": '), n.cast("string"), F.lit(', "open": {"a": 1}}}'))
    stones = F.array(*[F.array(*map(F.lit, s)) for s in (["user", "assistant", "user", "tool"], ["system", "user"])])
    answers = runs.select("id", state(F.lit(4)).alias("state_json"), stones.alias("milestones"))
    return evaluate.agent_scores(evaluate.evaluate_agents(runs.select("id", state(F.col("n")).alias("state_json"), "process"), answers))


def agent_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a dialogue: cut at the stop phrase, milestones, next actor."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    trace = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case"), step.alias("step"), F.lit("agent").alias("sender"),
        F.when(F.col("event_type").isin("purchase", "view"), "execution").otherwise(F.col("event_type")).alias("recipient"),
        F.when(F.col("value") > 200, "so finish conversation now").otherwise(F.col("props")).alias("message"),
    )
    cut = traces.cut_dialogues(trace)
    done = traces.milestones(cut).join(traces.next_actor(cut), "case").join(cut.groupBy("case").agg(F.count("*").alias("steps")), "case")
    return done.select("case", "actor", "steps", F.array_join("milestones", "|").alias("milestones"))


def final_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("props"), F.col("props"))
    states = table(spark, sf_dir, "events").select(F.col("user_id").alias("case"), F.col("event_type").alias("class"), F.struct("ts", "event_id").alias("step"), attributes.alias("attributes"))
    out = traces.final_states(states, {"click": ["props"], "view": ["value", "props"], "signup": []})
    return out.select("case", "class", F.size("attributes").alias("n"), F.element_at("attributes", "props").alias("props"))


def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.concat(F.lit("["), F.col("event_type"), F.lit("(a=1), "), picked(EVENT_TYPES, F.col("event_id")), F.lit("(b='x')]"))
    found = table(spark, sf_dir, "events").select("user_id", F.explode(calls.decode_calls(listed)).alias("c")).select("user_id", "c.func")
    return metrics.key_counts(found, ["user_id"])


# retrieval


def late_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus ranked by the best products of parts of the vectors."""
    part = F.array(*[F.slice("embedding", 1 + 16 * k, 16) for k in range(4)])
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docid"), "embedding", part.cast("array<array<double>>").alias("vectors"))
    asked = vectors.filter("docid % 20 = 0").withColumnRenamed("docid", "qid")
    return extend.retrieve("colbert", asked, vectors, 50).select("qid", "docid", "score", "rank")


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations: cached, embedded by a service where they are missing, zero where that fails."""
    turns = table(spark, sf_dir, "conversations")
    texts = turns.select("text").distinct()
    cache = turns.filter("turn = 0").select("text").distinct().select("text", F.array(F.length("text").cast("double"), F.lit(0.0)).alias("embedding"))
    missing = retrieval.missing_embeddings(texts, cache)
    asked = F.when(F.length("text") % 5 == 0, F.lit("fail")).otherwise(F.col("text"))
    served = requests.call_service(missing.withColumn("body", requests.embedding_body("m", asked)), requests.echo, attempts=2, delay=0.0)
    fresh = served.select("text", responses.embedding_of("response").alias("embedding")).filter("embedding is not null")
    filled = retrieval.fill_embeddings(texts, cache.unionAll(fresh), 2)
    return filled.select(F.md5("text").alias("text_md5"), F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


#: Lines of orders that a task puts together, about.
LINES_A_TASK = 250_000


def extend_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases of functions (parts), filled up with candidates of other parts, without those told to be alike."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("docid"), F.concat(F.lit("f"), F.col("p_partkey")).alias("name"), F.col("p_name").alias("document_content"))
    lines_read = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("docid"), "l_linenumber")
    lines = lines_read.join(parts, "docid")
    # dealt by case before both groupings, which need no other shuffle then
    lines = dealt(lines, lines_read.count(), "qid", each=LINES_A_TASK)
    first = lines.groupBy("qid", "name", "document_content").agg(F.min("l_linenumber").alias("at"))
    functions = F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "document_content"))), lambda x: F.struct(x["name"].alias("name"), x["document_content"].alias("json")))
    cases = materialize(first.groupBy("qid").agg(functions.alias("functions")), "cases")
    place = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank")
    hits = cases.select("qid", place).select("qid", F.pmod(F.col("qid") * 7 + F.col("rank") * 13, F.lit(parts.count())).alias("docid"), "rank").groupBy("qid", "docid").agg(F.min("rank").alias("rank"))
    alike = hits.filter("docid % 4 = 0 and qid % 2 = 0").select("qid", F.concat(F.lit("f"), "docid").alias("candidate"), picked(["1", " 2 ", "0"], F.col("qid")).alias("verdict"))
    out = extend.extend_cases(cases, hits, parts, alike, limit=10, targets=[4, 9])
    return out.select("qid", "target", joined(F.transform("functions", lambda f: f["name"])).alias("names"))


# texts and calls


def function_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = F.array(*[F.struct(F.lit(t).alias("name"), F.lit(t.upper()).alias("body")) for t in EVENT_TYPES])
    events = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 4 == 0, F.lit("none_1")).otherwise(F.concat_ws("_", "event_type", F.col("event_id") % 3))
    names = F.array(F.lit("view"), F.lit("nope"), F.col("event_type"), F.lit("view"))
    kept = prompts.retained_functions(functions, names)
    return events.select("event_id", prompts.find_description(functions, key)["body"].alias("found"), joined(F.transform(kept, lambda f: f["body"])).alias("kept"))


def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as a catalogue: the first one, by item, that each document contains, and how many it contains."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}]{6,}"), F.lit(0))
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("docid"), F.explode(words).alias("name"))
    return containment.first_contained(table(spark, sf_dir, "documents"), names, "doc_id")


def sft_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions listed behind a marker in a system text: one row each, with those that valid calls name."""
    listed = F.concat(F.lit('[{"name": "'), "event_type", F.lit('", "description": "d"}, {"name": "other", "description": "'), "event_id", F.lit('"}]'))
    system = F.when(F.col("event_id") % 5 == 0, F.lit("no list")).otherwise(F.concat(F.lit("Use these: "), listed))
    rows = training.read_functions(table(spark, sf_dir, "events").select("event_id", "event_type", system.alias("system")), "Use these: ")
    known = F.from_json("functions_json", training.FUNCTIONS)
    valid = training.valid_functions(known, F.array(F.lit("other"), F.lit("click")))
    one = training.single_functions(rows.withColumn("valid", F.size(valid)))
    return one.select("event_id", F.col("function_at").cast("int").alias("function_at"), F.get_json_object("function_json", "$.name").alias("name"), "valid")


def pretty_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = F.concat(F.lit('{"'), "event_type", F.lit('": {"user": '), "user_id", F.lit(', "tag": "it\'s", "ok": true, "none": null, "l": [1, "'), "event_type", F.lit('"]}}'))
    answers = F.when(F.col("event_id") % 2 == 0, golden).otherwise(F.concat(F.lit("["), golden, F.lit(', {"g": {}}]')))
    events = table(spark, sf_dir, "events")
    document = text.document_text(F.col("event_type"), F.lit(None).cast("string"), F.col("props"))
    return events.select("event_id", F.array_join(calls.print_answers(answers), "; ").alias("answers"), document.alias("document"))


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array(*[F.concat(F.col("event_type"), F.lit(str(k))) for k in range(5)])
    return table(spark, sf_dir, "events").select("event_id", joined(seeded_shuffle(values)).alias("shuffled"))


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the text functions make of generated answers."""
    raw = F.concat(F.lit("  ["), "event_type", F.lit("(on=true, off=false, v=null)] "))
    thought = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("<think>a\nb</think>\n\n")).otherwise(F.lit("<think>open ")), "event_type")
    tagged = F.concat(F.lit("x<tool_call>"), "props", F.lit("\n</tool_call><tool_call>2</tool_call>"))
    names = F.concat(F.lit("["), "event_type", F.lit(", pkg.f][other]"))
    missing = F.concat(F.lit("Missing (a, "), "event_type", F.lit(") for the api (f"), "user_id", F.lit(")"))
    value = picked(['"t"', "5", "[1, 2]", '{"a": 1}', '""', "true"], F.col("event_id"))
    unwrapped = text.unwrap_single(F.create_map(F.lit("one"), F.array("event_type"), F.lit("two"), F.array("event_type", "props")))
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.python_literals(raw).alias("literals"),
        text.without_white_space(F.concat_ws(" \t\n", "event_type", "props")).alias("tight"),
        prompts.without_thoughts(thought).alias("answer"),
        prompts.between_tags(tagged, "tool_call").alias("tagged"),
        joined(text.function_names(names)).alias("names"),
        joined(text.function_names(names, F.array(F.lit("click"), F.lit("other")))).alias("known"),
        text.without_call_number(F.concat_ws("_", "event_type", F.lit("x"), "user_id")).alias("key"),
        joined(text.missing_parameters(missing)).alias("missing"),
        F.coalesce(text.answer_type(value), F.lit("-")).alias("kind"),
        F.coalesce(F.element_at(unwrapped, "one"), F.lit("-")).alias("one"),
    )


def parse_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable calls of a list with an unreadable one, of a single call, of no call."""
    several = F.concat(F.lit("["), "event_type", F.lit("(1, 'a', user="), "user_id", F.lit("), bad(x=y), h(l=[1, {'k': None}])]"))
    written = F.when(F.col("event_id") % 3 == 0, several).when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit("(ok=True)"))).otherwise(F.lit("I can't call anything"))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(calls.parse_calls(written)).alias("at", "c"))
    return rows.select("event_id", F.col("at").cast("int").alias("at"), "c.func", "c.args_json", "c.kwargs_json")


def decode_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and JSON decoding by model, values of all kinds, empty and unreadable output."""
    strict = F.concat(F.lit("[a.b(n=-"), "user_id", F.lit(", x=(1, 2.5), s='it''s', d={'k': [True, None]}, e=..., m=1+2*3, w=word, f=g(z=1))]"))
    by_json = F.concat(F.lit('[{"f": "{\\"n\\": '), "user_id", F.lit('}"}, {"g": {"t": "'), "event_type", F.lit('"}}]'))
    case = F.col("event_id") % 5
    output = F.when(case == 0, strict).when(case == 1, by_json).when(case == 2, F.lit("[]")).when(case == 3, F.lit("[f(x=)]")).otherwise(F.lit("f(x=1)"))
    decoded = calls.decode_output(output, F.when(case == 1, "my-FC-model").otherwise(F.lit("plain")))
    rows = table(spark, sf_dir, "events").select("event_id", decoded.alias("c"))
    each = F.transform("c", lambda x: F.concat(x["func"], F.lit(":"), x["args_json"]))
    return rows.select("event_id", F.array_join(each, "; ").alias("calls"), calls.is_empty(F.col("c")).alias("empty"))


SHAPES = """[{"name": "f", "parameters": {"properties": {"l": {"type": "array", "items": {"type": "string"}}, "bare": {"type": "array"}, "o": {"type": "object"},
 "d": {"type": "dict"}, "oa": {"type": "objectArray"}, "e": {"type": "enum"}, "x": {"type": "float"}, "s": {"type": "string"}}, "required": []}},
 {"name": "g", "parameters": {"properties": {"s": {"type": "string"}}, "required": ["s"]}}, {"name": "none", "parameters": {}}]"""
#: (output, answers, category): calls with {t} for the event's type and {n} for its user; answers may be alternatives.
SHAPED = [
    ("[f(l=['{t}', 'B-b'])]", ["[f(l=['{t}', 'bb'])]"], "normal"),
    ("[f(l=['{t}'])]", ["[f(l=['view'])]"], "normal"),
    ("[f(bare=['x'])]", ["[f(bare=['x'])]"], "normal"),
    ("[f(bare=[{'k': '{t}'}])]", ["[f(bare=[{'k': 'click'}])]"], "normal"),
    ("[f(o={'k': {'m': '{t}s'}, 'n': {n}})]", ["[f(o={'k': {'m': '{t}'}, 'n': {n}})]"], "normal"),
    ("[f(o={'k': 1})]", ["[f(o={})]"], "normal"),
    ("[f(d={'k': 1, 'more': 2})]", ["[f(d={'k': 1})]"], "normal"),
    ("[f(oa=[{'k': 1}])]", ["[f(oa=[{'k': 1}, {'k': 2}])]"], "normal"),
    ("[f(e='{t}')]", ["[f(e='other')]"], "normal"),
    ("[f(x=2)]", ["[f(x=3.5)]"], "normal"),
    ("[g(s='a {t} b')]", ["[g(s='{t}')]"], "normal"),
    ("[g(s='a {t} b')]", ["[g(s='{t}')]"], "agent"),
    ("[g(s='{t}'), f(x=1.0)]", ["[f_1(x=1.0), g(s='{t}')]"], "normal"),
    ("[g(s='{t}'), g(s='b')]", ["[g_1(s='b'), g_2(s='{t}')]"], "normal"),
    ("[g(s='a')]", ["[f(x=1.0)]"], "normal"),
    ("[g(s='a')]", ["[g(s='a'), f(x=1.0)]"], "normal"),
    ("[none()]", ["[none()]"], "normal"),
    ("[f()]", ["[f(x=1.0)]"], "normal"),
    ("[g(s='{t}')]", ["[g(s='nothing')]", "[g(s='click')]"], "normal"),
    ("[f(l='v')]", ["[f(l='v')]"], "normal"),
]


def check_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, objects, several calls, alternatives and agents through the checker; the shape is the id's number."""
    shape = F.col("event_id") % len(SHAPED)
    put = lambda t: F.replace(F.replace(F.lit(t), F.lit("{t}"), F.col("event_type")), F.lit("{n}"), F.col("user_id").cast("string"))
    choose = lambda of: F.coalesce(*[F.when(shape == k, of(row)) for k, row in enumerate(SHAPED)])
    rows = table(spark, sf_dir, "events").select(
        "event_id", choose(lambda r: put(r[0])).alias("output"), choose(lambda r: put(r[1][0])).alias("first"),
        choose(lambda r: put(r[1][1]) if len(r[1]) > 1 else F.lit(None).cast("string")).alias("second"), choose(lambda r: F.lit(r[2])).alias("category"),
    )
    answers = F.filter(F.array(calls.decode_calls("first"), calls.decode_calls("second")), lambda a: a.isNotNull())
    v = check_calls(F.lit(SHAPES), calls.decode_calls("output"), answers, category=F.col("category"))
    return rows.select("event_id", v.alias("v")).select("event_id", "v.valid", F.coalesce("v.error_type", F.lit("none")).alias("error_type"))


def sft_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    call = F.when(F.col("value") > 50, _call_text(user_id=user, n=_whole("value"))).otherwise(_call_text(user_id=F.lit("0"), n=_whole("value")))
    tags = F.concat(F.lit("<tool_call>"), call, F.lit("</tool_call>"))
    pred = F.when(F.col("event_id") % 4 == 0, tags).otherwise(F.concat(F.lit("<reflection>why\nso</reflection>"), tags))
    rows = table(spark, sf_dir, "events").select("event_id", pred.alias("pred"), _call_text(n=_whole("value"), user_id=user).alias("answer"))
    return training.split_correct(rows, "pred", "answer").select("event_id", "correct")


def check_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answers of all groups of a case: known functions in order, and the advice on their arguments."""
    case = (F.col("event_id") / 3).cast("long").cast("string")
    call = F.concat("event_type", F.lit("(user="), "user_id", F.when(F.col("event_id") % 2 == 0, F.lit(", more=null")).otherwise(F.lit("")), F.lit(")"))
    written = F.concat(F.lit("<think>t</think>\n\n["), call, F.lit(", unknown(a=1)]"))
    tries = table(spark, sf_dir, "events").select(case.alias("id"), (F.col("event_id") % 3).cast("int").alias("group_id"), written.alias("text"))
    known = tries.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, EVENT_TYPES))).alias("name"))
    required = F.when(F.col("name") == "click", F.array(F.lit("user"), F.lit("place"))).otherwise(F.array(F.lit("user")))
    functions = known.select("id", "name", F.array(F.lit("user"), F.lit("place")).alias("declared"), required.alias("required"))
    out = extend.check_tries(tries, functions)
    return out.select(F.col("id").cast("bigint").alias("id"), joined("names").alias("names"), F.array_join(F.array_sort("hints"), "; ").alias("hints"))


def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one tagged text each."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    tags = {"system": ("<s>", "</s>"), "user": ("<|user|>", "\n"), "assistant": ("<|assistant|>", "<|end|>\n")}
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(prompts.chat_format(turns, tags)).alias("chat_md5"))


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of chat requests of all conversations, of rewrites of their texts, and what a service answers."""
    messages = prompts.build_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    body = requests.chat_body("m", requests.messages_of(F.col("system"), F.col("user")), temperature=0.0, top_p=0.9, max_tokens=2048, stream=False)
    rows = messages.select("conv_id", F.when(F.length("user") % 7 == 0, F.lit("fail")).otherwise(F.col("user")).alias("user"), "system").select("conv_id", body.alias("body"))
    served = requests.call_service(rows, requests.echo, attempts=2, delay=0.0)
    answer = prompts.without_thoughts(responses.completion_text("response"))
    rewrite = requests.rewrite_requests(messages.select(F.col("conv_id").alias("qid"), F.col("user").alias("query")), 'Say "{query}" vaguely.', "m").select(F.col("qid").alias("conv_id"), F.col("body").alias("rewrite"))
    return served.join(rewrite, "conv_id").select("conv_id", F.md5("body").alias("body_md5"), F.md5(answer).alias("answer_md5"), F.md5("rewrite").alias("rewrite_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        jsonl_round_trip, jsonl_tolerant, tsv_round_trip, json_array_scan, directory_subsets, score_files, leaderboard, workbook_round_trip, category_append,
        retrieval_lists, mean_ndcg, result_stream, prepare_flow, evaluate_flow, case_table, agent_scores, agent_traces, final_states, key_counts, late_interaction,
        embedding_cache, extend_cases, function_lookup, containment_join, json_array_parts, sft_explode, pretty_answers, shuffled, text_clean, parse_lenient, decode_kinds, check_shapes, sft_split,
        check_tries, chat_texts, chat_requests,
    ]
    return {f.__name__: f for f in named}
