"""Operators on literal rows with results worked out by hand or by plain loops."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from toolweave.functions import text
from toolweave.operators import catalog, grouping, leaderboard, metrics, order, prompts, quota, responses, retrieval, traces, training


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def bm25_loop(query, docs):
    """Plain loop over all documents."""
    toks = [d.split() for d in docs]
    n, mean = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for ts in toks for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    eps = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: eps if v < 0 else v for t, v in idf.items()}
    return [sum(idf[t] * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in query.split() if t in df) for ts in toks]


def with_zero_scores(hits, queries, corpus):
    """The full lists, for comparison: all other documents of each query at score 0."""
    pairs = queries.select("qid").distinct().crossJoin(corpus.select("docid"))
    return pairs.join(hits, ["qid", "docid"], "left").select("qid", "docid", F.coalesce("score", F.lit(0.0)).alias("score"))


def test_bm25_and_zero_scores(spark):
    docs = ["a b c", "a a d", "", "x y z w", "b"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "docid long, text string")
    queries = spark.createDataFrame([(7, "a b a"), (8, "nothing")], "qid long, text string")
    hits = retrieval.bm25(queries, corpus)
    full = {(q, d): s for q, d, s in values(with_zero_scores(hits, queries, corpus), "qid", "docid", "score")}
    for i, want in enumerate(bm25_loop("a b a", docs)):
        assert full[7, i] == pytest.approx(want, abs=0.006)
        assert full[8, i] == 0


def test_dense_top_k_and_late_interaction(spark):
    vectors = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 3.0])]
    corpus = spark.createDataFrame(vectors, "docid long, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, embedding array<float>")
    got = values(retrieval.dense_top_k(queries, corpus, 2), "rank", "docid", "score")
    assert got == [(1, 0, 1.0), (2, 2, pytest.approx(0.707107))]
    q = spark.createDataFrame([(1, 9, [[1.0, 0.0], [0.0, 1.0]])], "k int, qid long, vectors array<array<double>>")
    d = spark.createDataFrame([(1, 5, [[0.5, 0.0], [0.2, 0.9]])], "k int, docid long, vectors array<array<double>>")
    assert values(retrieval.late_interaction(q, d, "k")) == [(9, 5, pytest.approx(1.4))]


def test_fusion_rerank_cache(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (1, 2, 4.0)], "qid long, docid long, score double")
    b = spark.createDataFrame([(1, 2, 9.0), (1, 3, 1.0)], "qid long, docid long, score double")
    assert values(retrieval.fuse_ranks([a, b], 10)) == [(1, 1, 9), (1, 2, 17), (1, 3, 8)]
    ranked = order.top_k(a, 2)
    assert values(retrieval.rerank(ranked, F.col("docid") * 1.0, depth=1), "docid", "rerank_score", "rerank_rank") == [(1, 1.0, 1), (2, -100.0, 2)]
    texts = spark.createDataFrame([("x",), ("y",)], "text string")
    cache = spark.createDataFrame([("x", [1.0, 2.0])], "text string, embedding array<double>")
    assert values(retrieval.fill_embeddings(texts, cache, 2)) == [("x", [1.0, 2.0]), ("y", [0.0, 0.0])]
    assert values(retrieval.missing_embeddings(texts, cache)) == [("y",)]


def test_ndcg_with_ties(spark):
    hits = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 2.0), (1, 4, 1.0), (2, 1, 1.0), (3, 9, 1.0)], "qid long, docid long, score double")
    qrels = spark.createDataFrame([(1, 2), (1, 4), (2, 7)], "qid long, docid long")
    got = {r.qid: r for r in metrics.ndcg(hits, qrels).collect()}
    want = (0.5 / math.log2(3) + 0.5 / math.log2(4) + 1 / math.log2(5)) / (1 + 1 / math.log2(3))
    assert got[1].ndcg_5 == pytest.approx(want, abs=1e-6)
    assert got[2].ndcg_5 == 0 and got[3].ndcg_5 is None
    # the documents that are no hits, listed at score 0 or counted as one tie, give the same
    queries = spark.createDataFrame([(1,), (2,), (4,)], "qid long")
    corpus = spark.range(9).withColumnRenamed("id", "docid")
    qrels = spark.createDataFrame([(1, 2), (1, 7), (2, 7), (4, 0), (4, 1)], "qid long, docid long")
    listed = metrics.ndcg(with_zero_scores(hits, queries, corpus), qrels)
    assert values(metrics.ndcg(hits.filter("qid < 3"), qrels, queries=queries, corpus_size=9)) == values(listed)


def test_ndcg_against_a_loop(spark):
    rng = random.Random(1)
    hits = [(q, d, float(rng.randrange(6))) for q in range(40) for d in range(rng.randrange(1, 25))]
    rel = [(q, d) for q in range(40) for d in range(25) if rng.random() < 0.3]
    frames = spark.createDataFrame(hits, "qid long, docid long, score double"), spark.createDataFrame(rel, "qid long, docid long")
    for r in metrics.ndcg(*frames).collect():
        relevant = {d for q, d in rel if q == r.qid}
        own = sorted((-s, d) for q, d, s in hits if q == r.qid)
        for k in (5, 10):
            if not relevant:
                assert r[f"ndcg_{k}"] is None
                continue
            gain = [sum(d in relevant for t, d in own if t == s) / sum(t == s for t, _ in own) for s, _ in own]
            dcg = sum(g / math.log2(i + 2) for i, g in enumerate(gain[:k]))
            best = sum(1 / math.log2(i + 2) for i in range(min(k, len(relevant))))
            assert r[f"ndcg_{k}"] == pytest.approx(dcg / best, abs=1e-6) and 0 <= r[f"ndcg_{k}"] <= 1


def test_sessions_islands_accuracy(spark):
    rows = spark.createDataFrame([("u", i, t, v) for i, (t, v) in enumerate([("a", True), ("a", False), ("b", True), ("a", True)])], "user string, ts int, kind string, valid boolean")
    runs = metrics.islands(rows, "user", ["ts"], "kind")
    assert [r.island for r in runs.orderBy("ts").collect()] == [1, 1, 2, 3]
    assert values(metrics.session_accuracy(runs, ["user", "island"], ["kind"])) == [("a", 0.5, 0.75, 2), ("b", 1.0, 1.0, 1)]
    scores = spark.createDataFrame([("m", "x", 0.5, 4), ("m", "y", 1.0, 1), ("n", "x", 1.0, 0)], "model string, category string, accuracy double, n int")
    assert values(metrics.weighted_accuracy(scores, ["model"])) == [("m", 0.6), ("n", 0.0)]
    assert values(metrics.unweighted_accuracy(scores, "model", "category", "accuracy", ["x", "y"])) == [("m", 0.75), ("n", 0.5)]


@pytest.mark.parametrize(("trace", "stones", "want"), [("axbc", "abc", 1.0), ("axbc", "azc", 1 / 3), ("ba", "ab", 0.5), ("", "ab", 0.0), ("ab", "", 1.0), ("aab", "aab", 1.0)])
def test_milestones(spark, trace, stones, want):
    df = spark.createDataFrame([(list(trace), list(stones))], "t array<string>, s array<string>")
    assert df.select(metrics.milestone_share(F.col("t"), F.col("s"))).first()[0] == pytest.approx(want)


def test_milestones_of_rows(spark):
    traces = {1: "axbc", 2: "ba", 3: "aab", 4: "x", 5: "abcabc"}
    rows = spark.createDataFrame([(k, i, v) for k, t in traces.items() for i, v in enumerate(t)], "k int, at int, v string")
    for stones in ("abc", "aab", ""):
        arrays = rows.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("t"))
        want = values(arrays.select("k", metrics.milestone_share(F.col("t"), F.array(*map(F.lit, stones)).cast("array<string>")).alias("share")))
        assert values(metrics.milestone_rows(rows, "k", ["at"], "v", list(stones))) == want


def groups_loop(n, k):
    """Chunks, round robin and regrouping as loops."""
    kk = min(k, n)
    m = n // kk
    chunks, at = [], 0
    for i in range(m):
        size = n // m + (i < n % m)
        chunks.append(list(range(at, at + size)))
        at += size
    buckets = [[x for c in chunks for p, x in enumerate(c) if p % kk == b] for b in range(kk)]
    return [chunks[0], *reversed(buckets)]


@settings(deadline=None)
@given(st.integers(1, 40), st.integers(1, 8))
def test_chunk_numbers(n, k):
    kk = min(k, n)
    m = n // kk
    b, e = divmod(n, m)
    got = [r // (b + 1) if r < e * (b + 1) else e + (r - e * (b + 1)) // b for r in range(n)]
    want = [i for i in range(m) for _ in range(n // m + (i < n % m))]
    assert got == want


def test_groups(spark):
    sizes = {1: 1, 2: 4, 3: 7, 4: 23}
    items = spark.createDataFrame([(c, i) for c, n in sizes.items() for i in range(n)], "case long, item long")
    rows = grouping.assign_groups(items, "case", [F.col("item")], 5).collect()
    for case, n in sizes.items():
        for g, want in enumerate(groups_loop(n, 5)):
            assert sorted(r.rank for r in rows if r.case == case and r.group_id == g) == sorted(want), (case, g)


def test_fill_and_pairs(spark):
    existing = spark.createDataFrame([("a", 1), ("b", 5)], "case string, n int")
    cand = spark.createDataFrame([("a", f"c{i}", i, i != 2) for i in range(1, 6)] + [("b", "c1", 1, True)], "case string, item string, rank int, eligible boolean")
    got = values(grouping.fill_to_targets(existing, cand, "case", [3, 4], 4))
    assert got == [("a", 3, "c1", 1), ("a", 3, "c3", 2), ("a", 4, "c1", 1), ("a", 4, "c3", 2), ("a", 4, "c4", 3)]
    cases = spark.createDataFrame([(1, ["x", "y"], ["y", "z"])], "id int, candidates array<string>, existing array<string>")
    pairs = grouping.similarity_pairs(cases)
    assert values(pairs, "candidate", "function") == [("x", "y"), ("x", "z")]
    verdicts = pairs.withColumn("verdict", F.when(F.col("function") == "z", " 1 ").otherwise("0"))
    assert grouping.drop_similar(pairs, verdicts, ["candidate"]).count() == 0


def test_catalog_and_names(spark):
    rows = spark.createDataFrame([("f", 3, "old"), ("g", 1, "g"), ("f", 5, "new"), ("f", 0, "oldest")], "name string, at int, body string")
    assert values(catalog.build_catalog(rows, ["name"], ["at"], "body")) == [("f", 0, "new"), ("g", 1, "g")]
    cat = spark.createDataFrame([("pkg.run", 0), ("run", 1), ("get", 2), ("stop_now", 3)], "name string, docid long")
    gt = spark.createDataFrame([("run",), ("get_all",), ("stop_now_2",), ("zzz",)], "gt string")
    assert dict(values(catalog.resolve_by_suffix(gt, cat))) == {"run": 1, "get_all": None, "stop_now_2": None, "zzz": None}
    assert dict(values(catalog.resolve_by_prefix(gt, cat))) == {"run": 0, "get_all": 2, "stop_now_2": 3, "zzz": None}
    done = spark.createDataFrame([("b",)], "id string")
    assert values(catalog.remaining(spark.createDataFrame([("a",), ("b",)], "id string"), done, "id")) == [("a",)]
    ids = spark.createDataFrame([("normal_multi_turn_user_adjust_3_1",), ("normal_atom_bool_7",)], "id string")
    assert values(ids.select(catalog.category_of("id"))) == [("normal_atom_bool",), ("normal_multi_turn_user_adjust",)]


def test_dense_index_is_dense(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = [r.position for r in order.dense_index(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1000))
    assert order.dense_index(df.filter("false"), ["k"]).count() == 0


def test_prompts(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S1"), (1, 1, "user", " hi\nthere "), (1, 2, "system", "S2"), (1, 3, "user", "last"), (2, 0, "system", "only")], "case long, turn int, role string, text string")
    assert values(prompts.build_messages(turns, "case", "turn", base="B")) == [(1, "BS1S2", "last"), (2, "Bonly", None)]
    assert values(prompts.flatten_question(turns, "case", "turn"))[0] == (1, "S1 hithere S2 last")
    one = spark.createDataFrame([("<think>x</think>\n\nanswer", "a<c>b</c><c>d</c>")], "a string, b string")
    assert one.select(prompts.without_thoughts(one.a), prompts.between_tags(one.b, "c")).first() == ("answer", "b")
    df = spark.createDataFrame([([("f", 1), ("g", 2), ("f", 3)], ["g", "f", "g", "x"], "my_g_1")], "fs array<struct<name:string,v:int>>, names array<string>, key string")
    r = df.select(prompts.retained_functions(df.fs, df.names).alias("kept"), prompts.find_description(df.fs, df.key).alias("d")).first()
    assert [x.v for x in r.kept] == [2, 1] and r.d.v == 2
    chat = spark.createDataFrame([([("user", "q"), ("other", "z"), ("assistant", "a")],)], "t array<struct<role:string,content:string>>")
    assert chat.select(prompts.chat_format(chat.t, {"user": ("<u>", "\n"), "assistant": ("<a>", "\n")})).first()[0] == "<u>q\n<a>a\n"
    assert spark.range(1).select(prompts.fill_template("{a}-{b}", a=F.lit("x"), b=F.lit(None))).first()[0] == "x-"


def test_text_functions(spark):
    df = spark.createDataFrame([("It's A-b_c. d/e*f^,", "x=true y=null ")], "a string, b string")
    r = df.select(text.standardize(df.a), text.python_literals(df.b), text.without_white_space(df.b)).first()
    assert r == ('it"sabcdef', "x=True y=None", "x=truey=null")
    df = spark.createDataFrame([("[a.b, c] d", ["c", "a.b"], "f_12", {"k": [1], "m": [1, 2]})], "s string, c array<string>, n string, v map<string,array<int>>")
    r = df.select(text.function_names(df.s), text.function_names(df.s, df.c), text.without_call_number(df.n), text.unwrap_single(df.v)).first()
    assert r == (["a.b", "c", "d"], ["a.b", "c"], "f", {"k": 1, "m": None})


def test_quota(spark):
    df = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 20, 59])], "user_id long, event_id long, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.granted for r in quota.per_minute(df, 2).orderBy("event_id").collect()] == [True, True, False, False, False]
    assert [r.granted for r in quota.spaced(df, "user_id", 10).orderBy("event_id").collect()] == [True, False, False, True, True]


def test_leaderboard(spark):
    every = [c for cs in catalog.TAXONOMY.values() for c in cs]
    scores = spark.createDataFrame([("m", c, 0.4) for c in every] + [("n", every[0], 1.0)], "model string, category string, accuracy double")
    rows = leaderboard.leaderboard(scores, ["n"]).collect()
    assert [r.model for r in rows] == ["n", "m"]
    assert rows[1].summary == pytest.approx(0.4 * 1.0001) and rows[1].summary_pct == "40.00%"
    assert rows[0].special_mean == pytest.approx(1 / 3)


def test_training(spark):
    rows = spark.createDataFrame([('intro MARK[{"name": "f"}, {"name": "g"}]',), ("intro MARK nothing",), ("none",)], "system string")
    single = training.single_functions(training.read_functions(rows, "MARK"))
    assert [json.loads(r.function_json)["name"] for r in single.orderBy("function_at").collect()] == ["f", "g"]
    f = [{"name": "f", "parameters": {"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}}]
    assert training.difference("[f(a='x', b='y')]", "[f(a=1), g()]", f) == {"redundant": [], "missing": ["g"], "params": {"f": {"redundant": ["b"], "missing": [], "value": [], "type": ["a"]}}}
    assert training.difference("[f(zz=1)]", "[f(a=1)]", f) is None and training.difference("x", "[f(a=1)]", f) is None
    df = spark.createDataFrame([("<reflection>r</reflection><tool_call>[f(a=1)]</tool_call>", "[f(a=1)]"), ("[f(a=1)]", "[f(a=1)]"), (None, "[f(a=1)]")], "pred string, answer string")
    assert values(training.split_correct(df.filter("pred is not null"), "pred", "answer"), "correct") == [(False,), (True,)]


def test_traces(spark):
    steps = [("c", i, "agent", "execution" if i % 2 else "user", m) for i, m in enumerate(["finish conversation", "a", "b", "finish conversation", "late"])]
    trace = spark.createDataFrame(steps, "case string, step int, sender string, recipient string, message string")
    cut = traces.cut_dialogues(trace)
    assert cut.count() == 4
    assert traces.milestones(cut).first().milestones == ["a", "finish conversation"]
    assert traces.next_actor(cut).first().actor == "execution"
    states = spark.createDataFrame([("c", 0, "K", {"x": "1"}), ("c", 2, "K", {"x": "2", "secret": "s"})], "case string, step int, class string, attributes map<string,string>")
    assert traces.final_states(states, {"K": ["x"]}).first().attributes == {"x": "2"}


def test_responses(spark):
    prompts_ = spark.createDataFrame([("a",), ("b",)], "prompt string")
    first, again = (values(responses.generate(prompts_, responses.stub)) for _ in range(2))
    assert first == again and all(t.startswith("[answer_") for _, t in first)
    df = spark.createDataFrame([('{"choices": [{"message": {"content": "hi"}}], "data": [{"embedding": [1.5]}]}',)], "r string")
    assert df.select(responses.completion_text("r"), responses.embedding_of("r")).first() == ("hi", [1.5])


def test_best_of_lists_is_exact(spark):
    """Against plain unions, with ties, short lists, items of several lists and needs beyond all lists."""
    rng = random.Random(6)
    lists = [(k, i, float(rng.randrange(9))) for k in range(6) for i in rng.sample(range(40), rng.choice([1, 5, 30]))]
    members = [(c, k, need) for c, need in enumerate([1, 3, 8, 25, 60]) for k in rng.sample(range(6), 1 + c)]
    got = grouping.best_of_lists(spark.createDataFrame(members, "c int, k int, need int"), spark.createDataFrame(lists, "k int, i int, s double"), "c", "k", "i", "s", "need", 60)
    best = {}
    for r in got.collect():
        best.setdefault(r.c, {})[r.i] = r.s
    for c, need in {(c, n) for c, _, n in members}:
        whole = {}
        for k, i, s in lists:
            if (c, k, need) in members:
                whole[i] = max(s, whole.get(i, -1))
        want = sorted(whole.items(), key=lambda x: (-x[1], x[0]))[:need]
        assert sorted(best[c].items(), key=lambda x: (-x[1], x[0]))[:need] == want and all(whole[i] == s for i, s in best[c].items())


def test_rank_within_keys(spark):
    rows = [(k, v) for k in ("a", "b", None) for v in (3, 1, 2, 2)] + [("c", 5)]
    got = order.rank_within(spark.createDataFrame(rows, "k string, v int"), ["k"], [-F.col("v")])
    assert sorted((r.k, r["rank"], r.v) for r in got.collect() if r.k) == sorted((k, n + 1, v) for k, vs in {"a": [3, 2, 2, 1], "b": [3, 2, 2, 1], "c": [5]}.items() for n, v in enumerate(vs))


def test_minute_quota_and_spacing_of_crowds(spark):
    rows = [(i, i % 2, 1_700_000_000 + i * 7 % 90) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    want, seen = set(), Counter()
    for i, _, s in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[s // 60] += 1
        want |= {i} if seen[s // 60] <= 3 else set()
    assert {r.event_id for r in quota.per_minute(df, 3).filter("granted").collect()} == want
    want, last = set(), {}
    for i, u, s in sorted(rows, key=lambda r: (r[2], r[0])):
        if u not in last or s - last[u] >= 20:
            last[u] = s
            want.add(i)
    assert {r.event_id for r in quota.spaced(df, "user_id", 20).filter("granted").collect()} == want
