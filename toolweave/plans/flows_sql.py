"""The same results as the flows, in SQL for another engine."""

from __future__ import annotations

from toolweave.plans.oracle import SEARCH, BM25, TAXONOMY_VALUES, oracle_sql as bound_sql

CLEAN = "replace(replace(replace({0}, '=true', '=True'), '=false', '=False'), 'null', 'None')"
EVERY = """['special_incomplete', 'special_error_param', 'special_irrelevant', 'normal_single_turn_single_function', 'normal_single_turn_parallel_function',
 'normal_multi_turn_user_adjust', 'normal_multi_turn_user_switch', 'normal_atom_bool', 'normal_atom_enum', 'normal_atom_number', 'normal_atom_list', 'normal_atom_object_short', 'normal_atom_object_deep',
 'normal_similar_api', 'normal_preference', 'agent_multi_turn', 'agent_multi_step']"""
CATEGORY_SCORES = f"""cs AS (SELECT 'm' || user_id % 4 AS model, ({EVERY})[(event_id % 17 + 1)::INT] AS category, round(avg((value > 50)::INT::DOUBLE), 5) AS accuracy, count(*) AS total_count FROM events GROUP BY 1, 2)"""
GROUP_MEANS = ", ".join(
    f"coalesce(sum(accuracy) FILTER (category IN (SELECT category FROM tax WHERE {where})), 0) / (SELECT count(*) FROM tax WHERE {where}) AS {name}_mean"
    for name, where in {"special": "g = 'special'", "normal": "g NOT IN ('special', 'agent')", "agent": "g = 'agent'", "atom": "g = 'atom'", "single_turn": "g = 'single_turn'", "multi_turn": "g = 'multi_turn'"}.items()
)
#: Verdicts by shape: a label, or what decides between valid and the label.
VERDICTS = [
    "'none'", "CASE WHEN event_type = 'view' THEN 'none' ELSE 'value_error:list/tuple' END", "'value_error'", "CASE WHEN event_type = 'click' THEN 'none' ELSE 'value_error' END",
    "'none'", "'type_error'", "'value_error'", "'value_error:list_dict_count'", "'none'", "'none'", "'none'", "'value_error:string'", "'none'",
    "'none'", "'function_mismatch'", "'wrong functions number'", "'none'", "'wrong_param'",
    "CASE WHEN event_type = 'click' THEN 'none' ELSE 'value_error:string' END", "'none'",
]
VERDICT = "CASE event_id % 20 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(VERDICTS)) + " END"


def share(stones: list[str]) -> str:
    """The share of the stones that a list ``r`` holds in order, from the first on."""
    at, parts, rest = "0", [], "r"
    for stone in stones:
        where = f"list_position({rest}, '{stone}')"
        parts.append(where)
        rest = f"list_slice({rest}, {where} + 1, len(r))"
    hits = "0"
    for k in range(len(parts), 0, -1):
        ok = " AND ".join(f"coalesce({p}, 0) > 0" for p in parts[:k])
        at = f"WHEN {ok} THEN {k}" if k == len(parts) else f"{at} WHEN {ok} THEN {k}"
        hits = at
    return f"(CASE {hits} ELSE 0 END) / {len(stones)}e0"


def oracle_sql() -> dict[str, str]:
    body = lambda system, user: f"""'{{"model":"m","messages":[' || CASE WHEN {system} <> '' THEN '{{"role":"system","content":' || to_json({system})::VARCHAR || '}},' ELSE '' END || '{{"role":"user","content":' || to_json({user})::VARCHAR || '}}]'"""
    return {
        "jsonl_round_trip": "SELECT event_id, event_type, props, round(value)::BIGINT AS whole FROM events",
        "jsonl_tolerant": """WITH e AS (SELECT *, user_id % 5 AS bucket, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS ordinal FROM events),
b AS (SELECT bucket, min(event_id) AS bad FROM e WHERE event_id % 97 = 60 GROUP BY 1)
SELECT event_id, event_type, ordinal FROM e LEFT JOIN b USING (bucket) WHERE bad IS NULL OR event_id < bad""",
        "tsv_round_trip": """SELECT 'corpus' AS kind, doc_id AS key, md5(coalesce(text, '')) AS digest FROM documents
UNION ALL SELECT 'queries', item_id, md5(coalesce(text, '')) FROM benchmark UNION ALL SELECT 'qrels', doc_id, md5((doc_id % 7)::VARCHAR) FROM documents""",
        "json_array_scan": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, n_nationkey, n_name FROM nation",
        "directory_subsets": "SELECT 'r' || n_regionkey || '/p' || c_custkey % 2 AS subset, c_custkey::INT AS qid, c_name AS query FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "score_files": """SELECT 'm' || user_id % 2 AS model, event_type AS category, round(avg((value > 50)::INT::DOUBLE), 5) AS accuracy, count(*) AS total_count
FROM events GROUP BY 1, 2""",
        "json_array_parts": """SELECT event_id, event_type || ' ["' || user_id || '", {\\]' AS label, value, props FROM events""",
        "containment_join": """WITH w AS (SELECT name, min(item_id) AS docid FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{L}]{6,}')) AS name FROM benchmark) GROUP BY 1),
f AS (SELECT doc_id, min((docid, name)) AS first, count(*) AS n FROM documents JOIN w ON contains(text, name) GROUP BY 1)
SELECT d.doc_id, first[1] AS docid, first[2] AS name, coalesce(n, 0) AS n FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
        "leaderboard": f"""WITH tax AS (SELECT * FROM {TAXONOMY_VALUES} t(g, category)), {CATEGORY_SCORES}, m AS (SELECT model, {GROUP_MEANS} FROM cs GROUP BY 1),
s AS (SELECT *, special_mean * 0.2676::DOUBLE + normal_mean * 0.578::DOUBLE + agent_mean * 0.1545::DOUBLE AS total FROM m)
SELECT model, model = 'm2' AS is_closed, format('{{:.2f}}%', total * 100) AS summary_pct, round(special_mean, 4) AS special_mean, round(normal_mean, 4) AS normal_mean, round(agent_mean, 4) AS agent_mean,
 round(atom_mean, 4) AS atom_mean, round(single_turn_mean, 4) AS single_turn_mean, round(multi_turn_mean, 4) AS multi_turn_mean, round(total, 4) AS summary FROM s""",
        "workbook_round_trip": f"WITH {CATEGORY_SCORES} SELECT model, category, accuracy, total_count, (category LIKE '%special%')::INT AS last FROM cs",
        "category_append": """WITH i AS (SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'normal_multi_turn_' || event_type || '_' || user_id || '_' || event_id ELSE 'normal_' || event_type || '_' || event_id END AS id,
 CASE WHEN user_id % 2 = 0 THEN 'normal_multi_turn_' || event_type ELSE 'normal_' || event_type END AS category FROM events)
SELECT id, category, row_number() OVER (ORDER BY category, CASE WHEN user_id % 2 = 0 THEN user_id ELSE event_id END, event_id) AS position FROM i""",
        "retrieval_lists": f"""WITH {SEARCH}{BM25}, t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM b_hits)
SELECT qid, string_agg(docid::VARCHAR, ',' ORDER BY rank) AS docids FROM t WHERE rank <= 10 GROUP BY 1""",
        "mean_ndcg": f"SELECT 1::INT AS epoch, 20::INT AS steps, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(ndcg), 6) AS ndcg FROM ({bound_sql()['ndcg_cosine']})",
        "result_stream": "SELECT event_id::VARCHAR AS id, event_type = 'click' AS valid FROM events",
        "prepare_flow": """WITH c AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS docid FROM part),
q AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS qid FROM c WHERE p_partkey % 3 <> 0)
SELECT 'corpus' AS kind, docid AS a, 'f' || p_partkey AS b FROM c UNION ALL SELECT 'queries', qid, 'normal_atom_bool/find' || p_name FROM q UNION ALL SELECT 'qrels', qid, docid::VARCHAR FROM q""",
        "evaluate_flow": """WITH r AS (SELECT event_id, user_id, value > 50 AND value <= 300 AS valid FROM events),
s AS (SELECT user_id, min(valid::INT)::DOUBLE AS accuracy, round(avg(valid::INT::DOUBLE), 5) AS process FROM r WHERE event_id % 2 = 1 GROUP BY 1)
SELECT 'm' AS model, 'normal_atom_number' AS category, round(avg(valid::INT::DOUBLE), 5) AS accuracy, NULL::DOUBLE AS process_accuracy, count(*) AS total_count FROM r WHERE event_id % 2 = 0
UNION ALL SELECT 'm', 'normal_multi_turn_user_adjust', round(avg(accuracy), 5), round(avg(process), 5), count(*) FROM s""",
        "case_table": """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS ground_truth FROM orders WHERE o_orderkey % 3 <> 0),
r AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus AS question, ground_truth, n > 1 AS valid, n::VARCHAR AS result, CASE WHEN a.id IS NULL AND r.id IS NOT NULL THEN 'right' WHEN a.id IS NOT NULL AND r.id IS NULL THEN 'left' END AS side
FROM orders LEFT JOIN a ON a.id = o_orderkey LEFT JOIN r ON r.id = o_orderkey""",
        "agent_scores": f"""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r, count(*) AS n FROM conversations GROUP BY 1),
v AS (SELECT CASE conv_id % 2 WHEN 0 THEN 'agent_multi_step' ELSE 'agent_multi_turn' END AS category, n = 4 AS valid, greatest({share(["user", "assistant", "user", "tool"])}, {share(["system", "user"])}) AS best FROM c)
SELECT category, round(avg(valid::INT::DOUBLE), 5) AS accuracy, round(avg(CASE WHEN valid THEN 1e0 ELSE best END), 5) AS process_accuracy, count(*) AS total_count FROM v GROUP BY 1""",
        "agent_traces": """WITH t AS (SELECT user_id, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
s AS (SELECT user_id, min(step) AS stop FROM t WHERE value > 200 AND step > 1 GROUP BY 1),
k AS (SELECT t.*, CASE WHEN value > 200 THEN 'so finish conversation now' ELSE props END AS message, CASE WHEN event_type IN ('purchase', 'view') THEN 'execution' ELSE event_type END AS recipient
 FROM t LEFT JOIN s USING (user_id) WHERE step < 40 AND (stop IS NULL OR step <= stop))
SELECT user_id AS "case", arg_max(recipient, step) AS actor, count(*) AS steps, coalesce(string_agg(message, '|' ORDER BY step) FILTER (recipient = 'execution'), '') AS milestones FROM k GROUP BY 1""",
        "final_states": """SELECT user_id AS "case", event_type AS class, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS n, CASE WHEN event_type IN ('click', 'view') THEN arg_max(props, (ts, event_id)) END AS props FROM events GROUP BY 1, 2""",
        "key_counts": """SELECT user_id, func, count(*) AS n FROM (SELECT user_id, event_type AS func FROM events UNION ALL SELECT user_id, (['click', 'error', 'purchase', 'signup', 'view'])[(event_id % 5 + 1)::INT] FROM events) GROUP BY 1, 2""",
        "late_interaction": """WITH v AS (SELECT q.vec_id AS qid, e.vec_id AS docid, q.embedding::DOUBLE[] AS a, e.embedding::DOUBLE[] AS b FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
p AS (SELECT qid, docid, i, max(list_dot_product(a[1 + 16 * i : 16 + 16 * i], b[1 + 16 * j : 16 + 16 * j])) AS best FROM v, range(4) t(i), range(4) u(j) GROUP BY 1, 2, 3),
s AS (SELECT qid, docid, round(sum(best), 6) AS score FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INT AS rank FROM s)
SELECT * FROM r WHERE rank <= 50""",
        "embedding_cache": """WITH t AS (SELECT DISTINCT text FROM conversations), c AS (SELECT DISTINCT text FROM conversations WHERE turn = 0)
SELECT md5(t.text) AS text_md5, CASE WHEN c.text IS NOT NULL OR length(t.text) % 5 <> 0 THEN length(t.text)::DOUBLE ELSE 0e0 END AS first, CASE WHEN c.text IS NULL AND length(t.text) % 5 <> 0 THEN 1e0 ELSE 0e0 END AS second FROM t LEFT JOIN c ON c.text = t.text""",
        "extend_cases": """WITH f AS (SELECT l_orderkey AS qid, l_partkey AS item, min(l_linenumber) AS at_line FROM lineitem GROUP BY 1, 2),
c AS (SELECT qid, count(*) AS n, string_agg('f' || item, ',' ORDER BY at_line, 'f' || item) AS names FROM f GROUP BY 1),
h AS (SELECT qid, (qid * 7 + k * 13) % (SELECT count(*) FROM part) AS docid, min(k) AS rank FROM c, range(1, 13) t(k) GROUP BY 1, 2),
r AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM h WHERE docid IN (SELECT p_partkey FROM part)),
e AS (SELECT r.qid, docid, row_number() OVER (PARTITION BY r.qid ORDER BY rank) AS fill FROM r LEFT JOIN f ON f.qid = r.qid AND f.item = docid
 WHERE rank <= 10 AND f.item IS NULL AND NOT (docid % 4 = 0 AND r.qid % 2 = 0 AND r.qid % 3 < 2))
SELECT c.qid, target::INT AS target, names || coalesce(',' || (string_agg('f' || docid, ',' ORDER BY fill) FILTER (fill <= target - n)), '') AS names
FROM c CROSS JOIN (VALUES (4), (9)) v(target) LEFT JOIN e ON e.qid = c.qid GROUP BY c.qid, target, names, n""",
        "function_lookup": """SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN upper(event_type) END AS found, CASE WHEN event_type = 'view' THEN 'VIEW' ELSE 'VIEW,' || upper(event_type) END AS kept FROM events""",
        "sft_explode": """SELECT event_id, i::INT AS function_at, CASE i WHEN 0 THEN event_type ELSE 'other' END AS name, (1 + (event_type = 'click')::INT)::INT AS valid FROM events, range(2) t(i) WHERE event_id % 5 <> 0""",
        "pretty_answers": """SELECT event_id, event_type || '(user=' || user_id || ', tag="it''s", ok=True, none=None, l=[1, ''' || event_type || '''])' || CASE WHEN event_id % 2 = 1 THEN '; g()' ELSE '' END AS answers, event_type || ', , ' || props AS document FROM events""",
        "shuffled": "SELECT event_id, event_type || '3,' || event_type || '1,' || event_type || '2,' || event_type || '4,' || event_type || '0' AS shuffled FROM events",
        "text_clean": f"""SELECT event_id, {CLEAN.format("'[' || event_type || '(on=true, off=false, v=null)]'")} AS literals, event_type || replace(props, ' ', '') AS tight,
 CASE event_id % 2 WHEN 0 THEN event_type ELSE '<think>open ' || event_type END AS answer, props || chr(10) AS tagged, event_type || ',pkg.f,other' AS names,
 CASE WHEN event_type = 'click' THEN 'click,other' ELSE 'other' END AS known, event_type || '_x' AS key, 'a, ' || event_type AS missing,
 (['STRING', 'BIGINT', 'ARRAY<BIGINT>', 'OBJECT<a: BIGINT>', '-', 'BOOLEAN'])[(event_id % 6 + 1)::INT] AS kind, event_type AS one FROM events""",
        "parse_lenient": """SELECT event_id, 0::INT AS "at", event_type AS func, CASE event_id % 3 WHEN 0 THEN '[1, "a"]' ELSE '[]' END AS args_json, CASE event_id % 3 WHEN 0 THEN '{"user": ' || user_id || '}' ELSE '{"ok": true}' END AS kwargs_json FROM events WHERE event_id % 3 < 2
UNION ALL SELECT event_id, 1, 'h', '[]', '{"l": [1, {"k": null}]}' FROM events WHERE event_id % 3 = 0""",
        "decode_kinds": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'a.b:{"n": ' || CASE WHEN user_id = 0 THEN '0' ELSE '-' || user_id END || ', "x": [1, 2.5], "s": "its", "d": {"k": [true, null]}, "e": "...", "m": 7, "w": "word", "f": {"g": {"z": 1}}}'
 WHEN 1 THEN 'f:{"n": ' || user_id || '}; g:{"t": "' || event_type || '"}' WHEN 2 THEN '' END AS calls, event_id % 5 > 1 AS "empty" FROM events""",
        "check_shapes": f"SELECT event_id, {VERDICT} = 'none' AS valid, {VERDICT} AS error_type FROM events",
        "sft_split": "SELECT event_id, event_id % 4 <> 0 AND (value > 50 OR user_id = 0) AS correct FROM events",
        "check_tries": """WITH e AS (SELECT event_id, event_id // 3 AS id, event_id % 3 AS g, event_type AS name, CASE WHEN event_type = 'click' THEN 'click: missing place' WHEN event_id % 2 = 0 THEN event_type || ': not declared more' END AS hint FROM events),
n AS (SELECT id, name, min(g) AS g FROM e GROUP BY 1, 2), h AS (SELECT DISTINCT id, hint FROM e WHERE hint IS NOT NULL)
SELECT id, string_agg(name, ',' ORDER BY g) AS names, coalesce((SELECT string_agg(hint, '; ' ORDER BY hint) FROM h WHERE h.id = n.id), '') AS hints FROM n GROUP BY 1""",
        "chat_texts": """SELECT conv_id, md5(string_agg(CASE role WHEN 'system' THEN '<s>' || text || '</s>' WHEN 'user' THEN '<|user|>' || text || chr(10) WHEN 'assistant' THEN '<|assistant|>' || text || '<|end|>' || chr(10) ELSE '' END, '' ORDER BY turn)) AS chat_md5 FROM conversations GROUP BY 1""",
        "chat_requests": f"""WITH m AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'system'), '') AS system, arg_max(text, turn) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1),
u AS (SELECT *, CASE WHEN length(asked) % 7 = 0 THEN 'fail' ELSE asked END AS said FROM m)
SELECT conv_id, md5({body("system", "coalesce(said, '')")} || ',"temperature":0.0,"top_p":0.9,"max_tokens":2048,"stream":false}}') AS body_md5, CASE WHEN said <> 'fail' THEN md5(said) END AS answer_md5,
 md5({body("''", "'Say \"' || coalesce(asked, '') || '\" vaguely.'")} || '}}') AS rewrite_md5 FROM u""",
    }
