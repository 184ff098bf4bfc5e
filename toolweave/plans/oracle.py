"""The same results as the queries, in SQL for another engine."""

from __future__ import annotations

WS_TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '')"

SEARCH = """
q AS (SELECT item_id AS qid, text FROM benchmark WHERE item_id % 20 = 0),
c AS (SELECT doc_id AS docid, text FROM documents),
"""

BM25 = f"""
b_docs AS (SELECT docid, {WS_TOKENS.format("text")} AS toks FROM c),
b_size AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)::DOUBLE) AS avgdl FROM b_docs),
b_tok AS (SELECT docid, len(toks)::DOUBLE AS dl, unnest(toks) AS token FROM b_docs),
b_tf AS (SELECT docid, dl, token, count(*)::DOUBLE AS tf FROM b_tok GROUP BY ALL),
b_df AS (SELECT token, count(*)::DOUBLE AS df FROM b_tf GROUP BY token),
b_raw AS (SELECT token, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS raw FROM b_df, b_size),
b_mean AS (SELECT avg(raw) AS mean_idf FROM b_raw),
b_idf AS (SELECT token, CASE WHEN raw < 0 THEN 0.25e0 * mean_idf ELSE raw END AS idf FROM b_raw, b_mean),
b_q AS (SELECT qid, token, count(*)::DOUBLE AS n_q FROM (SELECT qid, unnest({WS_TOKENS.format("text")}) AS token FROM q) GROUP BY ALL),
b_hits AS (SELECT qid, docid, round(sum(n_q * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 2) AS score
  FROM b_q JOIN b_tf USING (token) JOIN b_idf USING (token), b_size GROUP BY qid, docid)
"""

TFIDF = """
t_tok AS (SELECT docid, token, count(*)::DOUBLE AS n FROM (SELECT docid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM c) GROUP BY ALL),
t_idf AS (SELECT token, ln((1 + (SELECT count(*) FROM c)::DOUBLE) / (1 + count(*)::DOUBLE)) + 1 AS idf FROM t_tok GROUP BY token),
t_q AS (SELECT qid, token, count(*)::DOUBLE AS n FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM q) GROUP BY ALL),
t_dw AS (SELECT docid, token, n * idf AS w FROM t_tok JOIN t_idf USING (token)),
t_qw AS (SELECT qid, token, n * idf AS qw FROM t_q JOIN t_idf USING (token)),
t_dn AS (SELECT docid, sqrt(sum(w * w)) AS dn FROM t_dw GROUP BY docid),
t_qn AS (SELECT qid, sqrt(sum(qw * qw)) AS qn FROM t_qw GROUP BY qid),
t_dot AS (SELECT qid, docid, sum(qw * w) AS dot FROM t_qw JOIN t_dw USING (token) GROUP BY qid, docid),
t_hits AS (SELECT qid, docid, round(dot / (qn * dn), 2) AS score FROM t_dot JOIN t_dn USING (docid) JOIN t_qn USING (qid))
"""


def _top(hits: str, k: int) -> str:
    return f"SELECT * FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INT AS rank FROM {hits}) WHERE rank <= {k}"


DENSE = """
d AS (SELECT qid, docid, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS score, round(list_distance(a, b), 6) AS distance FROM
  (SELECT q.vec_id AS qid, e.vec_id AS docid, q.embedding::DOUBLE[] AS a, e.embedding::DOUBLE[] AS b FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)),
dt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::INT AS rank FROM d) WHERE rank <= 50)
"""

STD = "replace(translate(lower({0}), ' ,./-_*^', ''), '''', '\"')"

FILL = """
WITH bought AS (SELECT o_custkey, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
have AS (SELECT DISTINCT o_custkey, l_partkey AS item FROM bought),
existing AS (SELECT o_custkey, count(*) AS n FROM have GROUP BY 1),
sold AS (SELECT l_suppkey, l_partkey AS item, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
offered AS (SELECT o_custkey, item, max(qty) AS qty FROM (SELECT DISTINCT o_custkey, l_suppkey FROM bought) JOIN sold USING (l_suppkey) GROUP BY 1, 2),
cand AS (SELECT o_custkey, item, row_number() OVER (PARTITION BY o_custkey ORDER BY qty DESC, item) AS rank, p_brand <> 'Brand#1' AS eligible
  FROM offered JOIN part ON item = p_partkey WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.o_custkey = offered.o_custkey AND h.item = offered.item)),
taken AS (SELECT o_custkey, item, row_number() OVER (PARTITION BY o_custkey ORDER BY rank)::INT AS fill_rank FROM cand WHERE eligible AND rank <= {limit})
"""

USER, TAG = "user_id::VARCHAR", "'''' || event_type || ''''"
TAXONOMY_VALUES = """(VALUES ('special', 'special_incomplete'), ('special', 'special_error_param'), ('special', 'special_irrelevant'),
 ('single_turn', 'normal_single_turn_single_function'), ('single_turn', 'normal_single_turn_parallel_function'), ('multi_turn', 'normal_multi_turn_user_adjust'), ('multi_turn', 'normal_multi_turn_user_switch'),
 ('atom', 'normal_atom_bool'), ('atom', 'normal_atom_enum'), ('atom', 'normal_atom_number'), ('atom', 'normal_atom_list'), ('atom', 'normal_atom_object_short'), ('atom', 'normal_atom_object_deep'),
 ('similar_api', 'normal_similar_api'), ('preference', 'normal_preference'), ('agent', 'agent_multi_turn'), ('agent', 'agent_multi_step'))"""

SCORES = "s AS (SELECT user_id, event_type, avg((value > 50)::INT::DOUBLE) AS accuracy, count(*) AS n FROM events GROUP BY 1, 2)"


def oracle_sql() -> dict[str, str]:
    std_text = STD.format("text")
    return {
        "bm25_topk": f"WITH {SEARCH}{BM25} {_top('b_hits', 50)}",
        "index_topk": f"WITH {SEARCH}{BM25} {_top('b_hits', 50)}",
        "tfidf_topk": f"WITH {SEARCH}{TFIDF} {_top('t_hits', 50)}",
        "hybrid_fusion": f"""WITH {SEARCH}{BM25}, {TFIDF},
p AS (SELECT qid, docid, (SELECT count(*) FROM c) - row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS points FROM b_hits
 UNION ALL SELECT qid, docid, (SELECT count(*) FROM c) - row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) FROM t_hits),
f AS (SELECT qid, docid, sum(points)::BIGINT AS score FROM p GROUP BY 1, 2) {_top('f', 50)}""",
        "cosine_topk": f"WITH {DENSE} SELECT qid, docid, score, rank FROM dt",
        "rerank_cut": f"""WITH {DENSE}, r AS (SELECT qid, docid, score, CASE WHEN rank <= 20 THEN -distance ELSE -100.0::DOUBLE END AS rerank_score FROM dt)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, score DESC, docid)::INT AS rerank_rank FROM r""",
        "ndcg_cosine": f"""WITH {DENSE},
j AS (SELECT a.vec_id AS qid, b.vec_id AS docid FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
nr AS (SELECT qid, count(*) AS n_rel FROM j GROUP BY 1),
g AS (SELECT dt.qid, rank, avg(CASE WHEN j.docid IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) OVER (PARTITION BY dt.qid, score) AS gain FROM dt LEFT JOIN j ON dt.qid = j.qid AND dt.docid = j.docid),
dcg AS (SELECT qid, sum(CASE WHEN rank <= 5 THEN gain / log2(rank + 1e0) ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1e0) ELSE 0 END) AS d10 FROM g GROUP BY 1),
v AS (SELECT qid, d5 / list_sum(list_transform(range(1, least(5, n_rel) + 1), lambda i: 1e0 / log2(i + 1e0))) AS n5, d10 / list_sum(list_transform(range(1, least(10, n_rel) + 1), lambda i: 1e0 / log2(i + 1e0))) AS n10 FROM dcg LEFT JOIN nr USING (qid))
SELECT qid, round(n5, 6) AS ndcg_5, round(n10, 6) AS ndcg_10, round((n5 + n10) / 2, 6) AS ndcg, round(n5 + n10, 6) AS ndcg_sum FROM v""",
        "corpus_dedup": """WITH k AS (SELECT event_type, user_id, min((ts, event_id)) AS first_at, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1, 2)
SELECT event_type, user_id, row_number() OVER (ORDER BY first_at) - 1 AS docid, props FROM k""",
        "name_resolve": """WITH cat AS (SELECT p_brand || '.' || replace(p_name, ' ', '_') AS name, p_partkey AS docid, replace(p_name, ' ', '_') AS gt, split_part(p_name, ' ', 1) AS word FROM part),
g AS (SELECT DISTINCT gt FROM cat),
e AS (SELECT name AS gt, min(docid) AS d FROM cat GROUP BY 1), s AS (SELECT split_part(name, '.', -1) AS gt, min(docid) AS d FROM cat GROUP BY 1),
w AS (SELECT word, min(docid) AS d FROM cat GROUP BY 1)
SELECT g.gt, coalesce(e.d, s.d) AS by_suffix, coalesce(w0.d, w1.d) AS by_prefix FROM g LEFT JOIN e USING (gt) LEFT JOIN s ON s.gt = g.gt
LEFT JOIN w w0 ON w0.word = g.gt LEFT JOIN w w1 ON w1.word = split_part(g.gt, '_', 1)""",
        "qrels_build": "SELECT DISTINCT source AS qid, 0 AS head, doc_id AS docid, 1 AS tail FROM labels JOIN documents USING (doc_id) WHERE quality = 1",
        "group_assign": """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
m AS (SELECT *, least(5, n) AS k, n // least(5, n) AS m, n // (n // least(5, n)) AS b, n % (n // least(5, n)) AS e FROM r),
p AS (SELECT *, CASE WHEN rank < e * (b + 1) THEN rank // (b + 1) ELSE e + (rank - e * (b + 1)) // b END AS ch, CASE WHEN rank < e * (b + 1) THEN rank % (b + 1) ELSE (rank - e * (b + 1)) % b END AS inside FROM m)
SELECT o_custkey, o_orderkey, rank::INT AS rank, (k - inside % k)::INT AS group_id FROM p UNION ALL SELECT o_custkey, o_orderkey, rank::INT, 0 FROM p WHERE ch = 0""",
        "inrow_bm25": f"""WITH first AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1),
q AS (SELECT conv_id, {WS_TOKENS.format("lower(text)")} AS toks FROM conversations JOIN first USING (conv_id, turn)),
d AS (SELECT c.conv_id, c.turn AS docid, {WS_TOKENS.format("lower(text)")} AS toks FROM conversations c JOIN first f ON c.conv_id = f.conv_id AND c.turn <> f.turn),
z AS (SELECT conv_id, count(*)::DOUBLE AS n, avg(len(toks)::DOUBLE) AS avgdl FROM d GROUP BY 1),
tf AS (SELECT conv_id, docid, dl, token, count(*)::DOUBLE AS tf FROM (SELECT conv_id, docid, len(toks)::DOUBLE AS dl, unnest(toks) AS token FROM d) GROUP BY ALL),
raw AS (SELECT conv_id, token, ln(any_value(n) - count(*)::DOUBLE + 0.5e0) - ln(count(*)::DOUBLE + 0.5e0) AS raw FROM tf JOIN z USING (conv_id) GROUP BY 1, 2),
mean AS (SELECT conv_id, avg(raw) AS mean_idf FROM raw GROUP BY 1),
idf AS (SELECT conv_id, token, CASE WHEN raw < 0 THEN 0.25e0 * mean_idf ELSE raw END AS idf FROM raw JOIN mean USING (conv_id)),
qt AS (SELECT conv_id, token, count(*)::DOUBLE AS n_q FROM (SELECT conv_id, unnest(toks) AS token FROM q) GROUP BY ALL)
SELECT conv_id, docid, round(sum(n_q * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 2) AS score FROM qt JOIN tf USING (conv_id, token) JOIN idf USING (conv_id, token) JOIN z USING (conv_id) GROUP BY 1, 2""",
        "message_build": "SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'system'), '') AS system, arg_max(text, turn) FILTER (role = 'user') AS \"user\" FROM conversations GROUP BY 1",
        "question_flatten": "SELECT conv_id, string_agg(trim(replace(coalesce(text, ''), chr(10), '')), ' ' ORDER BY turn) AS question FROM conversations GROUP BY 1",
        "candidate_fill": FILL.format(limit=30) + "SELECT o_custkey, item, fill_rank FROM taken JOIN existing USING (o_custkey) WHERE fill_rank <= 20 - n",
        "multi_target_fill": FILL.format(limit=60) + "SELECT o_custkey, target::INT AS target, item, fill_rank FROM taken JOIN existing USING (o_custkey), (VALUES (10), (20), (30), (40), (50)) v(target) WHERE fill_rank <= target - n",
        "resume_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
        "natural_sort": "SELECT c_custkey, c_name, row_number() OVER (ORDER BY regexp_extract(c_name, '(\\d+)$', 1)::BIGINT, c_custkey) AS position FROM customer",
        "std_string": f"SELECT doc_id, md5({std_text}) AS std_md5, length({std_text})::INT AS std_chars FROM documents",
        "contains_check": f"""WITH a AS (SELECT conv_id, turn, text, lag(split_part(trim(text), ' ', -1)) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)
SELECT conv_id, turn, contains({std_text}, {STD.format("answer")}) AS contained FROM a WHERE answer IS NOT NULL""",
        "special_classify": """WITH k AS (SELECT page_id, html, regexp_extract(url, '//([^/]+)', 1) AS host, CASE page_id % 3 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'error_param' ELSE 'irrelevant' END AS kind FROM pages)
SELECT page_id, kind, CASE kind WHEN 'incomplete' THEN CASE WHEN NOT contains(html, '<nav>') THEN 'error_detection' WHEN NOT (contains(html, host) AND contains(html, 'the') AND contains(html, '<h1>')) THEN 'error_correction' ELSE 'none' END
 WHEN 'error_param' THEN CASE WHEN NOT contains(html, '&quot;') THEN 'error_detection' WHEN NOT (contains(html, 'the') AND contains(html, '<h1>')) THEN 'error_correction' ELSE 'none' END
 ELSE CASE WHEN NOT contains(html, 'class="ad"') THEN 'error_detection' ELSE 'none' END END AS error_type FROM k""",
        "call_args_diff": """WITH g AS (SELECT event_id, list_distinct(list_concat(json_keys(props), [event_type])) AS given FROM events)
SELECT event_id, array_to_string(list_sort(list_filter(['k', 'click'], lambda x: NOT list_contains(given, x))), ',') AS missing, array_to_string(list_sort(list_filter(given, lambda x: NOT list_contains(['k', 'view'], x))), ',') AS redundant FROM g""",
        "islands_accuracy": """WITH l AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l),
s AS (SELECT event_type, user_id, island, bool_and(value > 50)::INT AS accuracy, round(avg((value > 50)::INT::DOUBLE), 5) AS process FROM i GROUP BY 1, 2, 3)
SELECT event_type, round(avg(accuracy::DOUBLE), 5) AS accuracy, round(avg(process), 5) AS process, count(*) AS sessions FROM s GROUP BY 1""",
        "session_accuracy": "SELECT conv_id, bool_and(length(text) > 100)::INT AS accuracy, round(avg((length(text) > 100)::INT::DOUBLE), 5) AS process, count(*) AS n FROM conversations GROUP BY 1",
        "milestone_prefix": """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
u AS (SELECT DISTINCT user_id FROM events),
s1 AS (SELECT u.user_id, min(i) AS p FROM u LEFT JOIN e ON e.user_id = u.user_id AND event_type = 'signup' GROUP BY 1),
s2 AS (SELECT s1.user_id, any_value(s1.p) AS p1, min(i) AS p FROM s1 LEFT JOIN e ON e.user_id = s1.user_id AND event_type = 'view' AND i > s1.p GROUP BY 1),
s3 AS (SELECT s2.user_id, any_value(p1) AS p1, any_value(s2.p) AS p2, min(i) AS p FROM s2 LEFT JOIN e ON e.user_id = s2.user_id AND event_type = 'click' AND i > s2.p GROUP BY 1),
s4 AS (SELECT s3.user_id, any_value(p1) AS p1, any_value(p2) AS p2, any_value(s3.p) AS p3, min(i) AS p4 FROM s3 LEFT JOIN e ON e.user_id = s3.user_id AND event_type = 'purchase' AND i > s3.p GROUP BY 1)
SELECT user_id, ((p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT + (p4 IS NOT NULL)::INT) / 4e0 AS share FROM s4""",
        "unweighted_rollup": f"""WITH {SCORES}, w AS (SELECT user_id, coalesce(max(accuracy) FILTER (event_type = 'error'), 0) AS er, coalesce(max(accuracy) FILTER (event_type = 'click'), 0) AS cl, coalesce(max(accuracy) FILTER (event_type = 'purchase'), 0) AS pu,
 coalesce(max(accuracy) FILTER (event_type = 'view'), 0) AS vi, coalesce(max(accuracy) FILTER (event_type = 'signup'), 0) AS si FROM s GROUP BY 1)
SELECT user_id, round(er, 6) AS special, round((cl + pu + vi) / 3, 6) AS normal, round(si, 6) AS agent, round(er * 0.2676::DOUBLE + (cl + pu + vi) / 3 * 0.578::DOUBLE + si * 0.1545::DOUBLE, 6) AS summary, round((cl + er + pu + si + vi) / 5, 6) AS accuracy FROM w""",
        "weighted_accuracy": f"WITH {SCORES} SELECT event_type, round(sum(accuracy * n) / sum(n)::DOUBLE, 6) AS accuracy FROM s GROUP BY 1",
        "rate_quota": """WITH g AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) <= 2 AS granted FROM events)
SELECT minute, sum(granted::INT)::BIGINT AS granted, count(*) AS asked FROM g GROUP BY 1""",
        "rate_spacing": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT user_id, event_id, i, us AS since, true AS granted FROM e WHERE i = 1
 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.us - g.since >= 86400000000 THEN e.us ELSE g.since END, e.us - g.since >= 86400000000 FROM g JOIN e ON e.user_id = g.user_id AND e.i = g.i + 1)
SELECT user_id, event_id, granted FROM g""",
        "category_sink": "SELECT CASE WHEN user_id % 2 = 0 THEN 'normal_multi_turn_' || event_type ELSE 'normal_' || event_type END AS category, count(*) AS n FROM events GROUP BY 1",
        "category_expand": f"""WITH x AS (SELECT * FROM {TAXONOMY_VALUES} t(g, category)), y AS (SELECT * FROM x UNION ALL SELECT 'normal', category FROM x WHERE g NOT IN ('special', 'agent')),
a AS (SELECT (['special', 'single_turn', 'multi_turn', 'atom', 'similar_api', 'preference', 'agent', 'normal', 'other'])[(event_id % 9 + 1)::INT] AS name FROM events)
SELECT name, coalesce(category, name) AS category, count(*) AS n FROM a LEFT JOIN y ON name = g GROUP BY 1, 2""",
        "pair_verdicts": """WITH l AS (SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT l_orderkey, arg_min(p_brand, (l_linenumber, p_brand)) AS first FROM l GROUP BY 1),
n AS (SELECT DISTINCT l_orderkey, p_brand, first FROM l JOIN f USING (l_orderkey) WHERE p_brand <> first)
SELECT l_orderkey, count(*) AS kept FROM n WHERE NOT right(p_brand, 1) > right(first, 1) GROUP BY 1""",
        "prompt_build": """SELECT event_id, (CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'zh' END) || '/' || (CASE event_id % 3 WHEN 0 THEN 'special' WHEN 1 THEN 'preference' ELSE 'normal' END) || ': ' || props || ' | ' || event_type || ' |  | ' || user_id::VARCHAR AS prompt FROM events""",
        "sft_assemble": f"""WITH p AS (SELECT event_id, user_id, value, event_type || '(user_id=' || {USER} || ', tag=' || {TAG} || ')' AS gold,
 CASE event_id % 3 WHEN 0 THEN event_type || '(user_id=' || {USER} || ', tag=' || {TAG} || ')' WHEN 1 THEN event_type || '(tag=' || {TAG} || ', user_id=' || {USER} || ')' ELSE event_type || '(user_id=' || round(value)::BIGINT::VARCHAR || ', tag=' || {TAG} || ')' END AS pred FROM events)
SELECT event_id, '[' || pred || ', ' || gold || ']' AS candidates, event_id % 3 < 2 OR round(value)::BIGINT = user_id AS correct FROM p""",
        "reflection_diff": """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'tag' ELSE '' END AS missing, CASE WHEN event_id % 3 = 1 THEN 'flag' ELSE '' END AS redundant, CASE WHEN event_id % 3 = 2 THEN 'user_id' ELSE '' END AS wrong_type FROM events""",
        "decode_calls": """SELECT event_id, event_type AS func, '{"user_id": ' || user_id::VARCHAR || ', "value": ' || round(value)::BIGINT::VARCHAR || ', "props": ' || props || ', "tag": "' || event_type || '"}' AS args_json FROM events""",
        "check_calls": """SELECT event_id, event_id % 6 = 0 AS valid, CASE event_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'lack_args' WHEN 2 THEN 'addition_args' WHEN 3 THEN 'type_error' WHEN 4 THEN 'value_error:string' ELSE 'wrong_output_format' END AS error_type FROM events""",
    }
