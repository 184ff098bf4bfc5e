"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

#: Shingle sets as tables, overlaps by a join on shingles, components by a recursive query.
JACCARD_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM docs),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT r AS a, r AS b FROM docs UNION SELECT reached.a, ends.b FROM reached JOIN ends ON reached.b = ends.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
FROM docs d JOIN reached ON reached.a = d.r JOIN docs e ON e.r = reached.b LEFT JOIN sizes ON sizes.r = d.r
GROUP BY d.r, d.doc_id
"""

#: CRC-32 of the decimal id: a table step per byte, from eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: Prefixes as lists of turns, a node per distinct one.
TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN turns ON turns.c = base AND pos < h
  UNION ALL SELECT convs.c, 1, pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos >= h),
seqs AS (SELECT convs.c, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS s FROM convs LEFT JOIN rebuilt ON rebuilt.c = convs.c GROUP BY convs.c),
prefixes AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS depth FROM seqs),
nodes AS (
  SELECT depth, s[1:depth] AS p, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, s[1:depth]),
kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (
  SELECT nodes.*, coalesce(kids.n, 0) AS n_children,
    (n_convs - 1) * CASE WHEN nodes.depth = 0 THEN 0 ELSE strlen(nodes.p[nodes.depth].text) END AS saved
  FROM nodes LEFT JOIN kids ON kids.depth = nodes.depth AND kids.p = nodes.p),
sums AS (
  SELECT a.depth, a.p, sum(b.saved)::BIGINT AS saved_tokens, (count(*) FILTER (b.n_children = 0))::BIGINT AS n_leaves
  FROM known a JOIN known b ON b.depth >= a.depth AND b.p[1:a.depth] = a.p GROUP BY a.depth, a.p)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, k.ends_sha256
FROM known k JOIN sums ON sums.depth = k.depth AND sums.p = k.p LEFT JOIN known up ON up.depth = k.depth - 1 AND up.p = k.p[1:k.depth - 1]
"""
