"""SQL for DuckDB that gives the rows of the registered queries, where SQL can express them."""

ORACLE: dict[str, str] = {}

ORACLE["op2_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE["op9_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""

# 40 halvings; the permutation is cut at the first document that would exceed the rest of the budget
ORACLE["op5_mixing"] = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents
), sums AS (
  SELECT source, sum(tokens)::BIGINT AS total, sum(tokens) / (SELECT sum(tokens) FROM rows) AS p
  FROM rows GROUP BY source HAVING sum(tokens) > 0
), halving(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1,
         CASE WHEN (SELECT max(exp(((low + high) / 2) * ln(p)) / p) / sum(exp(((low + high) / 2) * ln(p))) FROM sums) > 1.25 THEN (low + high) / 2 ELSE low END,
         CASE WHEN (SELECT max(exp(((low + high) / 2) * ln(p)) / p) / sum(exp(((low + high) / 2) * ln(p))) FROM sums) > 1.25 THEN high ELSE (low + high) / 2 END
  FROM halving WHERE step < 40
), target AS (SELECT round(high, 9) AS a FROM halving WHERE step = 40),
weights AS (
  SELECT source, total, a, round(exp(a * ln(p)) / sum(exp(a * ln(p))) OVER (), 9) AS weight, sum(total) OVER () AS everything
  FROM sums, target
), budgets AS (
  SELECT source, total, a, weight, floor(round(weight * everything, 3))::BIGINT AS budget FROM weights
), passes AS (
  SELECT *, budget // total AS whole, budget % total AS rest FROM budgets
), placed AS (
  SELECT r.doc_id, r.source, r.tokens, whole, rest, weight, a,
         sum(r.tokens) OVER (PARTITION BY r.source ORDER BY md5('0:' || whole || ':' || coalesce(r.doc_id::VARCHAR, '')), r.doc_id, r.tokens
                             ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows r JOIN passes s ON r.source IS NOT DISTINCT FROM s.source
), taken AS (
  SELECT *, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, source, tokens AS n_tokens, epoch, weight, a AS exponent
FROM taken, unnest(range(0, epochs)) AS t(epoch)
"""

# Links between different sets, by shared shingles; equal sets have the same shingles. Classes by repeated minima.
ORACLE["op3_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s
  FROM words, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i)
  WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT node, b FROM reach JOIN links ON a = other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS least_id FROM reach GROUP BY node) r ON r.node = d.doc_id
"""

# Two hex digits a byte; of every string of 50 bytes the smallest document that it starts in
ORACLE["op10_suffix_dedup"] = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), strings AS (
  SELECT doc_id, i, x[2 * i - 1 : 2 * i + 98] AS s FROM bytes, unnest(range(1, n - 48)) AS t(i)
), firsts AS (
  SELECT s, min(doc_id) AS least FROM strings GROUP BY s
), hits AS (
  SELECT strings.doc_id, i FROM strings JOIN firsts ON strings.s = firsts.s WHERE least < strings.doc_id
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM hits
), numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run
), cuts AS (
  SELECT doc_id, a, b, lag(b, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs
), kept AS (
  SELECT c.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
         string_agg(x[2 * before - 1 : 2 * a - 2], '' ORDER BY a) AS head, max(b) AS tail
  FROM cuts c JOIN bytes ON bytes.doc_id = c.doc_id GROUP BY c.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || x[2 * coalesce(tail, 1) - 1 :])) AS kept_sha256
FROM bytes d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

# crc32 by eight steps for each byte; turns as numbers; every node's share goes to all its ancestors
ORACLE["op12_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT conv_id, pos, dense_rank() OVER (ORDER BY role, text) AS t,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words
  FROM turns
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS head,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
               string_split(conv_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, k: CASE WHEN k >= 0 THEN xor(c, k) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
             4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, pos, t, words FROM convs c JOIN numbered n ON n.conv_id = c.head AND n.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, pos, t, words FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h
), sequences AS (
  SELECT c.conv_id, coalesce(list(r.t ORDER BY own, pos) FILTER (WHERE r.t IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), nodes AS (
  SELECT s[1:d] AS key, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '')) AS ends_sha256
  FROM sequences, unnest(range(0, len(s) + 1)) AS x(d) GROUP BY s[1:d]
), children AS (
  SELECT key[1:len(key) - 1] AS key, count(*) AS n FROM nodes WHERE len(key) > 0 GROUP BY ALL
), own AS (
  SELECT n.key, (c.n IS NULL)::BIGINT AS leaf, coalesce((n_convs - 1) * w.words, 0) AS saved
  FROM nodes n LEFT JOIN children c ON c.key = n.key
  LEFT JOIN (SELECT DISTINCT t, words FROM numbered) w ON w.t = n.key[len(n.key)]
), below AS (
  SELECT key[1:d] AS key, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM own, unnest(range(0, len(key) + 1)) AS x(d) GROUP BY key[1:d]
)
SELECT n.conv_id, len(n.key)::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.key = n.key
LEFT JOIN children c ON c.key = n.key
LEFT JOIN nodes p ON len(n.key) > 0 AND p.key = n.key[1:len(n.key) - 1]
"""
