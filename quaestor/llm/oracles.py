"""DuckDB SQL for the operators that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)
), grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)
), hits AS (
  SELECT r, i, n, item FROM grams JOIN windows USING (n, g)
), hit_words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(i, i + n)) AS t(p) GROUP BY r
), hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(n)
), escaped AS (
  SELECT *, regexp_replace(CASE WHEN role IN ('system', 'user', 'assistant') THEN text ELSE length(role) || ':' || role || text END,
                           '([\[<])(\\*)(<SYS>>|</SYS>>|INST\]|/INST\]|ANS\]|ROLE\]|/ROLE\]|s>|/s>)', '\1\2\\\3', 'g') AS body FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(length(body) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 15 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

OP13 = """
WITH h AS (
  SELECT *, length(t) AS n, sha256('1:' || doc_id) AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), d AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS cut, CAST('0x' || h[25:32] AS BIGINT) % 100 AS first FROM h
), c AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, n > 0 AND t NOT LIKE '%<P>%' AND t NOT LIKE '%<S>%' AND t NOT LIKE '%<M>%' AND cut < 90 AS moved FROM d
)
SELECT doc_id, n, CASE WHEN NOT moved THEN 'plain' WHEN first < 20 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN moved THEN a END AS prefix_chars, CASE WHEN moved THEN b - a END AS middle_chars,
  sha256(CASE WHEN NOT moved THEN t WHEN first < 20 THEN '<S>' || substring(t, b + 1) || '<P>' || left(t, a) || '<M>' || substring(t, a + 1, b - a)
              ELSE '<P>' || left(t, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1, "op6_decontaminate": OP6, "op13_fill_in_middle": OP13}
