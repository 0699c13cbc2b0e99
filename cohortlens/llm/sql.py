"""DuckDB SQL with the same results as the registered queries, where SQL can say it."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, strlen('<|im_start|>') + length(role) + 1 + length(text) + strlen('<|im_end|>') + 1
    + CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>')
                OR regexp_matches(text, '<\^+\|(im_start|im_end)\|>')
           THEN len(regexp_extract_all(text, '<\^*\|(im_start|im_end)\|>')) ELSE 0 END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_LINES = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
), keyed AS (SELECT *, {_LOW.format(f"trim(line, {_BLANKS})")} AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT r, k.doc_id, line, pos, coalesce(k.doc_id <> s.first, false) AS lost
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""

_WORDS = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_BENCHMARK = f"""
WITH items AS (
  SELECT item_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM benchmark
), passages AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS passage FROM (
    SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
      SELECT *, least(len(w), 10) AS n FROM items WHERE len(w) > 0))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(_LOW.format("coalesce(text, '')"))} AS w FROM documents
), lengths AS (SELECT DISTINCT n FROM passages),
windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS passage FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
), met AS (SELECT r, i, windows.n, item_id FROM windows JOIN passages USING (n, passage)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM met) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

SQL = {
    "op3_chat_format": _CHAT,
    "op6_line_dedup": _LINES,
    "op8_decontaminate": _BENCHMARK,
}
