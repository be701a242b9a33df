"""Oracle SQL (DuckDB) for the training-data queries that SQL can express."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(source AS VARCHAR) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {_WORDS.format('t')} AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
tri AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri) WHERE k > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM again GROUP BY 1),
m AS (SELECT w.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
g AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words) AS rule_failed FROM f),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN rule_failed THEN 1 ELSE 0 END) AS k FROM g WHERE host IS NOT NULL GROUP BY 1),
p AS (SELECT avg(k / n) AS mu, var_samp(k / n) AS v, avg(n) AS mean_n FROM h),
s AS (SELECT host, (k + mu * st) / (n + st) AS rate FROM h CROSS JOIN (SELECT mu, greatest(1.0, coalesce(CASE WHEN v > 0 THEN mu * (1 - mu) / v - 1 END, mean_n)) AS st FROM p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 9) AS shrunk_rate,
       NOT (base_failed OR coalesce(rate >= 0.5, false) OR (rule_failed AND coalesce(rate >= 0.05, true))) AS kept
FROM g LEFT JOIN s USING (host)"""

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
lk AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
se AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
cc(id, c) USING KEY (id) AS (SELECT doc_id, doc_id FROM documents UNION
  SELECT m.id, min(m.c) FROM (SELECT se.b AS id, cc.c FROM cc JOIN se ON se.a = cc.id JOIN recurring.cc r ON r.id = se.b WHERE cc.c < r.c) m GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, cc.c AS component_id, coalesce(k.k, 0) AS n_links FROM w LEFT JOIN n USING (doc_id) JOIN cc ON cc.id = w.doc_id
LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM se GROUP BY 1) k USING (doc_id)"""

OP5 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM r),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(12 + length(er) + 1 + length(et) + 11) AS chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM a"""

OP7 = r"""
WITH dw AS (SELECT rid, doc_id, ws[p] AS word, p FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM
  (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents))),
iw AS (SELECT item_id, ws[q] AS word, q, len(ws) AS n FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS q FROM
  (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark))),
al AS (SELECT rid, doc_id, item_id, n, p - q AS diag, list(q) AS qs FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= CASE WHEN n >= 13 THEN 11 WHEN n >= 8 THEN n - 1 ELSE n END),
wi AS (SELECT doc_id, item_id, least(13, n) AS win, CASE WHEN n >= 13 THEN 11 WHEN n >= 8 THEN n - 1 ELSE n END AS need, qs, unnest(range(1, n - least(13, n) + 2)) AS s FROM al),
k AS (SELECT doc_id, item_id, win, need, len([x FOR x IN qs IF x >= s AND x < s + win]) AS m FROM wi)
SELECT doc_id, item_id, CAST(max(m) AS BIGINT) AS matched, CAST(max(win) AS BIGINT) AS "window" FROM k WHERE m >= need GROUP BY 1, 2"""

ORACLES = {"op1_quality_rules": OP1, "op2_ngram_join": OP2, "op5_chat_format": OP5, "op7_decontamination": OP7}
