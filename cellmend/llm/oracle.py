"""SQL forms of the training-data queries that SQL can express."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

#: The prior's arithmetic is that of host_rules.host_verdicts().
OP8 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_WORDS}') AS ws FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM many, unnest([0, 1, 2, 3, 4]) AS t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM failed WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT sum(n) AS sn, sum(x) AS sx, count(*) AS h, sum(x * x / n) AS sxx, sum(n * n) AS snn FROM hosts WHERE n >= 2),
mean AS (SELECT *, coalesce(sx / sn, 0) AS m FROM sums),
var AS (SELECT *, ((sxx - sx * sx / sn) - m * (1 - m) * (h - 1)) / (sn - snn / sn) AS v FROM mean),
prior AS (SELECT m, CASE WHEN h < 2 OR m <= 0 OR m >= 1 THEN 2.0 WHEN v <= 0 THEN 1e6 ELSE least(1e6, greatest(2.0, m * (1 - m) / v - 1)) END AS s FROM var),
verdict AS (SELECT source, (x + m * s) / (n + s) <= 0.5 AS ok FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM failed LEFT JOIN verdict ON verdict.source = failed.source
"""

OP10 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 34) AS g FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM many, unnest(range(35)) AS t(k)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS text, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_host_rules": OP8, "op10_substring_dedup": OP10}
