"""DuckDB SQL that restates queries independently of their operators."""

from . import quality as Q

_CUTS = ", ".join(map(str, Q.CUTOFFS))

SQL = {
    "op6_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT rid, unnest(range(0, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4], ws[i + 5]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, range(0, 5) AS o(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (
  SELECT d.rid, doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN w ON w.rid = d.rid JOIN l ON l.rid = d.rid LEFT JOIN r ON r.rid = d.rid),
m AS (
  SELECT *, coalesce('=' || lang, '') AS s, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    [coalesce(n_symbols / nullif(word_chars, 0), 0), coalesce(n_capitals / nullif(word_chars, 0), 0), coalesce(n_dup_lines / nullif(n_lines, 0), 0), coalesce(n_repeat_words / nullif(n_words, 0), 0)] AS shares
  FROM b),
marks AS (SELECT DISTINCT doc_id AS id, quality AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL),
grid AS (SELECT rule, i, ([{_CUTS}])[i + 1] AS c FROM range(0, {len(Q.RULES)}) AS a(rule), range(0, {len(Q.CUTOFFS)}) AS b(i)),
cells AS (
  SELECT s, rule, i, c, count(*) FILTER (good > 0) AS n, count(*) FILTER (good > 0 AND shares[rule + 1] > c) AS k, count(*) FILTER (good <= 0 AND shares[rule + 1] > c) AS hit
  FROM m JOIN marks ON m.doc_id = marks.id, grid WHERE NOT base_failed GROUP BY ALL),
tested AS (
  SELECT *, CASE WHEN n = 0 OR k >= n * {Q.LIMIT / len(Q.RULES)} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({Q.LIMIT / len(Q.RULES)}) + (n - j) * ln(1 - {Q.LIMIT / len(Q.RULES)})))) END
    <= {Q.DELTA / len(Q.RULES)} / (SELECT count(DISTINCT s) FROM m) AS ok FROM cells),
certain AS (SELECT *, bool_and(ok) OVER (PARTITION BY s, rule ORDER BY i) AS all_ok FROM tested),
best AS (SELECT s, rule, arg_min(c, {{'g': {Q.PRICE} * k - hit, 'i': i}}) AS c FROM certain WHERE all_ok AND hit - {Q.PRICE} * k > 0 GROUP BY ALL)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM best WHERE best.s = m.s AND m.shares[best.rule + 1] > best.c) AS kept
FROM m
""",
    "op10_sharding": None,
}
SQL = {k: v for k, v in SQL.items() if v}
