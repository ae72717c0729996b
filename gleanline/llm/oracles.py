"""DuckDB SQL for corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from gleanline.llm import op1_decontamination, op4_quality, op10_jaccard
from gleanline.llm.common import LOWER, UPPER

_TOKENS = "regexp_extract_all({}, '[^ \\t-\\r]+')"
_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _grams(rows: str, n: int) -> str:
    """(doc_id, k, gram): runs of n words of rows (doc_id, k, w)."""
    parts = ", ".join(f"lead(w, {j}) OVER o" for j in range(1, n))
    last = f"lead(w, {n - 1}) OVER o"
    return f"SELECT doc_id, k, gram FROM (SELECT doc_id, k, concat_ws(chr(1), w{', ' + parts if parts else ''}) AS gram, {last} IS NOT NULL AS whole FROM {rows} WINDOW o AS (PARTITION BY doc_id ORDER BY k)) WHERE whole"


_S = op1_decontamination.SPAN
DECONTAMINATION = f"""WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS ws FROM documents),
bw AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS ws FROM benchmark),
bi AS (SELECT DISTINCT item, least(len(ws), {_S}) AS n, array_to_string(ws[k:k + least(len(ws), {_S}) - 1], chr(1)) AS gram FROM bw, unnest(range(1, greatest(len(ws) - {_S} + 1, 1) + 1)) t(k) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM bi), d1 AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM dw, sizes WHERE len(ws) >= n),
hit AS (SELECT doc_id, k, d1.n, item FROM d1 JOIN bi ON bi.n = d1.n AND bi.gram = array_to_string(ws[k:k + d1.n - 1], chr(1))),
cover AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM hit), range({_S}) t(j) WHERE j < n GROUP BY doc_id), its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)"""

_RULES = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(op4_quality.RULES))
QUALITY = f"""WITH d AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d), g AS ({_grams('u', 5)}),
r AS (SELECT doc_id, k FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1), c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM r, range(5) t(j) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (regexp_matches(w, '[A-Z].*[A-Z]') AND NOT regexp_matches(w, '[a-z]')) AS caps, count(DISTINCT w) AS words FROM u GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  coalesce(caps, 0) AS n_caps_words, len(ls) AS n_lines, coalesce(words, 0) AS n_distinct_words FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (SELECT *, ({_RULES})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {op4_quality.mask(op4_quality.POLICIES['base'])} <> 0 AS base_failed, failed_bits & {op4_quality.mask(op4_quality.POLICIES[op4_quality.IN_FORCE])} = 0 AS kept, failed_bits FROM f"""

_POLICY = op4_quality.mask(op4_quality.POLICIES[op4_quality.IN_FORCE])
ABLATION = f"""WITH q AS ({QUALITY}), b AS (SELECT source, failed_bits & {_POLICY} AS bits FROM q JOIN documents USING (doc_id)), r(rule, bit) AS (VALUES {', '.join(f"('{r}', {op4_quality.BIT[r]})" for r in op4_quality.POLICIES[op4_quality.IN_FORCE])})
SELECT source, rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_failed_alone, count(*) FILTER (bits & ({_POLICY} - bit) = 0) AS n_kept_without FROM b, r GROUP BY source, rule"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS.format(_LOWERED)} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d WHERE len(ws) >= {op10_jaccard.WORDS}),
g AS (SELECT DISTINCT doc_id, gram FROM ({_grams('u', op10_jaccard.WORDS)}) UNION ALL SELECT doc_id, array_to_string(ws, chr(1)) FROM d WHERE len(ws) BETWEEN 1 AND {op10_jaccard.WORDS - 1}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {op10_jaccard.PERCENT} * (x.n + y.n - common)), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(v, w) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.w FROM c JOIN e ON e.a = c.v WHERE c.w < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(w) AS component_id FROM c GROUP BY v) m USING (doc_id)"""
