"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

from groundwell.llm.license_scan import CONTAINED, SHINGLE, SHORT_TEMPLATES, TEMPLATES
from groundwell.llm.quality_rules import RULES, STOP_WORDS

#: Words of a text, as in the operators.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '')"
_NOTICES = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in sorted((TEMPLATES | SHORT_TEMPLATES).items()))

# Every window that a template's shingle falls into, by plain counting.
OP2 = f"""
WITH tn AS (SELECT license, w, least(len(w), {SHINGLE}) AS width FROM (SELECT license, {_TERMS.format(x="body")} AS w FROM (VALUES {_NOTICES}) AS t(license, body))
), ts AS (SELECT DISTINCT license, width, array_to_string(w[i:i + width - 1], ' ') AS sh FROM tn, unnest(generate_series(1, len(w) - width + 1)) AS g(i)
), tc AS (SELECT license, width, count(*) AS n, (2 ** ceil(log2(count(*))))::BIGINT AS span FROM ts GROUP BY ALL
), ds AS (SELECT doc_id, width, i - 1 AS p, array_to_string(w[i:i + width - 1], ' ') AS sh
  FROM (SELECT doc_id, {_TERMS.format(x="text")} AS w FROM documents), (SELECT DISTINCT width FROM tn), unnest(generate_series(1, len(w) - width + 1)) AS g(i)
), hit AS (SELECT doc_id, license, n, sh, p // span AS k, span FROM ds JOIN ts USING (width, sh) JOIN tc USING (license, width)
), win AS (SELECT doc_id, license, n, sh, (k - b) * span AS start FROM hit, (VALUES (0), (1)) AS v(b) WHERE k >= b
), c AS (SELECT doc_id, license, start, count(DISTINCT sh) / n::DOUBLE AS containment FROM win GROUP BY doc_id, license, start, n
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, start) AS rn FROM c WHERE containment >= {CONTAINED})
SELECT doc_id, license, containment, start::INTEGER AS word_at FROM r WHERE rn = 1
"""

OP4 = r"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), t AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same FROM src
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), u AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS body,
    CASE WHEN same THEN 10 ELSE 12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n>')) + 1 + 11 END AS marks FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PASSED = " AND ".join(f"{r.numerator} {op} {r.denominator} * {bound}::DOUBLE" for r in RULES for op, bound in ((">=", r.low), ("<=", r.high)) if abs(bound) != float("inf"))

OP7 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x, {WORDS} AS w FROM documents
), l AS (SELECT *, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines FROM t
), win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM t, unnest(generate_series(1, len(w) - 2)) AS g(i)
), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1
), hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid
), m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda y: lower(y) IN ({_STOP}))) AS n_stop_words, len(lines) AS n_lines FROM l LEFT JOIN hit USING (rid)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_PASSED} AS kept FROM b
"""

OP10 = r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, (count(*) OVER g)::BIGINT AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": OP2, "op4_chat_format": OP4, "op7_quality_rules": OP7, "op10_exact_dedup": OP10}
