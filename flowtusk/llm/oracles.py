"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from flowtusk.llm.quality_rules import RULES, STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]"

_VERDICTS = " AND ".join(
    f"(n_words < {rule.least} OR ("
    + " AND ".join([f"{rule.metric} >= {rule.low}"] * (rule.low is not None)
                   + [f"{rule.metric} <= {rule.high}"] * (rule.high is not None)) + "))"
    for rule in RULES)

OP6 = rf"""
WITH base AS (
    SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
words AS (
    SELECT r, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda w: w <> '') AS ws FROM base),
lined AS (
    SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM base),
grams AS (
    SELECT r, i, hash(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS g
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM words WHERE len(ws) >= 5)),
twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (
    SELECT r, CAST(sum(least(5, coalesce(next - i, 5))) AS BIGINT) AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM twice) GROUP BY r),
counted AS (
    SELECT doc_id, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
           coalesce(covered.n, 0) AS n_repeat_words,
           len(list_filter(ws, lambda w: list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], lower(w)))) AS n_stop,
           len(list_filter(ls, lambda l: regexp_matches(l, '^[\t-\r ]*[-*•]'))) AS n_bullets,
           len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\t-\r ]*$'))) AS n_ellipses
    FROM base JOIN words USING (r) JOIN lined USING (r) LEFT JOIN covered USING (r)),
metrics AS (
    SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
           coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
           coalesce(n_stop / nullif(n_words, 0), 0) AS stop_word_ratio,
           coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
           coalesce(n_bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio,
           coalesce(n_ellipses / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
    FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_VERDICTS} AS kept
FROM metrics
"""

_ESCAPED = "length({0}) + length({0}) - length(replace(replace({0}, '\\', ''), '#', ''))"

OP7 = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           sum(14 + {_ESCAPED.format("role")} + length(role) - length(replace(role, ':', ''))
               + {_ESCAPED.format("text")} + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS formatted
    FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars
FROM joined
"""

ORACLES: dict[str, str] = {"op6_quality_rules": OP6, "op7_chat_formatting": OP7}
