"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_METRIC_SQL = {
    "n_words": "n_words",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "stop_word_share": "n_stop_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_char_share": "n_upper / greatest(word_chars, 1)",
}


def quality_sql(source: str = "documents", columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    tests = [f"{_METRIC_SQL[r.metric]} >= {r.low}" for r in RULES if r.low is not None]
    tests += [f"{_METRIC_SQL[r.metric]} <= {r.high}" for r in RULES if r.high is not None]
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    return rf"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS body FROM {source}),
 w AS (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
              list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
 g AS (SELECT rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] AS gram
       FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS p FROM w)),
 r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
 c AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY rid),
 m AS (SELECT d.*, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
              length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
              length(regexp_replace(body, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
              len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
              len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, coalesce(c.n, 0)::BIGINT AS n_repeat_words
       FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT {columns} FROM (SELECT *, NOT base_failed AND {' AND '.join(tests)} AS kept FROM b)
"""


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
 d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
              CASE WHEN strlen(body) >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to FROM d
"""


ORACLE = {
    "op5_quality_rules": quality_sql(),
    "op10_warc_index": _WARC,
}
