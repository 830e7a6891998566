"""DuckDB SQL for the operators that SQL can express, over the views ``documents``, ``embeddings`` and ``pages``.

They take ids as unique, as the tables have them. The others hash with functions that DuckDB lacks, tokenize, parse HTML or learn;
``tests/llm`` holds those against brute-force versions.
"""

from __future__ import annotations

from .embed import THRESHOLD
from .repetition import BASE_N, BASE_PERCENT, LIMITS, LINE_LIMIT, MIN_WORDS, SYMBOL_LIMIT, SYMBOLS
from .suffix import MIN_LEN

CHAR = r"[^\x20\x09-\x0D]"


def repetition() -> str:
    """Words by position, n-grams by windows over them, and the characters of the words that repeated n-grams cover."""
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, i, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING), ' ') AS gram FROM m QUALIFY i <= total - {n - 1}" for n in LIMITS
    )
    sums = ", ".join(f"coalesce(sum(chars) FILTER (WHERE n = {n}), 0)::BIGINT AS dup_chars_{n}" for n in LIMITS)
    names = ", ".join(f"dup_chars_{n}" for n in LIMITS)
    fine = " AND ".join(f"dup_chars_{n} <= {v}::DOUBLE * word_chars" for n, v in LIMITS.items())
    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words)"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{CHAR}+') AS l FROM documents),
    w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM d),
    m AS (SELECT doc_id, i, word, count(*) OVER (PARTITION BY doc_id) AS total FROM w),
    g AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM ({grams})),
    c AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM g WHERE times > 1),
    r AS (SELECT doc_id, {sums}, count(*) FILTER (WHERE n = {BASE_N}) AS n_repeat_words FROM (SELECT doc_id, n, length(word) AS chars FROM c JOIN w USING (doc_id, i)) GROUP BY doc_id),
    x AS (SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{CHAR}') GROUP BY ALL),
    y AS (SELECT doc_id, sum(k - 1)::BIGINT AS n_dup_lines, coalesce(sum(k * length(line)) FILTER (WHERE k > 1), 0)::BIGINT AS dup_line_chars FROM x GROUP BY doc_id),
    s AS (SELECT d.doc_id, length(text) AS n_chars, len(l) AS n_words, length(array_to_string(l, '')) AS word_chars, length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in LIMITS)}
          FROM d LEFT JOIN r USING (doc_id) LEFT JOIN y USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
           NOT {failed} AND dup_line_chars <= {LINE_LIMIT}::DOUBLE * n_chars AND n_symbols <= {SYMBOL_LIMIT}::DOUBLE * n_words AND {fine} AS kept, dup_line_chars, {names} FROM s
    """


def removal(n: int = MIN_LEN) -> str:
    """Windows of bytes as hexadecimal digits, the smallest document of each, and what is left byte by byte."""
    return f"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * n}) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - {n - 1}))) AS i FROM d)),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
    r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE q IS NULL OR q < p - 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM c) GROUP BY doc_id),
    k AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS rest FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM r))) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE coalesce(rest, '') END)) AS kept_sha256
    FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
    """


def links(threshold: float = THRESHOLD) -> str:
    """All pairs of vectors, and what is reachable from each."""
    return f"""
    WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= {threshold}::DOUBLE * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
    r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a), c AS (SELECT a AS vec_id, least(min(a), min(b)) AS component_id FROM r GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
    """
