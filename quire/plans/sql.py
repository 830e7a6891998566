"""DuckDB SQL for the registered queries, over views of the same tables."""

from __future__ import annotations

from ..operators import layout
from ..operators.glossary import FUNCTION_WORDS
from ..sources.html import BLOCK_TAGS
from .queries import LIMIT, TERMS

_BLOCKS = ", ".join(f"'{t}'" for t in sorted(BLOCK_TAGS))

#: Leaf blocks by windows over tokens: a leaf's group of tokens begins with its opening tag and the next block tag closes.
LEAVES = rf"""
    c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g') AS h FROM pages),
    t AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT page_id, regexp_extract_all(h, '(?s)<(?:[^>="'']|=\s*"[^"]*"|=\s*''[^'']*''|[="''])*>|[^<]+') AS toks FROM c)),
    k AS (SELECT *, starts_with(tok, '<') AS is_tag, starts_with(tok, '</') AS is_close, lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) AS nm FROM t),
    b AS (SELECT *, nm IN ({_BLOCKS}) AS is_block, sum(CASE WHEN nm IN ('nav', 'pre') THEN CASE WHEN is_close THEN -1 ELSE 1 END ELSE 0 END) OVER w AS depth,
                 sum(CASE WHEN nm IN ({_BLOCKS}) THEN 1 ELSE 0 END) OVER w AS gid FROM k WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    o AS (SELECT page_id, gid, nm, count(*) FILTER (WHERE is_tag AND NOT is_close) AS opened, min(i) FILTER (WHERE is_close AND NOT is_block) AS closed FROM b WHERE is_tag GROUP BY ALL),
    cut AS (SELECT page_id, gid, min(closed) AS at FROM o WHERE opened = 0 GROUP BY ALL),
    g AS (SELECT b.page_id, b.gid, arg_min(nm, i) AS tag, arg_min(is_close, i) AS closes, arg_min(depth, i) AS depth,
                 coalesce(string_agg(CASE WHEN NOT is_tag AND i < coalesce(cut.at, i + 1) THEN tok END, '' ORDER BY i), '') AS text
          FROM b LEFT JOIN cut USING (page_id, gid) WHERE b.gid > 0 GROUP BY b.page_id, b.gid),
    n AS (SELECT *, lead(closes) OVER (PARTITION BY page_id ORDER BY gid) AS next_closes FROM g),
    l AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY gid) - 1 AS pos, tag, trim(replace(replace(text, '&quot;', '"'), '&amp;', '&')) AS text FROM n WHERE NOT closes AND depth = 0 AND coalesce(next_closes, true)),
    leaf AS (SELECT * FROM l WHERE regexp_matches(text, '\p{{L}}'))
"""


def folded(source: str, limit: int) -> str:
    """Recursive chunk packing of ``source`` (k, i from 1, n, p): rows (k, i, c)."""
    cut = f"(r.s + x.n > {limit} OR (x.p <> r.p AND (r.s >= {limit} / 2.0 OR x.p < 0 OR r.p < 0)))"
    return f"""
    r AS (SELECT k, i, 0 AS c, n AS s, p FROM {source} WHERE i = 1
          UNION ALL
          SELECT x.k, x.i, r.c + CASE WHEN {cut} THEN 1 ELSE 0 END, CASE WHEN {cut} THEN x.n ELSE r.s + x.n END, x.p FROM r JOIN {source} x ON x.k = r.k AND x.i = r.i + 1)
    """


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)"
CHUNKED = f"""
    {LINES}, src AS (SELECT doc_id AS k, i + 1 AS i, length(line) AS n, i // 10 AS p FROM lines), {folded('src', LIMIT)},
    chunked AS (SELECT src.k AS doc_id, src.i - 1 AS i, src.n, src.p AS page_no, r.c AS chunk_no FROM src JOIN r USING (k, i))
"""
ASCII = r"regexp_replace(regexp_replace({0}, '[^\x00-\x7F\p{{L}}\p{{N}}\p{{M}}_]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
WORD = r"\b[A-Z][a-zA-Z''-]{2,}\b"
BOOKS = "books AS (SELECT cast(l_suppkey % 20 AS VARCHAR) AS book_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS block_id, l_linenumber AS page_no, l_orderkey AS chunk_id, 'p' || l_partkey AS src_html, CASE WHEN l_linestatus = 'F' THEN 'q' || l_partkey END AS dst_html, CASE WHEN l_returnflag = 'R' THEN 'overflow' END AS flag FROM lineitem)"


def flag_sql(src: str, dst: str) -> str:
    tags = r"list_sort(regexp_extract_all(lower({0}), '<\s*([a-zA-Z][a-zA-Z0-9:_-]*)', 1))"
    bare = "regexp_replace({0}, '<[^>]+>', '', 'g')"
    runs = rf"regexp_extract_all({bare}, '\p{{{{Nd}}}}+')"
    a, b = runs.format(src), runs.format(dst)
    size = rf"length(regexp_replace({bare}, '^\s+|\s+$', '', 'g'))"
    return f"""CASE WHEN regexp_replace(coalesce({dst}, ''), '^\\s+|\\s+$', '', 'g') = '' THEN 'empty'
      WHEN {tags.format(src)} <> {tags.format(dst)} THEN 'tag_mismatch'
      WHEN len(list_filter(list_distinct({a}), lambda d: len(list_filter({a}, lambda z: z = d)) > len(list_filter({b}, lambda z: z = d)))) > 0 THEN 'missing_number'
      WHEN {size.format(src)} > 80 AND {size.format(dst)} < 0.4::DOUBLE * {size.format(src)} THEN 'too_short' END"""


def ordered_sql(source: str) -> str:
    """Reading order of ``source`` (page_no, seq, col, x0, y0, ...): row and ord added."""
    return f"""
    ro1 AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page_no, col ORDER BY y0, x0, seq) > 3.0 THEN 1 ELSE 0 END AS nw FROM {source}),
    ro2 AS (SELECT *, sum(nw) OVER (PARTITION BY page_no, col ORDER BY y0, x0, seq) AS "row" FROM ro1),
    ro AS (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY col, "row", x0, y0, seq) AS ord FROM ro2)
    """


def _quote(s: str) -> str:
    return s.replace("'", "''")


ORACLE: dict[str, str] = {
    "html_leaf_blocks": f"WITH {LEAVES} SELECT page_id, pos, tag, text FROM leaf",
    "html_block_stats": f"WITH {LEAVES} SELECT tag, count(*) AS blocks, sum(length(text)) AS chars, count(DISTINCT page_id) AS pages FROM leaf GROUP BY tag",
    "apply_targets": f"WITH {LEAVES} SELECT page_id, pos, tag, length(text) AS chars FROM leaf",
    "html_book_rollup": f"""
        WITH RECURSIVE {LEAVES}, src AS (SELECT page_id AS k, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i, length(text) AS n, 0 AS p FROM leaf), {folded('src', LIMIT)},
        per AS (SELECT src.k AS page_id, count(*) AS blocks, sum(src.n) AS chars, max(r.c) + 1 AS chunks FROM src JOIN r USING (k, i) GROUP BY src.k)
        SELECT regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS section, count(*) AS pages, sum(blocks) AS blocks, sum(chars) AS chars, sum(chunks) AS chunks FROM per JOIN pages USING (page_id) GROUP BY 1""",
    "chunk_pack": f"WITH RECURSIVE {CHUNKED} SELECT doc_id, chunk_no, count(*) AS blocks, sum(n) AS chars, min(page_no) AS from_page, max(page_no) AS to_page FROM chunked GROUP BY ALL",
    "chunk_page_range": f"WITH RECURSIVE {CHUNKED} SELECT doc_id, chunk_no, min(page_no) AS from_page, max(page_no) AS to_page FROM chunked GROUP BY ALL HAVING bool_or(page_no BETWEEN 1 AND 3)",
    "page_specs": """
        SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN nullif(o_custkey % 90, 0) WHEN 1 THEN nullif(o_custkey % 90, 0) END - 1 AS first_page,
               CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 90 > 0 THEN o_custkey % 90 + 6 END WHEN 1 THEN nullif(o_custkey % 90, 0) - 1 END AS last_page FROM orders""",
    "glossary_candidates": rf"""
        WITH d AS (SELECT {ASCII.format('text')} AS t FROM documents),
        w AS (SELECT unnest(regexp_extract_all(t, '{WORD}')) AS word, 1 AS n, 0 AS s FROM d UNION ALL SELECT unnest(regexp_extract_all(t, '(?:^|[.!?])\s*({WORD})', 1)), 0, 1 FROM d),
        c AS (SELECT word, sum(n) AS n, sum(s) AS s FROM w GROUP BY word)
        SELECT word, n FROM c WHERE lower(word) NOT IN ({', '.join(f"'{x}'" for x in FUNCTION_WORDS)}) AND s / n <= 0.9::DOUBLE ORDER BY n DESC, word LIMIT 200""",
    "dq_check": f"""
        WITH p AS (SELECT conv_id, turn, role, text AS src, lead(text) OVER w AS dst, lead(role) OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        f AS (SELECT conv_id, turn, {flag_sql('src', 'dst')} AS flag FROM p WHERE role = 'user' AND r = 'assistant')
        SELECT conv_id, turn, flag, CASE WHEN flag IS NULL THEN 'accept' WHEN flag IN ('missing_number', 'missing_term') THEN 'advise' ELSE 'retry' END AS action FROM f""",
    "dq_numbers": f"""
        WITH p AS (SELECT doc_id, '<p>' || text || '</p>' AS src, CASE doc_id % 4 WHEN 0 THEN '<p>' || replace(text, '1', '2') || '</p>' WHEN 1 THEN '<p>' || 'brief' || '</p>' WHEN 2 THEN text ELSE '<P>' || text || '</P>' END AS dst FROM documents)
        SELECT doc_id, {flag_sql('src', 'dst')} AS flag FROM p""",
    "dq_missing_term": rf"""
        WITH d AS (SELECT doc_id, text AS src, left(text, length(text) // 2) AS dst FROM documents),
        g(term, translation) AS (VALUES {', '.join(f"('{_quote(a)}', '{_quote(b)}')" for a, b in TERMS)})
        SELECT doc_id, term FROM d, g WHERE src <> dst AND NOT contains(lower(dst), lower(translation))
          AND regexp_matches({ASCII.format('src')}, CASE WHEN regexp_matches(term, '^[A-Z]') THEN '' ELSE '(?i)' END || '\b' || term || '\b')""",
    "running_heads": """
        WITH d AS (SELECT DISTINCT event_type || '-' || user_id % 100 AS head, event_id // 100 AS page_no FROM events),
        w AS (SELECT head, count(*) OVER (PARTITION BY head) AS pages, count(*) OVER (PARTITION BY head ORDER BY page_no RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM d)
        SELECT head FROM w WHERE pages >= 4 GROUP BY head HAVING max(ahead) >= 6""",
    "head_slots": "SELECT cast(round_even((l_quantity * 10 + l_linenumber) / 6.0::DOUBLE, 0) AS BIGINT) AS slot, count(DISTINCT l_orderkey % 50) AS pages FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey % 50) >= 30.0::DOUBLE",
    "continuation_groups": rf"""
        WITH {LINES}, a AS (SELECT doc_id, i, line, i // 10 AS page_no, lead(i // 10) OVER w AS np, lead(line) OVER w AS nl FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        k AS (SELECT doc_id, i, coalesce(np > page_no AND trim(line) <> '' AND trim(nl) <> '' AND right(regexp_replace(line, '\s+$', ''), 1) NOT IN ('.', '!', '?', '”', '’'), false) AS lk FROM a),
        f AS (SELECT *, coalesce(lag(lk) OVER (PARTITION BY doc_id ORDER BY i), false) AS pl FROM k),
        s AS (SELECT doc_id, i, lk, pl, sum(CASE WHEN lk AND NOT pl THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS cont_group FROM f)
        SELECT doc_id, i, cont_group FROM s WHERE lk OR pl""",
    "reading_order": f"""
        WITH src AS (SELECT l_orderkey AS page_no, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS seq, (l_linenumber * 4 - (l_partkey % 3) * 2)::DOUBLE AS y0, (l_partkey % 300)::DOUBLE AS x0, l_suppkey % 2 AS col FROM lineitem), {ordered_sql('src')}
        SELECT page_no, seq, col, "row", ord FROM ro""",
    "paragraph_groups": f"""
        WITH src AS (SELECT l_orderkey AS page_no, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS seq, (l_linenumber * 12 + (l_partkey % 4) * 5)::DOUBLE AS y0, ((l_suppkey % 3) * 5)::DOUBLE AS x0, 0 AS col, (8 + l_partkey % 5)::DOUBLE AS size,
                            't' || l_partkey % 100 AS text, l_returnflag = 'R' AND l_linenumber % 4 = 0 AS ended FROM lineitem), {ordered_sql('src')},
        st AS (SELECT *, y0 - lag(y0) OVER w AS step, x0 - lag(x0) OVER w AS ind, lag(ended) OVER w AS le FROM ro WINDOW w AS (PARTITION BY page_no ORDER BY ord)),
        pg AS (SELECT page_no, list_sort(list(step) FILTER (WHERE step > 0 AND step < 60)) AS s FROM st GROUP BY page_no),
        pp AS (SELECT page_no, CASE WHEN len(s) > 0 THEN s[len(s) // 2 + 1] ELSE 12.0 END AS pitch FROM pg),
        br AS (SELECT st.*, sum(CASE WHEN coalesce(step > pitch * 1.6::DOUBLE OR ind > 6.0::DOUBLE OR le, false) THEN 1 ELSE 0 END) OVER (PARTITION BY page_no ORDER BY ord) AS para FROM st JOIN pp USING (page_no))
        SELECT page_no, min(ord) AS para_seq, string_agg(text, ' ' ORDER BY ord) AS text, max(size) AS size, min(x0) AS x0, min(y0) AS y0, count(*) AS n_lines FROM br GROUP BY page_no, para""",
    "hyphen_join": rf"""
        WITH RECURSIVE {LINES}, c AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN rtrim(line) || '-' ELSE line END AS l FROM lines), m AS (SELECT doc_id, max(i) AS last FROM c GROUP BY doc_id),
        r AS (SELECT doc_id, i, l AS t FROM c WHERE i = 0
              UNION ALL SELECT c.doc_id, c.i, CASE WHEN regexp_matches(t, '[a-zA-Zà-ỹÀ-ÖØ-Þ]-$') THEN CASE WHEN regexp_matches(c.l, '^\p{{Ll}}') THEN left(t, length(t) - 1) || c.l ELSE t || c.l END ELSE t || ' ' || c.l END FROM r JOIN c ON c.doc_id = r.doc_id AND c.i = r.i + 1)
        SELECT r.doc_id, r.t AS text FROM r JOIN m ON r.doc_id = m.doc_id AND r.i = m.last""",
    "classify_blocks": rf"""
        WITH {LINES}, t AS (SELECT doc_id, i, i // 10 AS page_no, CASE i % 7 WHEN 1 THEN upper(replace(line, 'ß', 's')) WHEN 2 THEN 'Total ' || doc_id || ' 12 345 6789 01 23' WHEN 3 THEN 'x' || i || ' = + ×' WHEN 4 THEN 'PART ' || i ELSE line END AS text FROM lines),
        p AS (SELECT *, i % 7 IN (1, 4) AS bold, (8 + length(text) % 4)::DOUBLE AS size FROM t),
        z AS (SELECT doc_id, page_no, size, sum(length(text)) AS n, min(i) AS f FROM p GROUP BY ALL),
        b AS (SELECT doc_id, page_no, size AS body FROM z QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, f) = 1),
        x AS (SELECT doc_id, i, bold, size, body, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM p JOIN b USING (doc_id, page_no)),
        y AS (SELECT *, length(s) AS n, length(regexp_replace(s, '[^=+×÷±∓≤≥≠∑∏√∫°′″]', '', 'g')) AS math, length(regexp_replace(s, '\P{{Nd}}', '', 'g')) AS digits, length(regexp_replace(s, '\P{{L}}', '', 'g')) AS letters, length(regexp_replace(s, '\P{{Lu}}', '', 'g')) AS caps FROM x)
        SELECT doc_id, i, CASE WHEN n = 0 THEN 'text' WHEN math >= 0.08::DOUBLE * n THEN 'formula' WHEN digits >= 0.30::DOUBLE * n AND n <= 120 THEN 'table'
            WHEN bold AND n BETWEEN 1 AND 80 AND letters > 0 AND caps >= 0.85::DOUBLE * letters THEN 'heading' WHEN size >= body * 1.15::DOUBLE AND n <= 80 THEN 'heading' WHEN size <= body * 0.85::DOUBLE THEN 'caption' ELSE 'text' END AS kind FROM y""",
    "fragment_merge": f"""
        WITH RECURSIVE src AS (SELECT l_orderkey AS page_no, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS seq, (60 + (l_linenumber // 3) * 14 + l_suppkey % 2)::DOUBLE AS y0, (70 + (l_linenumber // 3) * 14 + l_suppkey % 2)::DOUBLE AS y1,
              ((l_linenumber % 3) * 60 + l_partkey % 25)::DOUBLE AS x0, ((l_linenumber % 3) * 60 + l_partkey % 25 + 40)::DOUBLE AS x1, 0 AS col, (8 + l_partkey % 3)::DOUBLE AS size, 'w' || l_partkey % 1000 AS text FROM lineitem), {ordered_sql('src')},
        q AS (SELECT page_no, ord AS i, x0, y0, x1, y1, text, size FROM ro),
        r AS (SELECT page_no, i, 0 AS seq, x0, y0, x1, y1, text, size FROM q WHERE i = 1
              UNION ALL
              SELECT page_no, i, CASE WHEN fits THEN seq ELSE seq + 1 END, CASE WHEN fits THEN least(x0, bx0) ELSE bx0 END, CASE WHEN fits THEN least(y0, by0) ELSE by0 END, CASE WHEN fits THEN greatest(x1, bx1) ELSE bx1 END,
                     CASE WHEN fits THEN greatest(y1, by1) ELSE by1 END, CASE WHEN fits THEN text || ' ' || bt ELSE bt END, CASE WHEN fits THEN CASE WHEN length(text) >= length(bt) THEN size ELSE bs END ELSE bs END
              FROM (SELECT r.*, q.i AS bi, q.x0 AS bx0, q.y0 AS by0, q.x1 AS bx1, q.y1 AS by1, q.text AS bt, q.size AS bs,
                           least(r.y1 - r.y0, q.y1 - q.y0) > 0 AND least(r.y1, q.y1) - greatest(r.y0, q.y0) > 0.6::DOUBLE * least(r.y1 - r.y0, q.y1 - q.y0) AND q.x0 >= r.x1 - 2 AND q.x0 - r.x1 <= 2.0::DOUBLE * r.size AS fits
                    FROM r JOIN q ON q.page_no = r.page_no AND q.i = r.i + 1) AS s(page_no, oi, seq, x0, y0, x1, y1, text, size, i, bx0, by0, bx1, by1, bt, bs, fits))
        SELECT page_no, seq, arg_max(x0, i) AS x0, arg_max(y0, i) AS y0, arg_max(x1, i) AS x1, arg_max(y1, i) AS y1, arg_max(text, i) AS text, arg_max(size, i) AS size FROM r GROUP BY page_no, seq""",
    "span_merge": """
        WITH s AS (SELECT l_orderkey AS page_no, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS i, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE l_returnflag || '<' || l_partkey % 70 || ' ' END AS text, l_suppkey % 3 AS style, (6 + l_suppkey % 7)::DOUBLE AS size FROM lineitem),
        n AS (SELECT *, CASE WHEN lag(style) OVER w = style THEN 0 ELSE 1 END AS nw FROM s WINDOW w AS (PARTITION BY page_no ORDER BY i)),
        r AS (SELECT *, sum(nw) OVER (PARTITION BY page_no ORDER BY i) AS run FROM n),
        g AS (SELECT page_no, run, style, string_agg(text, '' ORDER BY i) AS raw FROM r GROUP BY ALL),
        h AS (SELECT page_no, run, raw, replace(replace(raw, '&', '&amp;'), '<', '&lt;') AS e, style FROM g),
        d AS (SELECT page_no, run, raw, CASE WHEN trim(e) = '' THEN e WHEN style = 0 THEN '<b>' || e || '</b>' WHEN style = 1 THEN '<b><i>' || e || '</i></b>' ELSE e END AS html FROM h),
        z AS (SELECT page_no, coalesce(max({'n': length(trim(text)), 'size': size}) FILTER (WHERE trim(text) <> '')['size'], 0.0) AS size FROM s GROUP BY page_no)
        SELECT page_no, string_agg(html, '' ORDER BY run) AS html, string_agg(raw, '' ORDER BY run) AS text, any_value(z.size) AS size FROM d JOIN z USING (page_no) GROUP BY page_no""",
    "ocr_rows": """
        WITH q AS (SELECT l_orderkey AS page_no, (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS seq, l_partkey % 200 AS a, l_linenumber * 40 AS b, 10 + l_suppkey % 90 AS w, (l_orderkey % 12) * 2 AS tilt, l_returnflag || '&' || l_partkey % 500 AS t FROM lineitem WHERE l_partkey % 11 <> 0),
        r AS (SELECT page_no, seq, t, a * 0.36::DOUBLE AS x0, b * 0.36::DOUBLE AS y0, (a + w) * 0.36::DOUBLE AS x1, (b + 30) * 0.36::DOUBLE AS y1 FROM q WHERE abs(degrees(atan2(tilt, w))) < 10)
        SELECT page_no, seq, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(0.8::DOUBLE * (y1 - y0), 6) AS size, replace(t, '&', '&amp;') AS html FROM r WHERE NOT (length(t) >= 3 AND y1 - y0 > 1.5::DOUBLE * (x1 - x0))""",
    "figure_noise": """
        WITH l AS (SELECT l_orderkey % 500 AS page_no, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, (l_partkey % 300)::DOUBLE AS x0, (l_suppkey % 500)::DOUBLE AS y0, l_partkey % 4 AS k FROM lineitem),
        f AS (SELECT s_suppkey % 500 AS page_no, (s_nationkey * 4)::DOUBLE AS a, (s_nationkey * 4 + 150)::DOUBLE AS b FROM supplier)
        SELECT page_no, seq, CASE k WHEN 0 THEN 'Figure 3 a map' WHEN 1 THEN 'K Ores' WHEN 2 THEN 'a sentence of plain prose that is long enough to stay' ELSE 'x' END AS text FROM l
        WHERE k IN (0, 2) OR NOT EXISTS (SELECT 1 FROM f WHERE f.page_no = l.page_no AND greatest(0, least(x0 + 60, b) - greatest(x0, a)) * greatest(0, least(y0 + 10, 260) - greatest(y0, 20)) / 600.0 >= 0.5)""",
    "text_kinds": rf"""
        WITH {LINES}, x AS (SELECT doc_id, i, CASE i % 5 WHEN 0 THEN '| Figure ' || i || ' ' || line WHEN 1 THEN i::VARCHAR WHEN 2 THEN 'xii' ELSE line END AS t FROM lines),
        y AS (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS s FROM x),
        z AS (SELECT *, length(regexp_replace(s, '[^\p{{L}} ]', '', 'g')) AS letters_, len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 2)) AS words FROM y)
        SELECT doc_id, i, regexp_matches(t, '(?i)^[^\w\p{{L}}\p{{N}}]*(Figure|Fig\.)\s+\d+') AS caption, regexp_matches(s, '(?i)^(\d{{1,3}}|[ivxlc]{{1,6}})$') AS number,
               length(s) > 0 AND letters_ >= 0.8::DOUBLE * length(s) AND (length(s) >= 25 OR words >= 3) AS prose, regexp_matches(t, '\p{{L}}') AS letters,
               CASE WHEN length(regexp_replace(s, '\s+', ' ', 'g')) > 20 THEN left(regexp_replace(s, '\s+', ' ', 'g'), 19) || '…' ELSE regexp_replace(s, '\s+', ' ', 'g') END AS shown FROM z""",
    "toc_order": """
        WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS entry_id, NULL AS parent_id, r_regionkey AS ord, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, s_name FROM supplier),
        t AS (SELECT entry_id, title, 0 AS depth, [ord] AS path FROM e WHERE parent_id IS NULL UNION ALL SELECT e.entry_id, e.title, t.depth + 1, list_append(t.path, e.ord) FROM e JOIN t ON e.parent_id = t.entry_id)
        SELECT entry_id, title, depth, row_number() OVER (ORDER BY path) - 1 AS place FROM t""",
    "spine_order": """
        WITH m AS (SELECT p_brand AS book_id, 'c' || p_size || '.xhtml' AS name, CASE WHEN p_partkey % 3 = 0 THEN -p_partkey END AS place, p_partkey AS seq FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 13 <> 0),
        f AS (SELECT book_id, name, min({'a': place IS NULL, 'b': coalesce(place, seq)}) AS o FROM m GROUP BY ALL)
        SELECT book_id, name, row_number() OVER (PARTITION BY book_id ORDER BY o) - 1 AS place FROM f""",
    "prev_context": "SELECT conv_id, turn, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '|'), '') AS context FROM conversations",
    "chunk_context": f"""
        WITH {BOOKS}, h AS (SELECT book_id, chunk_id, min(block_id) AS head FROM books GROUP BY ALL)
        SELECT h.book_id, h.chunk_id, x.block_id, x.dst_html, x.age FROM h, LATERAL (SELECT block_id, dst_html, row_number() OVER (ORDER BY block_id DESC) AS age FROM books b WHERE b.book_id = h.book_id AND dst_html IS NOT NULL AND page_no >= 0 AND b.block_id < h.head ORDER BY block_id DESC LIMIT 3) x""",
    "status_rollup": f"WITH {BOOKS} SELECT book_id, count(*) AS blocks, count(dst_html) AS done, sum(length(src_html)) AS chars, coalesce(sum(CASE WHEN dst_html IS NULL THEN length(src_html) END), 0) AS chars_left, count(DISTINCT page_no) AS pages FROM books GROUP BY book_id",
    "chunk_sizes": f"WITH {BOOKS} SELECT book_id, chunk_id, count(*) AS blocks, sum(length(src_html))::BIGINT AS chars FROM books GROUP BY ALL",
    "inspect_totals": f"WITH {BOOKS} SELECT count(*) AS blocks, count(DISTINCT page_no) AS pages, sum(length(src_html))::BIGINT AS chars FROM books",
    "page_headers": f"WITH {LINES}, p AS (SELECT doc_id, i, i // 10 AS page_no FROM lines) SELECT doc_id, page_no + 1 AS page_header, page_no, min(i) AS pos FROM p GROUP BY doc_id, page_no",
    "open_blocks": f"WITH {BOOKS} SELECT book_id, block_id FROM books WHERE dst_html IS NULL AND chunk_id % 3 <> 0",
    "update_targets": f"WITH {BOOKS} SELECT page_no, count(*) FILTER (WHERE block_id % 5 = 0) AS renewed, count(*) FILTER (WHERE block_id % 5 = 0 OR dst_html IS NOT NULL) AS targets, count(*) FILTER (WHERE block_id % 5 <> 0 AND flag IS NOT NULL) AS flags FROM books GROUP BY page_no",
    "page_items": f"""
        WITH {BOOKS}, p AS (SELECT book_id, unnest(range(0, 9)) AS page_no FROM (SELECT DISTINCT book_id FROM books)),
        k AS (SELECT book_id, page_no, count(*) AS items, count(dst_html) AS done FROM books WHERE block_id % 4 <> 0 AND block_id % 7 > 0 GROUP BY ALL)
        SELECT book_id, page_no, coalesce(items, 0) AS items, coalesce(done, 0) AS done FROM p LEFT JOIN k USING (book_id, page_no)""",
    "pages_complete": f"WITH {BOOKS}, p AS (SELECT book_id, chunk_id, bool_and(dst_html IS NOT NULL) AS whole FROM books GROUP BY ALL) SELECT book_id, count(*) FILTER (WHERE whole) AS pages_complete FROM p GROUP BY book_id",
    "chunk_status": "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "model_usage": "SELECT o_orderstatus AS provider, o_orderpriority AS model, count(*) AS n, sum(o_custkey) AS in_tokens, coalesce(sum(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 100 END), 0) AS out_tokens FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2",
    "flag_counts": "SELECT CASE l_returnflag WHEN 'R' THEN 'overflow' ELSE 'too_short' END AS flag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1",
    "cost_estimate": """
        WITH e AS (SELECT event_type, sum(floor(value)::BIGINT) AS i, count(*) AS o, sum(user_id % 7) AS cr, sum(user_id % 3) AS cw FROM events GROUP BY 1), c AS (SELECT *, (i * 3.0::DOUBLE + cr * 0.3::DOUBLE + cw * 3.75::DOUBLE + o * 15.0::DOUBLE) / 1e6 AS cost FROM e)
        SELECT event_type, round(cost, 9) AS cost, CASE WHEN i - cr > 0 AND cr > 0 THEN round(cost * i / (i - cr), 9) END AS whole_cost, round(i / 4.0::DOUBLE, 6) AS rough_tokens FROM c""",
    "json_layout": "SELECT event_type, sum((json_extract_string(props, '$.k'))::BIGINT) AS k, count(json_extract_string(props, '$.k')) AS with_k, max((json_extract_string(props, '$.k'))::BIGINT) AS max_k FROM events GROUP BY 1",
    "snapshot_reset": """
        WITH b AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_orderkey % 100 NOT BETWEEN 10 AND 19) AS targets FROM lineitem GROUP BY 1),
        c AS (SELECT o_orderkey, o_custkey, o_orderkey % 100 BETWEEN 10 AND 19 AND b.k IS NOT NULL AS hit, targets FROM orders LEFT JOIN b ON b.k = o_orderkey)
        SELECT CASE WHEN hit THEN 'pending' ELSE 'done' END AS status, count(*) AS chunks, sum(CASE WHEN hit THEN 0 ELSE o_custkey END) AS in_tokens, sum(2) AS attempts, sum(targets) AS targets FROM c GROUP BY 1""",
    "overflow_flags": f"WITH {BOOKS} SELECT page_no, CASE WHEN block_id % 17 = 0 THEN 'overflow' WHEN page_no BETWEEN 2 AND 4 THEN NULL ELSE flag END AS flag, count(*) AS n FROM books GROUP BY 1, 2",
    "upsert_meta": "WITH o AS (SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY 1) SELECT coalesce(o.key, c_custkey) AS key, coalesce(o.value, c_mktsegment) AS value FROM customer FULL JOIN o ON o.key = c_custkey",
    "seg_parse": "SELECT doc_id, doc_id AS id, 'last' AS body FROM documents UNION ALL SELECT doc_id, doc_id + 1, text FROM documents",
    "pad_text": r"""
        WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, CASE WHEN len(l) < 4 THEN text ELSE text || ' ' || array_to_string(l[1:greatest(1, floor(len(l) * 0.25)::INT)], ' ') END AS text FROM w""",
    "frame_fit": """
        WITH p AS (SELECT p_partkey, (p_size * 6)::DOUBLE AS x0, (p_size * 6 + p_partkey % 250)::DOUBLE AS x1, p_partkey % 3 AS k, p_size / 2.0::DOUBLE AS size FROM part),
        f AS (SELECT *, x1 - x0 AS w, CASE WHEN x1 - x0 < 76.5 THEN (x0 + x1) / 2 - 38.25 ELSE x0 END AS s, greatest(x1 - x0, 76.5) AS width FROM p),
        g AS (SELECT *, least(greatest(s, 22.0), 328.0 - width) AS a, least(x1, 350.0) - greatest(x0, 0.0) AS cw, least(size + 20, 30.0) - greatest(size - 5, 0.0) AS ch FROM f)
        SELECT p_partkey, CASE WHEN w >= 0.6::DOUBLE * 306 THEN 22.0 ELSE round(a, 6) END AS "left", CASE WHEN w >= 0.6::DOUBLE * 306 THEN 328.0 ELSE round(a + width, 6) END AS "right",
               round(CASE k WHEN 0 THEN 9.1 WHEN 1 THEN least(greatest(size, 9.1), 18.2) ELSE least(greatest(size, 0.8::DOUBLE * 9.1), 9.1) END::DOUBLE, 6) AS size,
               w > 0 AND x0 <= 350 AND size - 5 >= 0 AND x0 < 350 AND x1 > 0 AND size - 5 < 30 AND size + 20 > 0 AS usable,
               CASE WHEN cw <= 0 OR ch <= 0 THEN 0.0 ELSE round(cw, 6) END AS clip_width, CASE WHEN cw <= 0 OR ch <= 0 THEN 0.0 ELSE round(ch, 6) END AS clip_height FROM g""",
    "upper_median": "SELECT l_suppkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY 1",
}

_FIT = """
    p AS (SELECT p_partkey, (p_size * 4)::DOUBLE AS n, (p_partkey % 200 + 1)::DOUBLE AS room FROM part),
    f AS (SELECT p_partkey, CASE WHEN n <= room THEN 1 WHEN n * 0.95::DOUBLE <= room THEN 2 WHEN n * 0.85::DOUBLE * 0.85::DOUBLE * 0.95::DOUBLE <= room THEN 3 WHEN n * 0.75::DOUBLE * 0.75::DOUBLE * 0.95::DOUBLE <= room THEN 4 WHEN n * 0.7::DOUBLE * 0.7::DOUBLE * 0.95::DOUBLE <= room THEN 5 ELSE 6 END AS rung FROM p),
    fit AS (SELECT p_partkey, CASE rung WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.85 WHEN 4 THEN 0.75 ELSE 0.7 END::DOUBLE AS ratio, CASE rung WHEN 1 THEN 1.0 ELSE 0.95 END::DOUBLE AS line_height, rung = 6 AS overflow FROM f)
"""
ORACLE["box_fit"] = f"WITH {_FIT} SELECT * FROM fit"
ORACLE["fit_totals"] = f"WITH {_FIT} SELECT count(*) AS items, count(*) FILTER (WHERE overflow) AS overflows, round(coalesce(median(ratio), 1.0), 6) AS median_ratio, round(coalesce(100.0::DOUBLE * count(*) FILTER (WHERE ratio < 0.85) / count(*), 0.0), 6) AS percent_low FROM fit"

#: Two columns: a position runs over the page step by step; the widest run of positions that no narrow line crosses is the gutter.
ORACLE["column_gap"] = """
    WITH RECURSIVE a AS (SELECT l_orderkey // 20 AS page_no, (CASE WHEN (l_orderkey // 20) % 3 = 0 THEN 40 ELSE 40 + (l_linenumber % 2) * 160 END + l_partkey % 5)::DOUBLE AS x0 FROM lineitem),
    l AS (SELECT page_no, x0, x0 + CASE WHEN page_no % 3 = 0 THEN 300 ELSE 130 END AS x1 FROM a),
    m AS (SELECT page_no, count(*) AS lines, sum(x1 - x0) / count(*) AS mean FROM l GROUP BY page_no),
    nr AS (SELECT page_no, x0, x1 FROM l JOIN m USING (page_no) WHERE x1 - x0 < mean * 1.5::DOUBLE AND lines >= 6),
    e AS (SELECT page_no, min(x0) AS lo, max(x1) AS hi FROM nr GROUP BY page_no HAVING count(*) >= 6),
    xs AS (SELECT page_no, lo + 380.0::DOUBLE / 100.0::DOUBLE AS x, hi FROM e UNION ALL SELECT page_no, x + 380.0::DOUBLE / 100.0::DOUBLE, hi FROM xs WHERE x + 380.0::DOUBLE / 100.0::DOUBLE < hi),
    f AS (SELECT page_no, x FROM xs WHERE x < hi AND NOT EXISTS (SELECT 1 FROM nr WHERE nr.page_no = xs.page_no AND nr.x0 < xs.x AND xs.x < nr.x1)),
    g AS (SELECT *, sum(CASE WHEN x - px > 3.8::DOUBLE * 1.5::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY page_no ORDER BY x) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY page_no ORDER BY x) AS px FROM f)),
    h AS (SELECT page_no, run, min(x) AS a, max(x) AS b FROM g GROUP BY ALL),
    w AS (SELECT page_no, (a + b) / 2 AS middle FROM (SELECT *, row_number() OVER (PARTITION BY page_no ORDER BY b - a DESC, run) AS k FROM h) WHERE k = 1 AND b - a >= 380.0::DOUBLE * 0.04::DOUBLE),
    s AS (SELECT page_no, middle, sum(CASE WHEN x0 < middle THEN x1 - x0 ELSE 0 END) AS lw, sum(CASE WHEN x0 >= middle THEN x1 - x0 ELSE 0 END) AS rw FROM nr JOIN w USING (page_no) GROUP BY ALL),
    ok AS (SELECT page_no, middle FROM s WHERE lw + rw > 0 AND least(lw, rw) >= (lw + rw) * 0.10::DOUBLE)
    SELECT l.page_no, count(*) AS lines, count(*) FILTER (WHERE x1 - x0 < mean * 1.5::DOUBLE AND x0 >= middle) AS right_lines FROM l JOIN m USING (page_no) LEFT JOIN ok USING (page_no) GROUP BY l.page_no"""
#: One column: down the page, then up again where the bottom is passed.
ORACLE["vertical_stack"] = """
    WITH RECURSIVE src AS (SELECT l_orderkey AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) AS i, (l_partkey % 480)::DOUBLE AS a, (40 + l_suppkey % 90)::DOUBLE AS h FROM lineitem),
    d AS (SELECT page_no, i, a, h, greatest(a, 22.0::DOUBLE) AS y FROM src WHERE i = 1 UNION ALL SELECT s.page_no, s.i, s.a, s.h, greatest(s.a, 22.0::DOUBLE, d.y + d.h + 4) FROM d JOIN src s ON s.page_no = d.page_no AND s.i = d.i + 1),
    z AS (SELECT page_no, max(i) AS n, max(y + h) <= 525 + 1e-6 AS fits FROM d GROUP BY page_no),
    u AS (SELECT d.page_no, d.i, least(d.y, 525 - d.h) AS y FROM d JOIN z ON z.page_no = d.page_no AND z.n = d.i WHERE NOT fits
          UNION ALL SELECT d.page_no, d.i, least(d.y, 525 - d.h, u.y - 4 - d.h) FROM u JOIN d ON d.page_no = u.page_no AND d.i = u.i - 1),
    v AS (SELECT d.page_no, d.i, d.a, CASE WHEN fits THEN d.y ELSE u.y END AS y FROM d JOIN z USING (page_no) LEFT JOIN u ON u.page_no = d.page_no AND u.i = d.i)
    SELECT page_no, i - 1 AS i, a AS anchor, CASE WHEN min(y) OVER (PARTITION BY page_no) >= 22 - 1e-6 THEN y END AS top FROM v"""

_SEQ = "(l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey"
_GLOSSARY = """
    v AS (SELECT p_partkey AS seq, CASE p_partkey % 6 WHEN 0 THEN '# ' || p_name || ' = x' WHEN 1 THEN ' ' || p_brand || ' = ' || p_name || ' ' WHEN 2 THEN p_name WHEN 3 THEN p_brand || ' =' WHEN 4 THEN p_name || '=' || p_type || '=' || p_size ELSE '' END AS v FROM part),
    g AS (SELECT seq, trim(left(v, strpos(v, '=') - 1)) AS term, trim(substr(v, strpos(v, '=') + 1)) AS translation FROM v WHERE contains(v, '=') AND NOT starts_with(trim(v), '#')),
    d AS (SELECT * FROM g WHERE term <> '' AND translation <> '')
"""
ORACLE |= {
    "running_marks": rf"""
        WITH p AS (SELECT cast(l_suppkey % 5 AS VARCHAR) AS book_id, l_orderkey % 60 AS page_no, {_SEQ} AS para_seq,
                CASE l_partkey % 4 WHEN 0 THEN ' Part ' || l_partkey % 3 || ' PAGE ' || l_orderkey % 60 WHEN 1 THEN repeat('x', 61) ELSE 'note ' || l_returnflag || chr((97 + l_partkey % 26)::INT) || chr((97 + l_orderkey % 26)::INT) END AS text,
                (CASE l_linenumber % 3 WHEN 0 THEN (l_partkey % 13) * (l_suppkey % 4) WHEN 1 THEN 300 ELSE 616 + l_orderkey % 50 END)::DOUBLE AS y0 FROM lineitem),
        e AS (SELECT *, (y0 < 40 OR y0 > 615) AND length(trim(text)) <= 60 AS edge, regexp_replace(lower(trim(text)), '\d+', '#', 'g') AS fp, round_even(y0 / 6.0::DOUBLE, 0) AS slot FROM p),
        k AS (SELECT DISTINCT book_id, fp, page_no FROM e WHERE edge),
        w AS (SELECT book_id, fp, count(*) OVER (PARTITION BY book_id, fp) AS n, count(*) OVER (PARTITION BY book_id, fp ORDER BY page_no RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM k),
        h AS (SELECT book_id, fp FROM w WHERE n >= 4 GROUP BY ALL HAVING max(ahead) >= 6),
        s AS (SELECT book_id, slot FROM e WHERE edge GROUP BY ALL HAVING count(DISTINCT page_no) >= 60 * 0.6::DOUBLE)
        SELECT e.book_id, page_no, para_seq, CASE WHEN edge AND (h.fp IS NOT NULL OR s.slot IS NOT NULL) THEN 'skip' ELSE 'text' END AS kind
        FROM e LEFT JOIN h ON h.book_id = e.book_id AND h.fp = e.fp LEFT JOIN s ON s.book_id = e.book_id AND s.slot = e.slot""",
    "block_rows": f"""
        SELECT l_orderkey AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) - 1 AS pos, CASE l_partkey % 4 WHEN 1 THEN 'h2' ELSE 'p' END AS tag, CASE l_partkey % 4 WHEN 1 THEN 'heading' ELSE 'text' END AS kind, 'h' || l_partkey AS src_html,
               format('{{:.1f}},{{:.1f}},{{:.1f}},{{:.1f}}', l_partkey % 300 / 2.0::DOUBLE, l_suppkey % 500 / 2.0::DOUBLE, (l_partkey % 300 + 90) / 2.0::DOUBLE, (l_suppkey % 500 + 20) / 2.0::DOUBLE) AS bbox,
               format('{{{{"size":{{:.1f}}}}}}', (l_partkey % 20 + 5) / 2.0::DOUBLE) AS layout, nullif(l_linenumber, 1) AS cont_group FROM lineitem WHERE l_partkey % 4 > 0""",
    "book_sizes": """
        SELECT cast(l_suppkey % 20 AS VARCHAR) AS book_id, coalesce(median(CASE WHEN l_linenumber % 3 > 0 AND l_partkey % 7 > 0 AND l_partkey % 13 > 0 THEN (l_partkey % 13)::DOUBLE END), 10.0::DOUBLE) AS body_size FROM lineitem GROUP BY 1""",
    "band_paragraphs": f"""
        WITH src AS (SELECT l_orderkey AS page_no, {_SEQ} AS seq, (l_linenumber * 120 - 110 + (l_partkey % 4) * 5)::DOUBLE AS y0, ((l_suppkey % 3) * 5)::DOUBLE AS x0, 0 AS col, 't' || l_partkey % 100 AS text FROM lineitem), {ordered_sql('src')},
        bd AS (SELECT *, CASE WHEN y0 < 500 * (40.0::DOUBLE / 666.0::DOUBLE) THEN 'top' WHEN y0 > 500 * (615.0::DOUBLE / 666.0::DOUBLE) THEN 'bottom' ELSE 'body' END AS band, y0 - lag(y0) OVER (PARTITION BY page_no ORDER BY ord) AS page_step FROM ro),
        pg AS (SELECT page_no, list_sort(list(page_step) FILTER (WHERE page_step > 0 AND page_step < 60)) AS s FROM bd GROUP BY page_no),
        pp AS (SELECT page_no, CASE WHEN len(s) > 0 THEN s[len(s) // 2 + 1] ELSE 12.0 END AS pitch FROM pg),
        st AS (SELECT bd.*, pitch, y0 - lag(y0) OVER w AS step, x0 - lag(x0) OVER w AS ind FROM bd JOIN pp USING (page_no) WINDOW w AS (PARTITION BY page_no, band ORDER BY ord)),
        br AS (SELECT *, sum(CASE WHEN coalesce(step > pitch * 1.6::DOUBLE OR ind > 6.0::DOUBLE, false) THEN 1 ELSE 0 END) OVER (PARTITION BY page_no, band ORDER BY ord) AS para FROM st)
        SELECT page_no, band, min(ord) AS para_seq, string_agg(text, ' ' ORDER BY ord) AS text, count(*) AS n_lines FROM br GROUP BY page_no, band, para""",
    "page_pitch": f"""
        WITH src AS (SELECT l_orderkey AS page_no, {_SEQ} AS seq, (l_linenumber * 12 + (l_partkey % 40) * 5)::DOUBLE AS y0, (l_partkey % 300)::DOUBLE AS x0, l_suppkey % 2 AS col FROM lineitem), {ordered_sql('src')},
        st AS (SELECT page_no, y0 - lag(y0) OVER (PARTITION BY page_no ORDER BY ord) AS step FROM ro), pg AS (SELECT page_no, list_sort(list(step) FILTER (WHERE step > 0 AND step < 60)) AS s FROM st GROUP BY page_no)
        SELECT page_no, CASE WHEN len(s) > 0 THEN s[len(s) // 2 + 1] ELSE 12.0 END AS pitch FROM pg""",
    "page_lines": """
        WITH s AS (SELECT l_orderkey AS page_no, l_linenumber AS line_no, l_partkey * 100000 + l_suppkey AS i, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 's' || l_partkey || ' ' END AS text, (6 + l_suppkey % 7)::DOUBLE AS size, (l_partkey % 300)::DOUBLE AS x, (l_suppkey % 500)::DOUBLE AS y FROM lineitem
                   WHERE l_partkey % 9 > 0 AND l_suppkey % 10 > 1 AND abs(degrees(atan2(l_partkey % 3, l_suppkey % 10 - 1))) < 10)
        SELECT page_no, line_no, string_agg(text, '' ORDER BY i) AS text, max({'n': length(trim(text)), 'size': size}) FILTER (WHERE trim(text) <> '')['size'] AS size, min(x) AS x0, min(y) AS y0, max(x) + 40 AS x1, max(y) + 10 AS y1 FROM s GROUP BY page_no, line_no HAVING trim(string_agg(text, '')) <> ''""",
    "scanned_pages": """
        WITH i AS (SELECT c_custkey AS page_no, least(c_custkey % 40 + 380, 400) - greatest(c_custkey % 40 - 20, 0) AS w, least(c_nationkey + 640, 666) - greatest(c_nationkey - 12, 0) AS h FROM customer)
        SELECT page_no, bool_or(w > 0 AND h > 0 AND w * h >= 0.9::DOUBLE * 400.0::DOUBLE * 666.0::DOUBLE) AS scanned FROM i GROUP BY page_no""",
    "number_hosts": """
        WITH q AS (SELECT p_partkey AS page_no, p_size, unnest(range(0, 6)) AS r FROM part),
        n AS (SELECT *, 60 + r * 30 + CASE WHEN page_no % 11 = 0 THEN 560 ELSE 0 END AS y, CASE WHEN (page_no + r) % 5 = 0 THEN 9 ELSE 1 END AS d FROM q),
        m AS (SELECT *, y <= 615 AND y + d <= 615 AND d = 1 AS hit FROM n),
        c AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY page_no) >= 3 AS contents FROM m)
        SELECT page_no, 40.0::DOUBLE AS x0, y::DOUBLE AS y0, 80.0::DOUBLE AS x1, (y + 10)::DOUBLE AS y1, 't' || r || 'k0' AS text, false AS end_para FROM c
        UNION ALL SELECT page_no, 120.0::DOUBLE + p_size, y, CASE WHEN hit THEN 370.0::DOUBLE ELSE 160.0::DOUBLE + p_size END, CASE WHEN hit THEN y + 11 ELSE y + 10 END, 't' || r || 'k1' || CASE WHEN hit THEN ' ' || (10 + r) ELSE '' END, hit AND contents FROM c
        UNION ALL SELECT page_no, 330.0::DOUBLE, y + d, 370.0::DOUBLE, y + d + 10, (10 + r)::VARCHAR, false FROM c WHERE NOT hit""",
    "figure_places": f"""
        WITH i AS (SELECT l_orderkey AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SEQ}) AS ord, (l_partkey % 480)::DOUBLE AS y0 FROM lineitem),
        f AS (SELECT o_orderkey AS page_no, o_custkey % 400 + 0.5::DOUBLE AS y0, o_custkey AS figure FROM orders),
        p AS (SELECT f.*, coalesce((SELECT min(ord) FROM i WHERE i.page_no = f.page_no AND i.y0 > f.y0), 1 << 30) - 0.5::DOUBLE AS spot FROM f),
        u AS (SELECT page_no, ord::DOUBLE AS spot, 0 AS is_figure, y0, NULL AS figure FROM i UNION ALL SELECT page_no, spot, 1, y0, figure FROM p)
        SELECT page_no, row_number() OVER (PARTITION BY page_no ORDER BY spot) AS place, is_figure, y0, figure FROM u""",
    "sniffed": """
        SELECT 'f' || o_orderkey AS path, CASE o_orderkey % 7 WHEN 0 THEN 'pdf' WHEN 3 THEN 'epub' END AS format,
               CASE o_orderkey % 7 WHEN 1 THEN 'the format is unknown' WHEN 2 THEN 'the file is empty' WHEN 4 THEN 'the archive is ''text/css'', not a book' WHEN 5 THEN 'the archive has no mimetype' WHEN 6 THEN 'the archive is broken' END AS error FROM orders""",
    "glossary_file": f"WITH {_GLOSSARY} SELECT term, arg_max(translation, seq) AS translation FROM d GROUP BY term",
    "glossary_prompt": f"WITH {_GLOSSARY} SELECT coalesce(string_agg('- ' || term || ' -> ' || translation, chr(10) ORDER BY seq), '(none)') AS glossary FROM d",
    "migrated_blocks": f"""
        WITH {BOOKS} SELECT book_id, block_id, chunk_id % 50 AS page_no, 'text' AS kind, '{{"href":"text/c' || chunk_id % 50 || '.xhtml"}}' AS layout, NULL::VARCHAR AS bbox, src_html, dst_html FROM books""",
    "appended_blocks": """
        WITH o AS (SELECT cast(o_custkey % 20 AS VARCHAR) AS book_id, o_orderkey AS n FROM orders), m AS (SELECT book_id, max(n) AS last FROM o WHERE n % 3 = 0 GROUP BY 1)
        SELECT book_id, n, n AS block_id FROM o WHERE n % 3 = 0
        UNION ALL SELECT o.book_id, n, row_number() OVER (PARTITION BY o.book_id ORDER BY n) + coalesce(last, 0) FROM o LEFT JOIN m ON m.book_id = o.book_id WHERE n % 3 > 0""",
    "settled_answers": """
        WITH a AS (SELECT o_orderkey // 4 AS block_id, o_orderkey % 4 AS attempt, 't' || o_custkey AS dst, o_custkey % 6 AS k, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'missing_number' WHEN 2 THEN 'empty' ELSE 'tag_mismatch' END AS flag FROM orders),
        b AS (SELECT block_id, arg_min({'dst': dst, 'flag': flag}, attempt) FILTER (WHERE k < 2) AS good, arg_max({'dst': dst, 'flag': flag}, attempt) AS latest FROM a GROUP BY 1),
        c AS (SELECT block_id, CASE WHEN good IS NOT NULL THEN good ELSE latest END AS t FROM b)
        SELECT cast(block_id % 20 AS VARCHAR) AS book_id, block_id % 7 AS chunk_id, block_id, t.dst AS dst, t.flag AS flag FROM c WHERE t.flag IS DISTINCT FROM 'empty'""",
    "chunk_outcomes": f"""
        WITH {BOOKS}, l AS (SELECT chunk_id, count(*) FILTER (WHERE dst_html IS NULL) AS n FROM books GROUP BY 1),
        t AS (SELECT event_id // 2 AS chunk_id, count(*) AS tries, arg_max_null(event_type, event_id) AS p, arg_max_null(CASE WHEN event_id % 7 = 0 THEN 'timeout' END, event_id) AS e, arg_max_null(event_id % 5 = 0, event_id) AS cut, coalesce(sum(CASE WHEN event_id % 3 > 0 THEN user_id END), 0) AS i FROM events GROUP BY 1),
        c AS (SELECT o_custkey % 2 AS held, tries, p, e, cut, i, coalesce(l.n, 0) AS n FROM orders LEFT JOIN t ON t.chunk_id = o_orderkey LEFT JOIN l ON l.chunk_id = o_orderkey),
        r AS (SELECT CASE WHEN tries IS NULL THEN 'pending' WHEN n = 0 THEN 'done' ELSE 'failed' END AS status,
                CASE WHEN tries IS NOT NULL AND n > 0 THEN coalesce(e, 'attempt ' || tries || ': ' || n || ' segments missing or wrong' || CASE WHEN cut THEN ' (the answer was cut at the token limit; a smaller chunk size helps)' ELSE '' END) END AS error,
                coalesce(p, 'p') AS provider, CASE WHEN p IS NULL THEN 'm' ELSE 'm2' END AS model, held + coalesce(tries, 0) AS attempts, 10 + coalesce(i, 0) AS i, coalesce(tries, 0) AS k FROM c)
        SELECT status, error, provider, model, attempts, count(*) AS chunks, sum(i)::BIGINT AS in_tokens, sum(1 + 2 * k)::BIGINT AS out_tokens, 0 AS cache_read, sum(k)::BIGINT AS cache_write FROM r GROUP BY ALL""",
    "checked_answers": """
        WITH o AS (SELECT o_orderkey // 5 AS chunk_id, o_orderkey AS block_id, CASE o_orderkey % 8 WHEN 0 THEN '<p>order ' || o_custkey || '</p>' WHEN 2 THEN '<p>none</p>' WHEN 4 THEN '<i>none</i>' ELSE '' END AS dst, CASE o_orderkey % 8 WHEN 2 THEN 'missing_number' WHEN 4 THEN 'tag_mismatch' WHEN 6 THEN 'empty' END AS flag FROM orders WHERE o_orderkey % 2 = 0)
        SELECT chunk_id, block_id, dst, flag, CASE WHEN flag IS NULL THEN 'accept' WHEN flag = 'missing_number' THEN 'advise' ELSE 'retry' END AS action FROM o""",
    "chunks_in_pages": f"WITH {BOOKS} SELECT book_id, chunk_id, 'pending' AS status FROM books WHERE chunk_id % 3 <> 0 GROUP BY ALL HAVING bool_or(page_no BETWEEN 3 AND 4)",
    "reset_preview": f"""
        WITH {BOOKS}, h AS (SELECT chunk_id, count(*) AS n FROM books WHERE page_no BETWEEN 2 AND 3 AND dst_html IS NOT NULL GROUP BY 1)
        SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM h) AS targets, count(*) AS chunks, coalesce(sum(o_custkey), 0)::BIGINT AS in_tokens, coalesce(sum(o_custkey % 10), 0)::BIGINT AS out_tokens FROM orders SEMI JOIN h ON h.chunk_id = o_orderkey""",
    "opening_blocks": r"""
        SELECT page_id, array_to_string(list_sort(regexp_extract_all(lower(html), '<\s*([a-zA-Z][a-zA-Z0-9:_-]*)', 1)), ' ') AS tags, array_to_string(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '\p{Nd}+'), ' ') AS digits FROM pages""",
}
ORACLE["candidate_file"] = f"SELECT '# ' || word || ' =            # ' || n || ' lần' AS value FROM ({ORACLE['glossary_candidates']})"

#: Sums of whole numbers are wider in DuckDB than in Spark.
WHOLE = {
    "html_block_stats": "chars", "html_book_rollup": "blocks chars chunks", "chunk_pack": "chars", "glossary_candidates": "n", "continuation_groups": "cont_group", "reading_order": "row",
    "status_rollup": "chars chars_left", "model_usage": "in_tokens out_tokens", "json_layout": "k", "snapshot_reset": "in_tokens attempts targets",
}
for _name, _columns in WHOLE.items():
    ORACLE[_name] = "SELECT * REPLACE (" + ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in _columns.split()) + f") FROM ({ORACLE[_name]})"

assert layout.SENTENCE_ENDS == (".", "!", "?", "”", "’")
