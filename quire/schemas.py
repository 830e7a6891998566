"""Tables of the document engine. ``book_id`` keeps books apart and is the unit of every ordered rule."""

from __future__ import annotations

BOX = "x0 double, y0 double, x1 double, y1 double"
BLOCKS_DDL = (
    "book_id string, block_id bigint, page_no int, pos int, tag string, kind string, src_html string, dst_html string, "
    f"bbox struct<{BOX.replace(' double', ': double')}>, line_bboxes array<struct<{BOX.replace(' double', ': double')}>>, layout string, cont_group int, chunk_id bigint, flag string"
)
CHUNKS_DDL = "book_id string, chunk_id bigint, status string, attempts int, error string, provider string, model string, in_tokens bigint, out_tokens bigint, cache_read bigint, cache_write bigint"
META_DDL = "book_id string, key string, value string"
SPANS_DDL = "book_id string, page_no int, line_no int, span_no int, text string, font string, size double"
LINES_DDL = f"book_id string, page_no int, seq int, {BOX}, html string, text string, size double, col int, end_para boolean"
PARAS_DDL = f"book_id string, page_no int, para_seq int, text string, html string, size double, {BOX}, kind string, cont_group int, n_lines int"
FIGURES_DDL = f"book_id string, page_no int, {BOX}"

#: Values of the enumerated columns.
KINDS = ("text", "heading", "caption", "table", "formula", "skip")
FLAGS = ("empty", "tag_mismatch", "too_short", "missing_number", "missing_term", "overflow")
STATUSES = ("pending", "done", "failed")
TOC_PAGE, TITLE_PAGE = -1, -2
SCHEMA_VERSION = 2
