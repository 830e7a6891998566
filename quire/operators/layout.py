"""Page layout from positioned lines: order, paragraphs, kinds, running heads, continuations.

Lines and paragraphs carry book_id and page_no; ``seq`` is their order of arrival. Rules of one page run in windows of that
page; only running heads and continuations look across the pages of a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Points and shares that the rules compare with.
SAME_ROW = 3.0
MODEL_HEIGHT, TOP_MARGIN, BOTTOM_MARGIN = 666.0, 40.0, 615.0
BREAK_FACTOR, INDENT, DEFAULT_PITCH, PITCH_LIMIT = 1.6, 6.0, 12.0, 60.0
HEADING_FACTOR, HEADING_CHARS, CAPTION_FACTOR = 1.15, 80, 0.85
TABLE_SHARE, TABLE_CHARS, FORMULA_SHARE, DEFAULT_SIZE = 0.30, 120, 0.08, 10.0
MATH_CHARS = "=+×÷±∓≤≥≠∑∏√∫°′″"
LEAST_PAGES, WINDOW_PAGES, WINDOW_SHARE, LEAST_REPEATS = 4, 10, 0.6, 4
SLOT_SHARE, SLOT_HEIGHT, RUNNING_CHARS = 0.6, 6.0, 60
SENTENCE_ENDS = (".", "!", "?", "”", "’")
FRAGMENT_GAP, FRAGMENT_OVERLAP = 2.0, 0.6
HYPHEN_END = r"(?iu)[a-zà-ỹ]-$"

PAGE = ["book_id", "page_no"]


def band(y0: Column, height: Column | float = MODEL_HEIGHT) -> Column:
    """top, body or bottom of a page, by where a line begins."""
    h = height if isinstance(height, Column) else F.lit(float(height))
    return F.when(y0 < h * (TOP_MARGIN / MODEL_HEIGHT), "top").when(y0 > h * (BOTTOM_MARGIN / MODEL_HEIGHT), "bottom").otherwise("body")


def near_horizontal(dx: Column, dy: Column, limit: float = 10.0) -> Column:
    return (dx > 0) & (F.abs(F.degrees(F.atan2(dy, dx))) < limit)


def merge_spans(spans: DataFrame) -> DataFrame:
    """(book_id, page_no, line_no, html, text, size): neighbouring spans of one style share an element, blank runs have none,
    italics stand inside bold; the size is that of the longest span by its stripped text, the larger one of equals. Spans with
    boxes (x0..y1) give lines with theirs."""
    box = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max} if "x0" in spans.columns else {}
    around = [f(c).alias(c) for c, f in box.items()]
    line = [*PAGE, "line_no"]
    w = Window.partitionBy(*line).orderBy("span_no")
    style = F.struct(X.is_bold(F.col("font")).alias("b"), X.is_italic(F.col("font")).alias("i"))
    s = spans.where(F.length("text") > 0).withColumn("style", style)
    s = s.withColumn("new", F.coalesce((F.lag("style").over(w) != F.col("style")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), c)
    weight = F.when(X.strip(F.col("text")) != "", F.struct(F.length(X.strip(F.col("text"))).alias("n"), F.coalesce("size", F.lit(0.0)).alias("size")))
    runs = s.withColumn("w", weight).groupBy(*line, "run", "style").agg(joined("").alias("raw"), F.max("w").alias("w"), *around)
    esc = X.escape_html(F.col("raw"))
    italic = F.when(F.col("style.i"), F.concat(F.lit("<i>"), esc, F.lit("</i>"))).otherwise(esc)
    dressed = F.when(X.strip(esc) == "", esc).when(F.col("style.b"), F.concat(F.lit("<b>"), italic, F.lit("</b>"))).otherwise(italic)
    in_order = lambda name: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", F.col(name).alias("v")))), lambda x: x["v"]), "")
    return runs.withColumn("html", dressed).groupBy(*line).agg(in_order("html").alias("html"), in_order("raw").alias("text"), F.coalesce(F.max("w")["size"], F.lit(0.0)).alias("size"), *around)


def reading_order(lines: DataFrame) -> DataFrame:
    """``lines`` with row and ord: by column, then rows (a gap of more than 3 points to the line before begins one), then x."""
    col = Window.partitionBy(*PAGE, "col").orderBy("y0", "x0", "seq")
    gap = F.col("y0") - F.lag("y0").over(col)
    rows = lines.withColumn("_new", F.coalesce((gap > F.lit(SAME_ROW)).cast("int"), F.lit(0))).withColumn("row", F.sum("_new").over(col))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy("col", "row", "x0", "y0", "seq"))).drop("_new")


def with_pitch(ordered: DataFrame) -> DataFrame:
    """``ordered`` with pitch: the upper median of the steps between neighbouring lines of a page, 12 points without any. Windows of a
    page only: nothing is joined, so what the lines come from is worked out once."""
    page = Window.partitionBy(*PAGE)
    told = ordered.withColumn("_s", F.col("y0") - F.lag("y0").over(page.orderBy("ord")))
    steps = F.collect_list(F.when((F.col("_s") > 0) & (F.col("_s") < PITCH_LIMIT), F.col("_s"))).over(page)
    return told.withColumn("pitch", upper_median(F.sort_array(steps), DEFAULT_PITCH)).drop("_s")


def upper_median(sorted_values: Column, default: float) -> Column:
    """The element at place n // 2 of a sorted array."""
    n = F.size(sorted_values)
    return F.when(n > 0, F.element_at(sorted_values, F.floor(n / 2).cast("int") + 1)).otherwise(F.lit(default))


def paragraph_numbers(ordered: DataFrame, part: str | None = None) -> DataFrame:
    """``ordered`` with para: a new one after a large step, an indent, or a line marked as a paragraph's end.

    ``part`` names a column (a band) whose lines are grouped apart, with the pitch of the whole page.
    """
    keys = [*PAGE, *([part] if part else [])]
    w = Window.partitionBy(*keys).orderBy("ord")
    lines = with_pitch(ordered)
    far = F.col("y0") - F.lag("y0").over(w) > F.col("pitch") * BREAK_FACTOR
    indent = F.col("x0") - F.lag("x0").over(w) > INDENT
    ended = F.lag("end_para").over(w)
    lines = lines.withColumn("_b", F.coalesce((far | indent | F.coalesce(ended, F.lit(False))).cast("int"), F.lit(0)))
    return lines.withColumn("para", F.sum("_b").over(w)).drop("_b", "pitch")


def join_text(parts: Column) -> Column:
    """Lines of a paragraph (an array in order) as one text: a typesetter's hyphen goes where the next line begins with a
    small letter; another hyphen stays without a space; else a space parts them."""
    step = lambda t, l: (
        F.when(t.rlike(HYPHEN_END), F.when(l.rlike(r"^\p{Ll}"), F.concat(F.left(t, F.length(t) - 1), l)).otherwise(F.concat(t, l))).otherwise(F.concat(t, F.lit(" "), l))
    )
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, 1), step)


def join_html(parts: Column) -> Column:
    """The same for array<struct<text, html>>; a hyphen that goes may stand before closing tags."""
    first = F.element_at(parts, 1)
    start = F.struct(first["text"].alias("text"), first["html"].alias("html"))

    def step(a: Column, l: Column) -> Column:
        hyphen, small = a["text"].rlike(HYPHEN_END), l["text"].rlike(r"^\p{Ll}")
        text = F.when(hyphen & small, F.concat(F.left(a["text"], F.length(a["text"]) - 1), l["text"])).when(hyphen, F.concat(a["text"], l["text"])).otherwise(F.concat(a["text"], F.lit(" "), l["text"]))
        cut = F.regexp_replace(a["html"], r"-(\s*(?:</[a-zA-Z]+>)*)$", "$1")
        html = F.when(hyphen & small, F.concat(cut, l["html"])).when(hyphen, F.concat(a["html"], l["html"])).otherwise(F.concat(a["html"], F.lit(" "), l["html"]))
        return F.struct(text.alias("text"), html.alias("html"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)


def paragraphs(numbered: DataFrame, part: str | None = None) -> DataFrame:
    """One row per paragraph: joined text and html, largest size, union of the boxes, how many lines, and its order."""
    keys = [*PAGE, *([part] if part else []), "para"]
    lines = F.sort_array(F.collect_list(F.struct("ord", "text", "html")))
    grouped = numbered.groupBy(*keys).agg(
        F.min("ord").alias("para_seq"), lines.alias("l"), F.max("size").alias("size"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").cast("int").alias("n_lines")
    )
    joined = grouped.withColumn("j", join_html(F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["html"].alias("html")))))
    return joined.select(*PAGE, *([part] if part else []), "para_seq", F.col("j.text").alias("text"), F.col("j.html").alias("html"), "size", "x0", "y0", "x1", "y1", "n_lines")


def with_body_size(paras: DataFrame) -> DataFrame:
    """``paras`` with body_size: the size with most characters on its page; the one seen first of equals."""
    same = Window.partitionBy(*PAGE, "size")
    told = paras.withColumn("_n", F.struct(F.sum(F.length("text")).over(same).alias("n"), (-F.min("para_seq").over(same)).alias("first"), F.col("size").alias("size")))
    return told.withColumn("body_size", F.max("_n").over(Window.partitionBy(*PAGE))["size"]).drop("_n")


def kind(text: Column, html: Column, size: Column, body: Column) -> Column:
    """formula, table, heading, caption or text; the first rule that holds."""
    t = X.strip(text)
    n = F.length(t)
    digits, math = F.regexp_count(t, F.lit(r"(?U)\d")), F.regexp_count(t, F.lit(f"[{MATH_CHARS}]"))  # few matches: cheaper than cutting the rest
    out = F.when(n == 0, "text").when(math >= F.lit(FORMULA_SHARE) * n, "formula").when((digits >= F.lit(TABLE_SHARE) * n) & (n <= TABLE_CHARS), "table")
    out = out.when(X.is_bold_heading(html, text), "heading").when((size >= body * F.lit(HEADING_FACTOR)) & (n <= HEADING_CHARS), "heading")
    return out.when(size <= body * F.lit(CAPTION_FACTOR), "caption").otherwise("text")


def classify(paras: DataFrame) -> DataFrame:
    return with_body_size(paras).withColumn("kind", kind(F.col("text"), F.col("html"), F.col("size"), F.col("body_size"))).drop("body_size")


def fingerprint(text: Column) -> Column:
    return F.regexp_replace(F.lower(X.strip(text)), r"(?U)\d+", "#")


def repeating(pages: DataFrame, keys: list[str], window: int = WINDOW_PAGES, least: int | None = None) -> DataFrame:
    """Keys (of distinct rows with page_no) found on 4 pages or more, and on ``least`` of some ``window`` pages in a row."""
    least = max(LEAST_REPEATS, int(window * WINDOW_SHARE)) if least is None else least
    distinct = pages.select(*keys, "page_no").distinct()
    w = Window.partitionBy(*keys).orderBy("page_no")
    seen = distinct.withColumn("ahead", F.count("*").over(w.rangeBetween(0, window - 1)))
    return seen.groupBy(*keys).agg(F.count("*").alias("pages"), F.max("ahead").alias("most")).where((F.col("pages") >= LEAST_REPEATS) & (F.col("most") >= least)).select(*keys)


def mark_running(paras: DataFrame, pages: DataFrame) -> DataFrame:
    """``paras`` with kind skip for running heads and feet. ``pages``: (book_id, n_pages, page_height).

    Only short paragraphs outside the body count: those whose text, digits aside, repeats in a window of pages, and those in a
    slot of 6 points that is taken on most pages. Books of fewer than four pages have none.
    """
    told = paras.join(pages, "book_id", "left")
    edge = (band(F.col("y0"), F.col("page_height")) != "body") & (F.length(X.strip(F.col("text"))) <= RUNNING_CHARS) & (F.col("n_pages") >= LEAST_PAGES)
    told = told.withColumn("_edge", F.coalesce(edge, F.lit(False)))
    of_edge = lambda c: F.when(F.col("_edge"), c)
    told = told.withColumn("_fp", of_edge(fingerprint(F.col("text")))).withColumn("_slot", of_edge(F.bround(F.col("y0") / SLOT_HEIGHT).cast("long"))).withColumn("_page", of_edge(F.col("page_no")))
    apart = F.when(~F.col("_edge"), F.col("page_no"))  # what isn't marginal stays with its page instead of meeting in one task
    text, slot = (Window.partitionBy("book_id", c, apart) for c in ("_fp", "_slot"))
    found = lambda w: F.size(F.collect_set("_page").over(w))  # noqa: E731  pages, at most those of a book
    ahead = found(text.orderBy("page_no").rangeBetween(0, WINDOW_PAGES - 1))
    told = told.withColumn("_pages", found(text)).withColumn("_ahead", ahead).withColumn("_most", F.max("_ahead").over(text))
    head = (F.col("_pages") >= LEAST_REPEATS) & (F.col("_most") >= max(LEAST_REPEATS, int(WINDOW_PAGES * WINDOW_SHARE)))
    told = told.withColumn("_head", head).withColumn("_taken", found(slot) >= F.col("n_pages") * F.lit(SLOT_SHARE))
    return told.withColumn("kind", F.when(F.col("_edge") & (F.col("_head") | F.col("_taken")), "skip").otherwise(F.col("kind"))).select(*paras.columns)


def link_continuations(paras: DataFrame, order: list[str], keys: list[str] | None = None, page: str = "page_no", text: str = "text", takes: Column | None = None) -> DataFrame:
    """``paras`` with cont_group: numbers of runs in which each goes on, on a later page, where the one before has no sentence end;
    null for the others. ``takes`` tells which rows count; the others are passed over and have none."""
    takes = F.lit(True) if takes is None else takes
    w = Window.partitionBy(*(keys or ["book_id"]), takes).orderBy(*order)
    t, nxt = F.regexp_replace(F.col(text), r"(?U)\s+$", ""), X.strip(F.lead(text).over(w))
    goes = takes & (F.lead(page).over(w) > F.col(page)) & (t != "") & (nxt != "") & ~F.right(t, F.lit(1)).isin(*SENTENCE_ENDS)
    linked = paras.withColumn("_on", F.coalesce(goes, F.lit(False))).withColumn("_from", F.coalesce(F.lag("_on").over(w), F.lit(False)))
    begun = F.sum((F.col("_on") & ~F.col("_from")).cast("int")).over(w)
    return linked.withColumn("cont_group", F.when(F.col("_on") | F.col("_from"), begun).cast("int")).drop("_on", "_from")


def same_row(a: Column, b: Column) -> Column:
    """Boxes that share more than 0.6 of the lower one's height."""
    low = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return (low > 0) & (F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]) > F.lit(FRAGMENT_OVERLAP) * low)


def merge_pair(a: Column, b: Column) -> Column:
    """One line of two: the box of both, texts and html with one space, the size of the longer text."""
    rt = lambda c: F.regexp_replace(c, r"(?U)\s+$", "")
    lt = lambda c: F.regexp_replace(c, r"(?U)^\s+", "")
    return F.struct(
        a["col"].alias("col"), F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"),
        F.concat(rt(a["html"]), F.lit(" "), lt(b["html"])).alias("html"), F.concat(rt(a["text"]), F.lit(" "), lt(b["text"])).alias("text"),
        F.when(F.length(a["text"]) >= F.length(b["text"]), a["size"]).otherwise(b["size"]).alias("size"),
    )


def merge_fragments(lines: DataFrame, height: Column | float = MODEL_HEIGHT, gap: float = FRAGMENT_GAP) -> DataFrame:
    """Lines whose pieces in one row are put together: same column, both in the body, the next to the right of what has been
    merged so far by no more than ``gap`` times its size. A fold over each page's lines in reading order."""
    top = (height if isinstance(height, Column) else F.lit(float(height))) * (TOP_MARGIN / MODEL_HEIGHT)
    bottom = (height if isinstance(height, Column) else F.lit(float(height))) * (BOTTOM_MARGIN / MODEL_HEIGHT)
    fields = ["col", "x0", "y0", "x1", "y1", "html", "text", "size"]
    ordered = reading_order(lines)
    page = ordered.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("v")))).alias("l"), top.alias("t") if not isinstance(height, Column) else F.first(top).alias("t"), bottom.alias("b") if not isinstance(height, Column) else F.first(bottom).alias("b"))
    values = F.transform("l", lambda x: x["v"])

    def step(out: Column, l: Column) -> Column:
        last = F.element_at(out, -1)
        fits = (last["col"] == l["col"]) & last["y0"].between(F.col("t"), F.col("b")) & l["y0"].between(F.col("t"), F.col("b")) & same_row(last, l)
        fits = fits & (l["x0"] >= last["x1"] - 2) & (l["x0"] - last["x1"] <= F.lit(gap) * last["size"])
        return F.when(fits, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(merge_pair(last, l)))).otherwise(F.concat(out, F.array(l)))

    merged = F.aggregate(F.slice(values, 2, F.size(values)), F.slice(values, 1, 1), step)
    return page.select(*PAGE, F.posexplode(merged).alias("seq", "v")).select(*PAGE, "seq", "v.*")


def column_body_size(blocks: DataFrame) -> DataFrame:
    """(book_id, body_size): the median of the sizes of text blocks that have one; 10 without any."""
    size = F.get_json_object("layout", "$.size").cast("double")
    return blocks.groupBy("book_id").agg(F.coalesce(F.median(F.when((F.col("kind") == "text") & (size != 0), size)), F.lit(DEFAULT_SIZE)).alias("body_size"))


def to_blocks(paras: DataFrame) -> DataFrame:
    """Block rows of paragraphs that aren't skipped: a dense position on each page, h2 for headings, rounded layout."""
    w = Window.partitionBy(*PAGE).orderBy("para_seq")
    kept = paras.where("kind <> 'skip'").withColumn("pos", F.row_number().over(w) - 1)
    return kept.select(
        "book_id", "page_no", "pos", F.when(F.col("kind") == "heading", "h2").otherwise("p").alias("tag"), "kind", F.col("html").alias("src_html"),
        F.concat_ws(",", *(F.format_string("%.1f", c) for c in ("x0", "y0", "x1", "y1"))).alias("bbox"), F.to_json(F.struct(F.round("size", 1).alias("size"))).alias("layout"), "cont_group",
    )
