"""Cases with known results for the operators: tiny tables, one rule at a time."""

import base64
import io
import sys
import zipfile
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire import providers, sinks, sources, translate
from quire.functions import text as X
from quire.operators import chunking, context, geometry, glossary, layout, packing, quality, state, status
from quire.sources import epub, html, pdf, pdffile


def lines(spark, rows, **extra):
    """rows: (page, x0, y0[, x1, col, text, end])."""
    out = []
    for i, r in enumerate(rows):
        page, x0, y0, x1, col, text, end = (*r, *(400.0, 0, f"line {i}", False)[len(r) - 3 :]) if len(r) < 7 else r
        out.append(("b", page, i, float(x0), float(y0), float(x1), float(y0) + 10, text, text, extra.get("size", 10.0), col, end))
    return spark.createDataFrame(out, "book_id string, page_no int, seq int, x0 double, y0 double, x1 double, y1 double, html string, text string, size double, col int, end_para boolean")


# ---- chunks


@pytest.mark.parametrize(
    "blocks, limit, sizes",
    [
        ([(0, 40), (0, 40), (0, 40)], 100, [2, 1]), ([(0, 10), (-1, 10), (-2, 10)], 1000, [1, 1, 1]), ([(0, 60), (1, 10)], 100, [1, 1]),
        ([(0, 10), (1, 10)], 100, [2]), ([(0, 500), (0, 10)], 100, [1, 1]), ([], 100, []),
    ],
)
def test_assign(blocks, limit, sizes):
    got = chunking.assign([n for _, n in blocks], [p for p, _ in blocks], limit)
    assert [got.count(c) for c in sorted(set(got))] == sizes


def test_pack_by_book(spark):
    b = spark.createDataFrame([(k, i, 0, "x" * 40) for k in "ab" for i in range(3)], "book_id string, block_id long, page_no int, src_html string")
    got = chunking.pack(b, 100).orderBy("book_id", "block_id").collect()
    assert [r.chunk_no for r in got] == [0, 0, 1, 0, 0, 1]


@pytest.mark.parametrize(
    "pages, span, ids, cover",
    [
        ({1: [0, 1], 2: [2, 3], 3: [8, 9]}, (0, 3), [1, 2], (0, 3)), ({1: [0, 1], 2: [1, 2, 3], 3: [3, 4, 5]}, (0, 3), [1, 2, 3], (0, 5)),
        ({1: [0, 1], 2: [2, 3]}, (50, 60), [], None), ({1: [-2], 2: [-1], 3: [0, 1]}, (0, 1), [3], (0, 1)), ({9: [0], 3: [1], 7: [2]}, (0, 2), [3, 7, 9], (0, 2)),
    ],
)
def test_touching(spark, pages, span, ids, cover):
    b = spark.createDataFrame([("b", c, p) for c, v in pages.items() for p in v], "book_id string, chunk_id int, page_no int")
    got = chunking.touching(b, *span)
    assert sorted(r.chunk_id for r in got.collect()) == ids
    c = chunking.coverage(got).first()
    assert (c and (c.from_page, c.to_page)) == cover


def test_page_range(spark):
    assert chunking.page_range("10-20") == (9, 19) and chunking.page_range("10") == (9, 9) and chunking.page_range(None) is None
    for bad in ("0", "a-b", "3-x", "0-4"):
        with pytest.raises(ValueError):
            chunking.page_range(bad)
    b = spark.createDataFrame([("b", 0), ("b", 4)], "book_id string, page_no int")
    chunking.check_range(b, 0, 9)
    with pytest.raises(ValueError, match="reversed"):
        chunking.check_range(b, 3, 1)
    with pytest.raises(ValueError, match="outside"):
        chunking.check_range(b, 5, 6)


# ---- quality and glossary

PAIRS = [
    ("A normal sentence here.", "Một câu bình thường ở đây.", None, None), ("He was born in 1914 exactly.", "Ông sinh ra vào năm đó.", None, "missing_number"),
    ("From 1914 to 1918 and back.", "Từ 1914 trở đi.", None, "missing_number"), ('<span class="p2">Xin chao</span>', "<span>Xin chào</span>", None, None),
    ("Mars is bright tonight.", "Hành tinh đỏ sáng tối nay.", ("Mars", "Sao Hoa"), "missing_term"), ("It was Sunday morning.", "Đó là sáng chủ nhật.", ("Sun", "Mặt Trời"), None),
    ("Neptune's moon Triton is a KBO.", "Triton, vệ tinh của Hải Vương Tinh, là một KBO.", ("Moon", "Mặt Trăng"), None),
    ("Her Natal Chart shows this.", "Điều này hiện ra rõ ràng.", ("natal chart", "bản đồ sao"), "missing_term"), ("<em>hi</em>", "", None, "empty"), ("<em>hi there</em>", "chào", None, "tag_mismatch"),
    ("Aquarius 42 Aquinas, Thomas 19 Ara 7", "Aquarius 42 Aquinas, Thomas 19 Ara 7", ("Aquarius", "Bảo Bình"), None), ("x" * 100, "y" * 39, None, "too_short"), ("x" * 100, "y" * 40, None, None),
]


def test_quality_rules(spark):
    for i, (src, dst, term, want) in enumerate(PAIRS):
        p = spark.createDataFrame([(i, src, dst)], "id int, src string, dst string")
        g = term and spark.createDataFrame([term], "term string, translation string")
        r = quality.check(p, g).first()
        assert r.flag == want, (src, dst)
        assert r.action == ("accept" if want is None else "advise" if want in quality.ADVISORY else "retry")


@pytest.mark.parametrize(
    "texts, has, lacks",
    [
        (["Sao Mars va Venus", "Mars lai xuat hien", "x Mars lan nua"], {"Mars": 3, "Venus": 1}, []), (["x Aaa y Bbb", "x Aaa y", "x Aaa y", "x Bbb y"], {"Aaa": 3, "Bbb": 2}, []),
        (["The Mars is here", "The Mars again", "This Mars too"], {"Mars": 3}, ["The", "This"]), (["Nothing happens. Nothing again. Nothing more."], {}, ["Nothing"]), (["x Ab Cd Mars"], {"Mars": 1}, ["Ab", "Cd"]),
    ],
)
def test_candidates(spark, texts, has, lacks):
    got = {r.word: r.n for r in glossary.candidates(spark.createDataFrame([(t,) for t in texts], "src_html string")).collect()}
    assert {k: got.get(k) for k in has} == has and not set(lacks) & set(got)


def test_glossary_file(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# note\nMars = Sao Hỏa\nbroken\n = x\nMars=Sao Hoả = đỏ\nVenus =\n", encoding="utf-8")
    assert {(r.term, r.translation) for r in glossary.read(spark, str(tmp_path / "g.txt")).collect()} == {("Mars", "Sao Hoả = đỏ")}
    rows = spark.createDataFrame(enumerate(["# c", "a = b", "a = c"]), "seq int, value string")
    assert glossary.prompt_text(rows).first()[0] == "- a -> b\n- a -> c"
    assert glossary.prompt_text(rows.limit(1)).first()[0] == "(none)"
    assert glossary.candidate_lines(spark.createDataFrame([("Mars", 3)], "word string, n int")).first()[0].startswith("# Mars =")


# ---- layout


def paras(spark, rows, **kw):
    return layout.paragraphs(layout.paragraph_numbers(layout.reading_order(lines(spark, rows, **kw)))).orderBy("page_no", "para_seq").collect()


@pytest.mark.parametrize(
    "rows, sizes",
    [
        ([(0, 67, y) for y in (100, 112, 124)], [3]), ([(0, 67, y) for y in (100, 112, 142, 154)], [2, 2]), ([(0, 67, 100), (0, 67, 112), (0, 85, 124)], [2, 1]), ([(0, 67, 100), (1, 67, 112)], [1, 1]),
        ([(0, 67, 100, 400, 0, "a", False), (0, 67, 112, 400, 0, "b", True), (0, 67, 124, 400, 0, "c", True)], [2, 1]),
    ],
)
def test_paragraphs(spark, rows, sizes):
    assert [r.n_lines for r in paras(spark, rows)] == sizes


@pytest.mark.parametrize("parts, want", [(["about as-", "trology day"], "about astrology day"), (["Anh-", "Viet nhe"], "Anh-Viet nhe"), (["cau truoc", "cau sau"], "cau truoc cau sau"), (["one"], "one")])
def test_join(spark, parts, want):
    df = spark.createDataFrame([(parts, [(p, f"<i>{p}</i>") for p in parts])], "t array<string>, h array<struct<text string, html string>>")
    r = df.select(layout.join_text(F.col("t")).alias("t"), layout.join_html(F.col("h")).alias("h")).first()
    assert r.t == want and r.h.text == want
    if want.startswith("about"):
        assert r.h.html == "<i>about as</i><i>trology day</i>"


@pytest.mark.parametrize(
    "b, size, n",
    [((208, 0), 10.0, 1), ((221, 0), 10.0, 2), ((208, 1), 10.0, 2), ((230, 0), 20.0, 1), ((150, 0), 10.0, 2)],
)
def test_merge_fragments(spark, b, size, n):
    got = layout.merge_fragments(lines(spark, [(0, 67, 100, 200, 0, "one", False), (0, b[0], 100, 230 if b[0] < 230 else 250, b[1], "two", False)], size=size)).collect()
    assert len(got) == n
    if n == 1 and size == 10.0:
        assert (got[0].x0, got[0].y0, got[0].x1, got[0].y1, got[0].text) == (67, 100, 230, 110, "one two")


def test_merge_spans(spark):
    s = [("Alma", "Times-Italic", 10.0), ("gest", "Times-Italic", 10.0), (" ", "Times", 10.0), ("A", "Times-Bold", 24.0), (" & more text", "Times", 9.0)]
    df = spark.createDataFrame([("b", 0, 0, i, *x) for i, x in enumerate(s)], "book_id string, page_no int, line_no int, span_no int, text string, font string, size double")
    r = layout.merge_spans(df).first()
    assert r.html == "<i>Almagest</i> <b>A</b> &amp; more text" and r.text == "Almagest A & more text" and r.size == 9.0


def running(spark, rows, n_pages):
    p = spark.createDataFrame([("b", pg, i, t, t, 10.0, 0.0, y, 400.0, y + 10, "text", None, 1) for i, (pg, y, t) in enumerate(rows)], "book_id string, page_no int, para_seq int, text string, html string, size double, x0 double, y0 double, x1 double, y1 double, kind string, cont_group int, n_lines int")
    return layout.mark_running(p, spark.createDataFrame([("b", n_pages, 666.0)], "book_id string, n_pages int, page_height double")).orderBy("para_seq").collect()


def test_running_heads(spark):
    assert {r.kind for r in running(spark, [(p, 20.0 + p, "Chapter one") for p in range(10)], 10)} == {"skip"}
    assert {r.kind for r in running(spark, [(p, 620.0, str(100 + p)) for p in range(10)], 10)} == {"skip"}
    assert {r.kind for r in running(spark, [(p, 300.0, "same words") for p in range(10)], 10)} == {"text"}
    assert {r.kind for r in running(spark, [(p, 20.0, "same words") for p in range(2)], 2)} == {"text"}
    assert {r.kind for r in running(spark, [(p, 571.0, f"line {'abcdefghij'[p] * 20}") for p in range(10)], 10)} == {"text"}


def test_classify(spark):
    rows = [(0, "A heading", 13.6), (0, "long " * 30, 13.6), (0, "body text " * 40, 10.0), (0, "small note", 8.2), (0, "12 34 56 78 90", 10.0), (0, "x = (a + b) / c × d ÷ e ± f", 10.0), (1, "all small text here", 8.0), (1, "and more of it", 8.0), (1, "Title", 11.0)]
    df = spark.createDataFrame([("b", p, i, t, t, s) for i, (p, t, s) in enumerate(rows)], "book_id string, page_no int, para_seq int, text string, html string, size double")
    got = [r.kind for r in layout.classify(df).orderBy("para_seq").collect()]
    assert got == ["heading", "text", "text", "caption", "table", "formula", "text", "text", "heading"]


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, "goes on"), (1, "here")], [1, 1]), ([(0, "ends."), (1, "here")], [None, None]), ([(0, "goes on"), (1, "Upper")], [1, 1]), ([(0, "a"), (1, "b"), (2, "c.")], [1, 1, 1]),
        ([(0, "a"), (0, "b")], [None, None]), ([(0, "last")], [None]), ([(0, "a"), (1, "b."), (1, "c"), (2, "d")], [1, 1, 2, 2]),
    ],
)
def test_continuations(spark, rows, want):
    df = spark.createDataFrame([("b", p, i, t) for i, (p, t) in enumerate(rows)], "book_id string, page_no int, i int, text string")
    assert [r.cont_group for r in layout.link_continuations(df, ["i"]).orderBy("i").collect()] == want


# ---- geometry


def test_columns():
    two = [(40 + 160 * (i % 2), 50 + 12 * i, 150 + 160 * (i % 2), 60 + 12 * i) for i in range(12)]
    import numpy as np

    assert geometry.columns(np.array(two, float), 380.0).tolist() == [i % 2 for i in range(12)]
    assert not geometry.columns(np.array([(40, 50 + 12 * i, 340, 60 + 12 * i) for i in range(12)], float), 380.0).any()
    assert not geometry.columns(np.array(two[:5], float), 380.0).any()


def test_scan_gutter():
    rows = [b for i in range(15) for b in ((30, 50 + 14 * i, 150, 60 + 14 * i), (162, 50 + 14 * i, 300, 60 + 14 * i))]
    cross = [(120, 300 + 14 * i, 200, 310 + 14 * i) for i in range(5)]
    assert 150 <= geometry.scan_gutter(rows + cross[:1], 350, 548) <= 162
    assert geometry.scan_gutter(rows + cross, 350, 548) is None
    assert geometry.scan_gutter([(30, 50 + 14 * i, 200 + 7 * i, 60 + 14 * i) for i in range(20)], 350, 548) is None
    assert geometry.scan_gutter(rows[:10], 350, 548) is None


def test_page_numbers():
    row = lambda y, n, t="some words": [geometry.Line((40, y, 200, y + 10), t, t, 10.0), geometry.Line((290, y, 305, y + 10), n, n, 10.0, 1)]
    got = geometry.attach_page_numbers(row(100, "12") + row(120, "34") + row(140, "xii"), 548)
    assert [l.text for l in got] == ["some words 12", "some words 34", "some words xii"] and all(l.end for l in got)
    one = geometry.attach_page_numbers(row(100, "12"), 548)
    assert len(one) == 1 and not one[0].end
    assert len(geometry.attach_page_numbers(row(5, "12"), 548)) == 2
    mixed = geometry.attach_page_numbers(row(100, "12") + row(120, "5a8") + row(140, "7") + row(160, "9"), 548)
    assert sum(l.end for l in mixed) == 3


def raster(boxes, w=200, h=300):
    g = bytearray([208]) * (w * h)
    for x0, y0, x1, y1, v in boxes:
        for y in range(y0, y1):
            g[y * w + x0 : y * w + x1] = bytes([v]) * (x1 - x0)
    return bytes(g), w, h


def test_figure_noise_is_dropped(spark):
    lines = spark.createDataFrame([("b", 0, 0, 85.0, 70.0, 120.0, 80.0, "K Ores"), ("b", 0, 1, 20.0, 200.0, 180.0, 210.0, "a long line of plain prose that stays"), ("b", 0, 2, 85.0, 100.0, 120.0, 110.0, "Figure 3 here")], "book_id string, page_no int, seq int, x0 double, y0 double, x1 double, y1 double, text string")
    figures = spark.createDataFrame([("b", 0, 80.0, 60.0, 130.0, 150.0)], "book_id string, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.seq for r in geometry.drop_figure_noise(lines, figures).collect()) == [1, 2]


def test_figure_noise_of_lines_that_share_a_seq(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    lines = spark.createDataFrame([("b", 0, 7, 85.0, 70.0, 120.0, 80.0, "x"), ("b", 0, 7, 85.0, 300.0, 120.0, 310.0, "x"), ("b", 1, 7, 85.0, 70.0, 120.0, 80.0, "x"), ("b", 0, None, 85.0, 70.0, 120.0, 80.0, "x"), ("b", 0, 8, 85.0, 70.0, 120.0, 80.0, None)], f"book_id string, page_no int, seq int, {box}, text string")
    figures = spark.createDataFrame([("b", 0, 80.0, 60.0, 130.0, 150.0), ("b", 0, 70.0, 60.0, 130.0, 150.0)], f"book_id string, page_no int, {box}")
    kept = geometry.drop_figure_noise(lines, figures)
    assert kept.columns == lines.columns and {(r.page_no, r.seq, r.y0) for r in kept.collect()} == {(0, 7, 300.0), (0, 8, 70.0), (1, 7, 70.0)}


def test_whole_pages():
    import pyarrow as pa

    rows = [("a", 1), ("a", 1), ("a", 2), ("b", 2), ("b", 2), ("b", 2), (None, 2), (None, 3)]
    table = pa.table({"book_id": [r[0] for r in rows], "page_no": [r[1] for r in rows], "k": range(8)})
    for size in (1, 2, 3, 8):
        got = [t.column("k").to_pylist()[a:b] for t, pages in geometry.whole_pages(iter(table.to_batches(max_chunksize=size))) for a, b in pages]
        assert got == [[0, 1], [2], [3, 4, 5], [6], [7]]


def test_figures():
    ink = geometry.components(*raster([(50, 50, 52, 120, 60), (100, 50, 108, 58, 60)]), 1.0)
    assert ink == [(50, 50, 52, 120), (100, 50, 108, 58)]
    assert geometry.components(*raster([(50, 50, 60, 60, 178)]), 1.0) == []
    find = lambda boxes, told=(), prose=(), caption=(): [tuple(r) for r in geometry.figure_regions(geometry.components(*raster([(*b, 60) for b in boxes]), 1.0), told, prose, caption, 200, 300).tolist()]
    assert find([(90, 60, 92, 140)]) == [(90, 60, 92, 140)]
    assert find([(90, 60, 92, 140), (100, 45, 106, 52)]) == [(90, 45, 106, 140)]
    assert len(find([(30, 40, 32, 90), (150, 200, 152, 260)])) == 2
    assert find([(90, 60, 92, 140), (60, 61, 140, 63)], [(85, 142, 160, 152)], [True], [False]) == [(60, 60, 140, 140)]
    assert find([(90, 60, 92, 140)], [(20, 130, 160, 150)], [True], [False]) == [(90, 60, 92, 129.5)]  # cut back to the prose
    assert find([(90, 60, 92, 140)], [(20, 130, 160, 150)], [False], [False]) == [(90, 60, 92, 140)]
    chain = np.array([(20, 100, 160, 110), (20, 112, 160, 122), (30, 124, 160, 134), (20, 200, 160, 210)], float)
    assert geometry.protected(chain, np.zeros(4, bool), np.array([True, False, False, False])).tolist() == [0, 1, 2]
    touching = np.array([(0, 0, 10, 10), (20, 0, 30, 10), (10, 5, 20, 8), (50, 50, 60, 60)], float)
    assert sorted(map(tuple, geometry.merged_boxes(touching).tolist())) == [(0, 0, 30, 10), (50, 50, 60, 60)]


# ---- packing


@pytest.mark.parametrize(
    "y, h, ranges, want",
    [
        ([50, 200], [30, 30], None, [50, 200]), ([50, 100], [80, 30], None, [50, 134]), ([-3, 100], [20, 20], None, [22, 100]), ([200, 480], [100, 60], None, [200, 465]), ([100, 200, 300, 515], [40, 40, 40, 20], None, [100, 200, 300, 505]),
        ([100, 460, 510], [40, 40, 40], None, [100, 441, 485]), ([50, 600], [20, 20], None, [50, 505]), ([50, 60], [300, 300], None, None), ([50, 60, 50, 60], [200] * 4, [(22, 170), (22, 170), (180, 328), (180, 328)], [50, 254, 50, 254]),
        ([50, 300, 50], [240, 240, 30], [(22, 170), (22, 170), (180, 328)], [41, 285, 50]), ([], [], None, []),
    ],
)
def test_stack(spark, y, h, ranges, want):
    ranges = ranges or [(0, 1)] * len(y)
    df = spark.createDataFrame([([float(v) for v in y], [float(v) for v in h], [float(a) for a, _ in ranges], [float(b) for _, b in ranges])], "y array<double>, h array<double>, l array<double>, r array<double>")
    assert df.select(packing.stack("y", "h", "l", "r", 22, 525, 4).alias("t")).first().t == want


def test_sizes_and_frames(spark):
    size = lambda k, s, b: packing.font_size(F.lit(k), F.lit(float(s)), F.lit(float(b)))
    r = spark.range(1).select(size("text", 7.3, 9.1), size("heading", 14, 9.1), size("heading", 6, 9.1), size("heading", 120, 9.1), size("caption", 8, 10), size("caption", 3.1, 10), size("caption", 12, 10)).first()
    assert list(r) == [9.1, 14, 9.1, 18.2, 8, 8, 10]
    frame = lambda a, b: F.array(*packing.frame(F.lit(float(a)), F.lit(float(b)), F.lit(22.0), F.lit(328.0)))
    r = spark.range(1).select(frame(40, 240), frame(300, 400), frame(170, 180)).first()
    assert r[0] == [22, 328] and r[1] == [228, 328] and r[2] == [175 - 38.25, 175 + 38.25]
    fit = spark.range(1).select(packing.box_fit(F.lit(100.0), F.lit(96.0)).alias("a"), packing.box_fit(F.lit(100.0), F.lit(10.0)).alias("b")).first()
    assert (fit.a.ratio, fit.a.line_height, fit.a.overflow, fit.b.ratio, fit.b.overflow) == (1.0, 0.95, False, 0.7, True)


def test_figures_in_order(spark):
    items = spark.createDataFrame([("b", 0, i, y) for i, y in enumerate((50.0, 150.0, 250.0))], "book_id string, page_no int, ord int, y0 double")
    figs = spark.createDataFrame([("b", 0, 200.0), ("b", 0, 100.0), ("b", 0, 900.0)], "book_id string, page_no int, y0 double")
    got = packing.insert_figures(items, figs).orderBy("place").collect()
    assert [(r.is_figure, r.y0) for r in got] == [(0, 50), (1, 100), (0, 150), (1, 200), (0, 250), (1, 900)]


# ---- status, context, state


def test_cost(spark):
    t = spark.createDataFrame([(1000, 2000, 5000, 3000)], "in_tokens long, out_tokens long, cache_read long, cache_write long")
    assert round(t.select(status.cost(3, 15)).first()[0], 5) == 0.04575
    assert spark.range(1).select(status.whole_cost(F.lit(1.0), F.lit(100), F.lit(100))).first()[0] is None


def book(spark):
    rows = [("b", i, i // 2, i % 2, "p", "text", f"source {i}", f"target {i}" if i < 4 else None, '{"href":"c.xhtml"}' if i == 0 else None, i // 2, "overflow" if i == 1 else None) for i in range(8)]
    blocks = spark.createDataFrame(rows, "book_id string, block_id long, page_no int, pos int, tag string, kind string, src_html string, dst_html string, layout string, chunk_id long, flag string")
    chunks = spark.createDataFrame([("b", c, "done" if c < 2 else "pending", 1, None, None, None, 5, 5, 0, 0) for c in range(4)], "book_id string, chunk_id long, status string, attempts int, error string, provider string, model string, in_tokens long, out_tokens long, cache_read long, cache_write long")
    return blocks, chunks


def test_reports(spark):
    blocks, chunks = book(spark)
    t = status.totals(blocks).first()
    blocks = blocks.withColumn('cont_group', F.lit(None).cast('int'))
    assert (t.blocks, t.done, t.pages, t.chars_left) == (8, 4, 4, 32)
    assert status.complete_pages(blocks).first().pages_complete == 2
    assert [r.place for r in status.flag_samples(blocks).collect()] == ["page 1"]
    assert status.tokens(chunks.limit(0)).first().in_tokens == 0
    assert status.inspect(blocks).where("page_header IS NOT NULL").count() == 4
    assert status.render_totals(spark.createDataFrame([], "ratio double, overflow boolean")).first().median_ratio == 1.0


def test_context(spark):
    blocks, _ = book(spark)
    got = context.context_text(context.chunk_context(blocks)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.context) for r in got] == [(1, "target 0\ntarget 1"), (2, "target 1\ntarget 2\ntarget 3"), (3, "target 1\ntarget 2\ntarget 3")]


def test_snapshots(spark, tmp_path):
    blocks, chunks = book(spark)
    b, c = state.reset_range(blocks, chunks, 0, 0)
    assert b.where("dst_html IS NOT NULL").count() == 2 and c.where("status = 'pending' AND in_tokens = 0").count() == 1
    assert tuple(state.reset_preview(blocks, chunks, 0, 0).first()) == (2, 1, 5, 5)
    assert state.edit_block(blocks, "b", 1, "new").where("block_id = 1 AND dst_html = 'new' AND flag IS NULL").count() == 1
    with pytest.raises(ValueError):
        state.edit_block(blocks, "b", 1, " ")
    meta = spark.createDataFrame([("b", "k", "1")], "book_id string, key string, value string")
    new = spark.createDataFrame([("b", "k", "2", 1), ("b", "k", "3", 2), ("b", "n", "4", 1)], "book_id string, key string, value string, seq int")
    assert {(r.key, r.value) for r in state.upsert(meta, new, ["book_id", "key"], "seq").collect()} == {("k", "3"), ("n", "4")}
    old = spark.createDataFrame([("b", 1, 0, "c.xhtml", 0, "p", "x")], "book_id string, block_id long, doc_index int, doc_href string, pos int, tag string, src_html string")
    assert state.version_of(old, meta) == 1
    moved, told = state.migrate_v1(old, meta)
    assert moved.first().layout == '{"href":"c.xhtml"}' and state.get_meta(told, "b", "schema_version") == "2" and state.version_of(moved, told) == 2
    with pytest.raises(ValueError):
        state.version_of(moved, spark.createDataFrame([("b", "schema_version", "3")], "book_id string, key string, value string"))
    added = state.append_blocks(blocks.select("book_id", "block_id", "page_no"), spark.createDataFrame([("b", 9), ("b", 8)], "book_id string, page_no int"), ["page_no"])
    assert [(r.block_id, r.page_no) for r in added.where("block_id > 7").orderBy("block_id").collect()] == [(8, 8), (9, 9)]
    flags = state.overflow_flags(blocks, spark.createDataFrame([("b", 4)], "book_id string, block_id long"), 0, 1)
    assert {r.block_id for r in flags.where("flag = 'overflow'").collect()} == {4}
    store = state.Store(spark, str(tmp_path / "s"))
    assert store.version() == 0
    store.commit(blocks=blocks, chunks=chunks)
    store.commit(blocks=blocks.limit(1))
    assert store.version() == 2 and store.read("blocks").count() == 1 and store.read("chunks").count() == 4


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


class Flaky(providers.Echo):
    """Leaves out segment 5 and breaks the tags of 6 and 7 always."""

    def call(self, client, model, system, user):
        a = super().call(client, model, system, user)
        a.text = a.text.replace('<seg id="5">[VI] source 5</seg>', "").replace("[VI] source 6", "<b>[VI] source 6").replace("[VI] source 7", "<b>[VI] 7")
        return a


class Broken(providers.Echo):
    def call(self, client, model, system, user):
        raise providers.FatalError("no key")


def test_work_loop(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "a"))
    blocks, chunks = book(spark)
    store.commit(blocks=blocks, chunks=chunks)
    assert translate.run(store, "echo", pause=0) == 0
    done = {r.block_id: r.dst_html for r in store.read("blocks").collect()}
    assert done[4] == "[VI] source 4" and done[0] == "target 0"
    assert {(r.status, r.in_tokens) for r in store.read("chunks").where("chunk_id > 1").collect()} == {("done", 15)}

    store = state.Store(spark, str(tmp_path / "b"))
    store.commit(blocks=blocks, chunks=chunks)
    assert translate.run(store, Flaky, pause=0) == 1
    rows = {r.block_id: (r.dst_html, r.flag) for r in store.read("blocks").collect()}
    assert rows[5] == (None, None) and rows[6][1] == "tag_mismatch" and rows[7][1] is not None
    c = {r.chunk_id: (r.status, r.attempts) for r in store.read("chunks").collect()}
    assert c[2] == ("failed", 4) and c[3][0] == "done"

    store = state.Store(spark, str(tmp_path / "c"))
    store.commit(blocks=blocks, chunks=chunks)
    with pytest.raises(providers.FatalError):
        translate.run(store, Broken, pause=0)
    assert store.read("chunks").where("status = 'pending' AND attempts = 1").count() == chunks.where("status = 'pending' AND attempts = 1").count()


class Forgetful(providers.Echo):
    """Segment 5 comes with broken tags the first time and never again; the answers to later attempts are cut."""

    def call(self, client, model, system, user):
        a = super().call(client, model, system, user)
        if "missing or wrong" in user:
            return providers.Answer("", a.usage, "length")
        a.text = a.text.replace("[VI] source 5", "<b>[VI] source 5").replace('<seg id="6">[VI] source 6</seg>', "")
        return a


class Stops(providers.Echo):
    """Can't go on at the chunk with segment 6."""

    def call(self, client, model, system, user):
        if "source 6" in user:
            raise providers.FatalError("no balance")
        return super().call(client, model, system, user)


def test_best_answer_of_all_attempts(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "s"))
    blocks, chunks = book(spark)
    store.commit(blocks=blocks, chunks=chunks)
    translate.run(store, Forgetful, pause=0)
    rows = {r.block_id: (r.dst_html, r.flag) for r in store.read("blocks").collect()}
    assert rows[5] == ("<b>[VI] source 5", "tag_mismatch") and rows[6] == (None, None)
    left = blocks.where("block_id = 6").first().chunk_id
    c = {r.chunk_id: r for r in store.read("chunks").collect()}
    assert c[left].status == "failed" and "1 segments missing" in c[left].error and "cut at the token limit" in c[left].error


def test_a_stop_loses_one_wave(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "s"))
    blocks, chunks = book(spark)
    store.commit(blocks=blocks, chunks=chunks)
    before = {r.chunk_id: r for r in store.read("chunks").collect()}
    stopped = blocks.where("block_id = 6").first().chunk_id
    with pytest.raises(providers.FatalError, match="no balance"):
        translate.run(store, Stops, pause=0, wave=1)
    after = {r.chunk_id: r for r in store.read("chunks").collect()}
    assert after[stopped] == before[stopped] and all(after[c].status == "done" for c in after if c < stopped)
    assert all(after[c] == before[c] for c in after if c > stopped)
    assert store.read("blocks").where(f"chunk_id = {stopped}").exceptAll(blocks.where(f"chunk_id = {stopped}").select(store.read("blocks").columns)).count() == 0
    assert translate.run(store, "echo", pause=0, wave=2) == 0
    assert store.read("blocks").where("dst_html IS NULL AND chunk_id IS NOT NULL").count() == 0


def test_nothing_is_called_after_a_fatal_error(spark):
    asked = spark.createDataFrame([("b", i, f"source {i}") for i in range(5, 9)], "book_id string, chunk_id long, prompt string").coalesce(1)
    got = {r.chunk_id: (r.called, r.fatal) for r in providers.ask(asked, Stops, "").collect()}
    assert got == {5: (True, False), 6: (True, True), 7: (False, False), 8: (False, False)}


@pytest.mark.parametrize("kind", ["messages", "chat"])
def test_adapters(kind):
    """The adapters against clients that answer as the services do."""
    from types import SimpleNamespace as N

    said = []
    keep = lambda answer: lambda **k: (said.append(k), answer)[1]
    if kind == "messages":
        reply = N(content=[N(type="text", text="a"), N(type="other"), N(type="text", text="b")], usage=N(input_tokens=5, output_tokens=2, cache_read_input_tokens=3, cache_creation_input_tokens=None), stop_reason="max_tokens")
        a = providers.CachedMessages().call(N(messages=N(create=keep(reply))), "m", "sys", "user")
        assert a.usage == {"in_tokens": 5, "out_tokens": 2, "cache_read": 3, "cache_write": 0} and said[0]["system"][0]["cache_control"] == {"type": "ephemeral"}
    else:
        choice = N(message=N(content="ab"), finish_reason="length")
        reply = N(choices=[choice], usage=N(prompt_tokens=9, completion_tokens=2, prompt_tokens_details=N(cached_tokens=4)))
        a = providers.Compatible().call(N(chat=N(completions=N(create=keep(reply)))), "m", "sys", "user")
        assert a.usage == {"in_tokens": 5, "out_tokens": 2, "cache_read": 4, "cache_write": 0}
        with pytest.raises(RuntimeError):
            providers.Compatible().call(N(chat=N(completions=N(create=keep(N(choices=[], usage=None))))), "m", "sys", "user")
    assert a.text == "ab" and a.truncated


def test_providers():
    assert providers.names() == ["anthropic", "echo", "openai"]
    with pytest.raises(ValueError):
        providers.get("nobody")
    e = type("E", (Exception,), {})
    quota, busy, pay = e("insufficient quota"), e("slow down"), e("pay")
    quota.status_code, busy.status_code, pay.status_code = 429, 429, 402
    p = providers.Compatible()
    assert p.is_fatal(quota) and not p.is_fatal(busy) and p.is_retryable(busy) and p.is_fatal(pay)
    assert providers.usage(in_tokens=3, out_tokens=None) == {"in_tokens": 3, "out_tokens": 0, "cache_read": 0, "cache_write": 0}
    assert providers.Answer("x", stop="length").truncated


# ---- sources and sinks

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Book &amp; more</dc:title></metadata>
<manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>"""
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><navPoint><navLabel><text>One A</text></navLabel></navPoint></navPoint><navPoint><navLabel><text>2</text></navLabel></navPoint></navMap></ncx>'
DOC_A = '<html xml:lang="en"><head><title>t</title></head><body><nav><p>skip me</p></nav><h1>Title</h1><p>42</p><p>See <a href="#x" id="k">this</a> &amp; that.</p></body></html>'
DOC_B = "<html><head></head><body><ul><li>first</li><li>second <em>thing</em></li></ul><div><p>inner</p></div></body></html>"


def make_epub(mimetype="application/epub+zip"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if mimetype:
            z.writestr("mimetype", mimetype)
        for name, data in (("META-INF/container.xml", CONTAINER), ("O/p.opf", PACKAGE), ("O/n.ncx", NCX), ("O/a.xhtml", DOC_A), ("O/b.xhtml", DOC_B)):
            z.writestr(name, data)
    return out.getvalue()


def test_sniff(spark, tmp_path):
    cases = {"a.bin": (make_epub(), "epub"), "b.epub": (b"%PDF-1.7 x", "pdf"), "c": (b"", None), "d": (b"PK\x03\x04junk", None), "e": (make_epub(None), None), "f": (make_epub("text/plain"), None), "g.pdf": (b"hello", None)}
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.format, r.error) for r in sources.sniff(sources.binary_files(spark, str(tmp_path))).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in cases.items()}
    assert len({v[1] for v in got.values() if v[1]}) == 5
    with pytest.raises(Exception, match="unsupported source"):
        sources.sniff(sources.binary_files(spark, str(tmp_path))).transform(sources.ensure_supported).collect()


def test_epub(spark, tmp_path):
    (tmp_path / "book").write_bytes(make_epub())
    blocks = sources.load(spark, str(tmp_path / "book"))
    got = [(r.page_no, r.pos, r.tag, r.src_html) for r in blocks.orderBy(F.col("page_no") < 0, F.desc("page_no"), "pos").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 0, "h1", "Title"), (0, 2, "p", 'See <a href="#x" id="k">this</a> &amp; that.')]
    assert [g[3] for g in got if g[0] == 1] == ["first", "second <em>thing</em>", "inner"]
    assert [g[3] for g in got if g[0] == -1] == ["One", "One A"] and [g[3] for g in got if g[0] == -2] == ["A Book &amp; more"]
    done = blocks.withColumn("dst_html", F.upper("src_html")).where("page_no <> 0 OR pos = 2")
    files = sources.binary_files(spark, str(tmp_path / "book"))
    data = sinks.epub_books(files, sinks.epub_parts(done), bilingual=True).first().content
    a = zipfile.ZipFile(io.BytesIO(data)).read("O/a.xhtml").decode()
    assert '<p>SEE <A HREF="#X" ID="K">THIS</A> &AMP; THAT.</p><p class="bt-src">See <a href="#x">this</a> &amp; that.</p>' in a
    assert '<html lang="vi">' in a and "<h1>Title</h1>" in a and ".bt-src" in a
    b = zipfile.ZipFile(io.BytesIO(data)).read("O/b.xhtml").decode()
    assert '<li>FIRST<br/><span class="bt-src">first</span></li>' in b


def test_leaves_without_closing():
    assert [(t, x) for _, t, _, x in html.blocks_of("<p><b>outer<br><p>inner</p><p>last</article>")] == [("p", "inner"), ("p", "last")]
    assert html.blocks_of("") == [] and html.blocks_of("no tags") == []
    assert html.blocks_of("<div><script>var t='</p>'</script>x</div>") == [(0, "div", "<script>var t='</p>'</script>x", "x")]


def test_pdf_pages(spark):
    spans = [("b", 0, n, 0, f"This is line {n} of the text", "Times", 10.0, 0, 1.0, 0.0, 60.0, 100.0 + 12 * n, 300.0, 110.0 + 12 * n) for n in range(8)] + [("b", 0, 20, 0, "turned", "Times", 10.0, 0, 0.0, 1.0, 5.0, 5.0, 9.0, 90.0)]
    s = spark.createDataFrame(spans, "book_id string, page_no int, line_no int, span_no int, text string, font string, size double, block_type int, dx double, dy double, x0 double, y0 double, x1 double, y1 double")
    images = spark.createDataFrame([("b", 0, 0.0, 0.0, 100.0, 100.0, 522.0, 666.0)], "book_id string, page_no int, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    pages = spark.createDataFrame([("b", 0, 522.0, 666.0, 1)], "book_id string, page_no int, page_width double, page_height double, n_pages int")
    got = pdf.load(s, images, pages).collect()
    assert len(got) == 1 and got[0].tag == "p" and got[0].src_html.startswith("This is line 0") and "turned" not in got[0].src_html
    assert not pdf.scanned_pages(images).first().scanned


def make_pdf(pages, packed=True, extra="", width=400, height=600):
    """Pages of (x, y from the top, size, text); a text of None is an image over the whole page."""
    out, at = bytearray(b"%PDF-1.5\n"), 4
    put = lambda n, body: out.extend(f"{n} 0 obj\n".encode() + body + b"\nendobj\n")
    kids = []
    for page in pages:
        told = "".join("q 400 0 0 600 0 0 cm /I Do Q\n" if t is None else f"BT /F {s} Tf 1 0 0 1 {x} {height - y} Tm ({t}) Tj ET\n" for x, y, s, t in page).encode()
        data = zlib.compress(told) if packed else told
        put(at, f"<< /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream")
        put(at + 1, f"<< /Type /Page /Parent 2 0 R /Contents {at} 0 R /Resources << /Font << /F 3 0 R >> /XObject << /I 900 0 R >> >> {extra} >>".encode())
        kids.append(f"{at + 1} 0 R")
        at += 2
    put(900, b"<< /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Length 1 >>\nstream\n\x00\nendstream")
    put(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Bold /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [ 128 /eacute /fi /uni0110 ] >> >>")
    put(2, f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} /MediaBox [0 0 {width} {height}] >>".encode())
    put(1, b"<< /Type /Catalog /Pages 2 0 R >>")
    return bytes(out) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_objects():
    r = pdffile.Reader(b"<< /A#42 [1 -2.5 (a\\(b\\051(c)\\101) <4a4> true null 7 0 R] /B << /C /D >> >> % end\nTj")
    assert r.one() == {"AB": [1, -2.5, b"a(b)(c)A", b"J@", True, None, pdffile.Ref(7)], "B": {"C": "D"}}
    assert r.one() == b"Tj" and r.one() is None
    assert pdffile.unfiltered(b"\x02abc\xfed\x80", ["RunLengthDecode"], []) == b"abcddd"
    assert pdffile.unfiltered(base64.a85encode(b"Hello there") + b"~>", ["A85"], []) == b"Hello there"
    assert pdffile.unfiltered(b"48 65 6>", ["ASCIIHexDecode"], []) == b"He`"
    rows = zlib.compress(bytes([2, 1, 2, 3, 2, 1, 1, 1, 1, 5, 1, 1]))
    assert list(pdffile.unfiltered(rows, ["FlateDecode"], [{"Predictor": 12, "Columns": 3}])) == [1, 2, 3, 2, 3, 4, 5, 6, 7]
    told = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <01> <00660069> endbfchar 2 beginbfrange <02> <04> <0041> <05> <06> [<0058> <0059>] endbfrange"
    assert pdffile.character_map(told) == {1: "fi", 2: "A", 3: "B", 4: "C", 5: "X", 6: "Y"}
    assert [pdffile.glyph_text(n) for n in ("A", "space", "uni0110", "eacute", "ccedilla", "g23x", "a.alt")] == ["A", " ", "Đ", "é", "ç", "", "a"]


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(packed):
    page = pdffile.Pdf(make_pdf([[(50, 100, 10, "one"), (65.5, 100, 10, "two"), (200, 100, 10, "far"), (50, 120, 10, "\\200\\201\\202 \\(x\\)"), (0, 0, 0, None)]], packed)).pages[0]
    spans, images = page.shown()
    assert [[s.text for s in line] for line in pdffile.lines_of(spans)] == [["onetwo"], ["far"], ["éfiĐ (x)"]]
    assert images == [(0.0, 0.0, 400.0, 600.0)] and page.size == (400.0, 600.0)
    assert [round(v, 3) for v in spans[0].box] == [50, 92, 65, 102] and spans[0].font == "Times-Bold" and spans[0].dir == (1.0, 0.0)
    left = page.without_text([(40, 90, 180, 105)])
    assert b"(far)" in left and b"(one)" not in left and b"(two)" not in left


def test_pdf_turned_and_broken():
    page = pdffile.Pdf(make_pdf([[(50, 100, 10, "one")]], extra="/Rotate 90")).pages[0]
    span = page.shown()[0][0]
    assert page.size == (600.0, 400.0) and [round(v) for v in span.dir] == [0, 1] and [round(v) for v in span.start] == [500, 50]
    for data, why in ((b"%PDF-1.4 junk", "catalogue"), (make_pdf([[]]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"), "password")):
        with pytest.raises(pdffile.BrokenPdf, match=why):
            pdffile.Pdf(data).pages
    cut = make_pdf([[(50, 100, 10, "whole")], [(50, 100, 10, "gone")]])
    assert pdffile.Pdf(cut[: cut.index(b"\n6 0 obj")]).objects and pdffile.Pdf(make_pdf([[]])).pages[0].shown() == ([], [])


def test_pdf_book(spark, tmp_path):
    prose = [(50, 100 + 14 * n, 10, f"Line {n} of the first page goes on") for n in range(6)] + [(50, 260, 18, "A NEW PART"), (50, 300, 10, "Its text is here.")]
    (tmp_path / "x").write_bytes(make_pdf([prose, [], [(50, 100, 10, "Last page.")]]))
    got = sources.load(spark, str(tmp_path / "x")).orderBy("page_no", "pos").collect()
    assert [(r.page_no, r.pos, r.tag, r.kind) for r in got] == [(0, 0, "p", "text"), (0, 1, "h2", "heading"), (0, 2, "p", "text"), (2, 0, "p", "text")]
    assert got[0].src_html.startswith("<b>Line 0 of") and got[1].src_html == "<b>A NEW PART</b>" and got[3].bbox.startswith("50.0,")
    n = pdf.file_pages(sources.binary_files(spark, str(tmp_path / "x"))).select("page_no", "n_pages", F.size("spans").alias("s")).orderBy("page_no").collect()
    assert [(r.page_no, r.n_pages, r.s) for r in n] == [(0, 3, 8), (1, 3, 0), (2, 3, 1)]
    (tmp_path / "y").write_bytes(b"%PDF-1.4 nothing")
    with pytest.raises(Exception, match="unsupported source .*y: the file has no catalogue"):
        sources.load(spark, str(tmp_path / "y")).collect()


def test_ocr(spark):
    quad = lambda x0, y0, x1, y1, dy=0.0: [[x0, y0], [x1, y0 + dy], [x1, y1 + dy], [x0, y1]]
    rows = [("b", 0, 0, quad(100.0, 200.0, 300.0, 240.0), "words"), ("b", 0, 1, quad(0.0, 0.0, 10.0, 5.0), " "), ("b", 0, 2, quad(0.0, 0.0, 100.0, 20.0, 27.0), "tilted"), ("b", 0, 3, quad(0.0, 0.0, 10.0, 100.0), "upright")]
    got = pdf.ocr_lines(spark.createDataFrame(rows, "book_id string, page_no int, seq int, quad array<array<double>>, text string"), 0.36).collect()
    assert len(got) == 1 and [round(got[0][c], 3) for c in ("x0", "y0", "x1", "y1", "size")] == [36, 72, 108, 86.4, 11.52]


def test_sinks(spark):
    assert sinks.output_name("pdf") == "output.vi.pdf" and sinks.output_name("epub", True) == "output.bilingual.epub"
    with pytest.raises(sinks.UnsupportedTarget):
        sinks.write("epub", {"epub": print}, mode="reflow")
    with pytest.raises(sinks.UnsupportedTarget):
        sinks.write("pdf", {"pdf": print}, mode="other")
    items = spark.createDataFrame([(0, 1, 1.0, False), (1, 2, 0.7, True)], "page_no int, block_id long, ratio double, overflow boolean")
    assert [r.line for r in sinks.report_lines(items).collect()][-1] == "page 2, block 2"
    pages = spark.createDataFrame([("b", 0, 100.0, 50.0), ("b", 1, 100.0, 50.0)], "book_id string, page_no int, page_width double, page_height double")
    assert sinks.spreads(pages).first().width == 200
    blocks = spark.createDataFrame([("b", 0, 0, 1, "text", "one two three four five", None, "0,0,1,1")], "book_id string, page_no int, pos int, block_id long, kind string, src_html string, dst_html string, bbox string")
    got = sinks.pdf_items(blocks, pages, dry_run=True).orderBy("page_no").collect()
    assert got[0]["items"][0].shown == "one two three four five one" and got[1]["items"] is None


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.collapse(F.lit(" a \n b "))) == "a b" and len(one(X.collapse(F.lit("x" * 200)))) == 90
    assert one(X.html_to_text(F.lit(" <b>a &lt; b &amp;lt;</b> "))) == "a < b &lt;"
    assert one(X.is_caption(F.lit("© Figure 12 a map"))) and not one(X.is_caption(F.lit("see Figure 12")))
    assert one(X.plain_tail(F.lit("<i>" + "a" * 700 + "</i>"))) == "a" * 600


def test_contents(spark):
    e = spark.createDataFrame([("b", "1", None, 0, "A"), ("b", "2", "1", 1, "A2"), ("b", "3", "1", 0, "A1"), ("b", "4", None, 1, "B")], "book_id string, entry_id string, parent_id string, ord int, title string")
    assert [r.title for r in epub.flatten_contents(e).orderBy("place").collect()] == ["A", "A1", "A2", "B"]


def test_deep_and_long_contents(spark):
    deep = spark.range(3000).selectExpr("'d' AS book_id", "id AS entry_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id", "1 AS ord", "string(id) AS title")
    long = spark.range(300_000).selectExpr("'l' AS book_id", "id AS entry_id", "CASE WHEN id >= 10 THEN id % 10 END AS parent_id", "id + 100000000 AS ord", "string(id) AS title")
    lost = spark.createDataFrame([("o", 1, 2, 0, "a"), ("o", 2, 1, 0, "b"), ("o", 3, None, 0, None), ("o", 4, 9, 0, "c")], "book_id string, entry_id long, parent_id long, ord long, title string")
    got = epub.flatten_contents(deep.withColumn("ord", F.col("ord").cast("long")).unionByName(long).unionByName(lost))
    assert got.where("book_id = 'd' AND place = entry_id AND depth = entry_id").count() == 3000
    rows = [tuple(r) for r in got.where("book_id = 'l' AND place BETWEEN 30000 AND 30002").orderBy("place").select("entry_id", "depth").collect()]
    assert rows == [(1, 0), (11, 1), (21, 1)] and [r.entry_id for r in got.where("book_id = 'o'").collect()] == [3]


def test_attributes_that_hold_signs():
    page = """<html lang='a>b'><p title="a>b">text</p><p title='x > "y"'>more <a id="k>1" name='n' href="#">link</a></p><script data-x=">">var a = "<p>no</p>";</script><p data-a=don't>it</p></html>"""
    assert [t for *_, t in html.blocks_of(page)] == ["text", "more link", "it"]
    assert html.without_anchors("""<a title="x>y" id="k>1" name='n' href="#">l</a><b name="m" ID=k>b</b>""") == """<a title="x>y" href="#">l</a><b name="m">b</b>"""
    done = html.put_back(page, {0: "một"}, bilingual=True)
    assert '<p title="a>b">một</p><p class="bt-src">text</p>' in done and done.startswith('<html lang="vi">')


def test_references_with_and_without_semicolon():
    page = "<p>a &lt;&#65;&#x42;&amp;lt; &amp&ampx; &notit; &copy</p>"
    assert [t for *_, t in html.blocks_of(page)] == ["a <AB&lt; &&x; ¬it; ©"]
    assert [t for *_, t in html.blocks_of(page, closed_only=True)] == ["a <AB&lt; &amp&ampx; &notit; &copy"]
    assert html.blocks_of("<p>&amp</p>") == [] and html.blocks_of("<p>&amp;</p>", closed_only=True) == []


def test_pages_are_sliced_by_bytes(spark):
    import pyarrow as pa

    n = html.SLICE_BYTES
    sizes = [1, None, n - 1, 1, 3 * n, 2, 0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([None if s is None else "x" * s for s in sizes])], ["page_id", "html"])
    assert [p.column(0).to_pylist() for p in html.page_slices(batch)] == [[0, 1, 2], [3], [4], [5, 6]] and not list(html.page_slices(batch.slice(7)))
    pages = spark.range(40).selectExpr("id AS page_id", f"concat('<p>', repeat('ab ', {n // 10}), '</p><p>', id, ' c</p>') AS html").coalesce(1)
    targets = pages.selectExpr("page_id", "1 AS pos", "concat('d', page_id) AS dst_html")
    done = html.leaf_blocks(html.apply_targets(pages, targets)).where("pos = 1").select("page_id", "text")
    assert html.leaf_blocks(pages).count() == 80 and sorted(map(tuple, done.collect())) == [(i, f"d{i}") for i in range(40)]


def test_attributes_that_hold_signs_in_sql(spark):
    import duckdb
    import pandas as pd

    from quire.plans.sql import ORACLE

    pages = pd.DataFrame({"page_id": [1, 2], "html": ["""<body><p title="a>b">text</p><div class='x>"y"'><p>in</p></div></body>""", """<p a="1" b='>'>one<br>two</p><ul><li title="<p>">three</li></ul>"""]})
    c = duckdb.connect()
    c.register("pages", pages)
    got = sorted(map(tuple, html.leaf_blocks(spark.createDataFrame(pages)).select("page_id", "pos", "tag", "text").collect()))
    assert got == sorted(c.execute(ORACLE["html_leaf_blocks"]).fetchall()) and len(got) == 4


def test_streams(spark, sf, tmp_path):
    from quire import streaming

    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in spark.read.parquet(str(tmp_path / "in")).dtypes)
    seen = []
    streaming.watch_pages(spark, str(tmp_path / "in"), schema, lambda df, i: seen.append(df.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == html.leaf_blocks(spark.read.parquet(str(tmp_path / "in"))).count()


def test_small_reports(spark):
    blocks, _ = book(spark)
    assert [(r.chunk_id, r.blocks, r.chars) for r in status.chunk_sizes(blocks).orderBy("chunk_id").collect()] == [(c, 2, 16) for c in range(4)]
    sized = blocks.withColumn("layout", F.when(F.col("block_id") < 3, F.format_string('{"size":%d.5}', "block_id")))
    assert layout.column_body_size(sized).first().body_size == 1.5
    assert layout.column_body_size(blocks).first().body_size == 10.0
    tried = spark.createDataFrame([("b", 0, 1.0, False), ("b", 0, 0.9, True), ("b", 0, 0.8, True), ("b", 1, 0.75, False)], "book_id string, page_no int, scale double, fits boolean")
    assert {r.page_no: r.scale for r in packing.page_scale(tried).collect()} == {0: 0.9, 1: None}


def test_event_stream(spark, sf, tmp_path):
    from quire import streaming

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    got = streaming.event_rates(spark, str(tmp_path / "in"), schema)
    q = got.writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "60 minutes"), "event_type").count()
    assert spark.table("rates").agg(F.sum("n"), F.count("*")).first()[:] == want.agg(F.sum("count"), F.count("*")).first()[:]
