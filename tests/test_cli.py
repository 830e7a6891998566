"""Commands end to end on a generated book, fonts, and placing pages."""

import io
import struct
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_operators import make_epub, make_pdf

from quire import cli, fonts, pdfdraw, sinks
from quire.operators import packing, state
from quire.sources import pdffile


def run(spark, capsys, *args):
    code = cli.main([str(a) for a in args], spark)
    said = capsys.readouterr()
    return code, said.out + said.err


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "b.epub").write_bytes(make_epub())
    p = tmp_path / "p"
    do = lambda *a: run(spark, capsys, *a)
    assert do("status", p)[0] == 1
    assert "chunks in" in do("init", tmp_path / "b.epub", "--dir", p, "--chunk-chars", 20)[1]
    assert "--force" in do("init", tmp_path / "b.epub", "--dir", p)[1]
    assert "0 of 8 done" in do("status", p)[1]
    said = do("inspect", p, "--pages", "1")[1]
    assert "--- page 1 ---" in said and "Title" in said and "first" not in said
    (p / "glossary.txt").write_text("Title = Tiêu đề\n")
    assert do("translate", p, "--pages", "9")[0] == 1 and "outside" in do("translate", p, "--pages", "9")[1] and "reversed" in do("translate", p, "--pages", "2-1")[1]
    assert do("translate", p, "--provider", "nobody")[0] == 1
    assert "chunks are left" in do("translate", p, "--limit", 1, "--pause", 0)[1]
    code, said = do("translate", p, "--pause", 0)
    assert code == 0 and "0 chunks are left" in said
    assert "nothing is left" in do("translate", p)[1]
    said = do("status", p)[1]
    assert "8 of 8 done" in said and "missing_term: 1" in said and "echo / echo-1" in said and "pages done: 2 of 2" in said
    assert "would drop" in do("reset", p, "--pages", "1")[1] and do("reset", p)[0] == 1
    assert "dropped 2 targets" in do("reset", p, "--pages", "1", "--yes")[1] and "no target" in do("reset", p, "--pages", "1", "--yes")[1]
    assert "6 of 8 done" in do("status", p)[1]
    assert do("edit", p, "--block", 1, "--set", " ")[0] == 1 and "changed" in do("edit", p, "--block", 1, "--set", "Tiêu đề")[1]
    assert "target: Tiêu đề" in do("edit", p, "--block", 1)[1] and do("edit", p, "--block", 99)[0] == 1
    assert "candidate" in do("glossary", p)[1]
    assert do("export", p, "--mode", "reflow")[0] == 1
    said = do("export", p, "--bilingual", "-o", tmp_path / "out.epub")[1]
    assert "1 blocks have no target" in said and "written" in said
    z = zipfile.ZipFile(tmp_path / "out.epub")
    assert ">Tiêu đề<" in z.read("O/a.xhtml").decode() and "[VI] first<br/>" in z.read("O/b.xhtml").decode()
    assert "[VI] One A</text>" in z.read("O/n.ncx").decode() and "[VI] A Book &amp; more" in z.read("O/p.opf").decode()


def test_several_books(spark, tmp_path, capsys):
    for place in ("a.epub", "b.epub", "c.epub"):
        (tmp_path / "in" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / place).write_bytes(make_epub())
    p, do = tmp_path / "p", lambda *a: run(spark, capsys, *a)
    assert do("init", tmp_path / "in", "--dir", p)[0] == 0 and "0 chunks are left" in do("translate", p, "--pause", 0, "--wave", 2)[1]
    code, said = do("edit", p, "--block", 1)
    assert code == 1 and "--book" in said
    book = next(r.book_id for r in state.Store(spark, f"{p}/tables").read("blocks").collect() if r.book_id.endswith("c.epub"))
    assert "changed" in do("edit", p, "--block", 1, "--book", book, "--set", "Một mình")[1]
    assert "written" in do("export", p, "-o", tmp_path / "out")[1]
    books = sorted((tmp_path / "out").glob("*.epub"))
    assert len(books) == 3 and ["Một mình" in zipfile.ZipFile(b).read("O/a.xhtml").decode() for b in books] == [False, False, True]


def font(letters):
    """A font file with nothing but a character map."""
    codes = sorted({ord(c) for c in letters})
    n = len(codes) + 1
    ends, starts = [*codes, 0xFFFF], [*codes, 0xFFFF]
    sub = struct.pack(">HHHHHHH", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + struct.pack(f">{n}H", *ends) + b"\0\0" + struct.pack(f">{n}H", *starts) + b"\0" * 4 * n
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub
    return struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, len(cmap)) + cmap


def test_fonts(tmp_path, monkeypatch):
    good, bad = tmp_path / "g.ttf", tmp_path / "b.ttf"
    good.write_bytes(font(fonts.PROBE + "abc"))
    bad.write_bytes(font("abc"))
    g, b, gone = str(good), str(bad), str(tmp_path / "x.ttf")
    assert fonts.missing(g) == [] and len(set(fonts.missing(b))) == 25
    assert fonts.choose(((gone,) * 3, (g, g, b), (g, g, g))).regular == g
    with pytest.raises(fonts.MissingFont, match="lacks"):
        fonts.choose(((gone,) * 3, (g, g, b)))
    monkeypatch.setenv(fonts.VARIABLE, b)
    with pytest.raises(fonts.MissingFont):
        fonts.choose()
    monkeypatch.setenv(fonts.VARIABLE, g)
    assert fonts.choose().name == "g.ttf" and "g.ttf" in fonts.css(fonts.choose(), 9.5, 1.2)
    with pytest.raises(fonts.MissingFont, match="three"):
        fonts.named_set("a:b", ":")
    (tmp_path / "n.ttf").write_bytes(b"no font")
    with pytest.raises(fonts.MissingFont, match="read"):
        fonts.missing(str(tmp_path / "n.ttf"))


def test_place_pages(spark):
    rows = [("b", 0, 0, "heading", "Title", 14.0, 40.0, 30.0, 240.0, 44.0), ("b", 0, 1, "text", "x" * 400, 10.0, 40.0, 60.0, 300.0, 120.0), ("b", 0, 2, "picture", "", 0.0, 50.0, 130.0, 150.0, 230.0), ("b", 1, 0, "text", "y" * 20000, 10.0, 40.0, 60.0, 300.0, 120.0)]
    df = spark.createDataFrame(rows, "book_id string, page_no int, ord int, kind string, html string, size double, x0 double, y0 double, x1 double, y1 double").withColumns({"page_width": F.lit(350.0), "page_height": F.lit(548.0), "body_size": F.lit(10.0)})
    got = {(r.page_no, r.ord): r for r in packing.place_pages(df).collect()}
    assert got[0, 0].scale == 1.0 and (got[0, 0].left, got[0, 0].right) == (22.0, 328.0) and got[0, 0].top == 30.0
    assert got[0, 1].top >= got[0, 0].top + got[0, 0].height and got[0, 2].top >= got[0, 1].top + got[0, 1].height and got[0, 2].height == 50.0
    assert got[1, 0].scale is None and (got[1, 0].left, got[1, 0].top) == (40.0, 60.0)


def test_draw_pages(spark):
    pages = spark.createDataFrame([("b", 0)], "book_id string, page_no int")
    blocks = spark.createDataFrame([("b", 0, 0, 7, "text", "one", "two", "0,0,1,1")], "book_id string, page_no int, pos int, block_id long, kind string, src_html string, dst_html string, bbox string")

    def build():
        return lambda row: (row["items"][0]["shown"].encode(), [(row["items"][0]["block_id"], 0.7, True)])

    r = sinks.draw_pages(sinks.pdf_items(blocks, pages), build).first()
    assert bytes(r.content) == b"two" and r.stats[0].block_id == 7 and r.stats[0].overflow
    assert spark.range(1).select(sinks.overlay_decision(F.lit(False), F.lit(True), F.lit(True))).first()[0] == "overflow"


@pytest.mark.skipif(not all(Path(f).exists() for f in fonts.SYSTEM_SETS[0]), reason="needs the DejaVu fonts")
def test_pdf_commands(spark, tmp_path, capsys):
    prose = [(50, 100 + 14 * n, 10, f"Line {n} of the first page goes on") for n in range(6)]
    (tmp_path / "b.pdf").write_bytes(make_pdf([[*prose, (0, 0, 0, None)], [], [(50, 100, 10, "Last page."), (50, 300, 10, "Its end")]]))
    p, do = tmp_path / "p", lambda *a: run(spark, capsys, *a)
    assert "3 blocks" in do("init", tmp_path / "b.pdf", "--dir", p)[1]
    assert "changed" in do("edit", p, "--block", 1, "--set", "Một <b>dòng</b> ngắn &amp; rõ.")[1]
    assert "changed" in do("edit", p, "--block", 2, "--set", "dài quá " * 200)[1]
    said = do("export", p, "-o", tmp_path / "o.pdf", "--mode", "overlay", "--probe")[1]
    assert "1 blocks have no target" in said and "(2 items, 1 don't fit)" in said and "overflow: 1" in do("status", p)[1]
    pages = pdffile.Pdf((tmp_path / "o.pdf").read_bytes()).pages
    texts = [["".join(s.text for s in line) for line in pdffile.lines_of(page.shown()[0])] for page in pages]
    assert len(pages) == 4 and pages[1].size == (800.0, 600.0) and len(pages[1].shown()[1]) == 2
    assert "items: 2 " in texts[0] and "page 3, block 2 " in texts[0]
    assert texts[1][:6] == [t for *_, t in prose] and texts[1][6:] == ["Một dòng ngắn & rõ. ", "1 "]
    assert texts[3].count("Last page.") == 2 and texts[3].count("Its end") == 2
    do("export", p, "-o", tmp_path / "r.pdf", "--mode", "reflow", "--pages", "3")
    pages = pdffile.Pdf((tmp_path / "r.pdf").read_bytes()).pages
    right = " ".join(" ".join(s.text for s in pages[0].shown()[0] if s.box[0] > 400).split())
    assert len(pages) == 1 and "Last" not in right and right.count("dài") == 200 and "Its end" in right
    (tmp_path / "broken").write_bytes(b"%PDF-1.4 nothing")
    assert do("init", tmp_path / "broken", "--dir", tmp_path / "q") == (1, f"unsupported source file:{tmp_path}/broken: the file has no catalogue of pages\n")


def test_pen():
    if not Path(fonts.SYSTEM_SETS[0][0]).exists():
        pytest.skip("needs the DejaVu fonts")
    pen = pdfdraw.Pen.of(fonts.choose(fonts.SYSTEM_SETS[:1]))
    assert pen.words("a <b>b<i>c</i></b>d<br/>e &lt;f") == [[("R", "a")], [("B", "b"), ("B", "c"), ("R", "d")], [("R", "e")], [("R", "<f")]]
    words = pen.words("one two three four five six")
    assert pen.fit(words, 500, 13, 10)[:2] == (1.0, 1.0) and pen.fit(words, 500, 11.2, 10)[:2] == (1.0, 0.95) and pen.fit(words, 500, 5, 10) is None
    assert pen.fit(pen.words("unbreakable" * 9), 50, 500, 10) is None and pen.fit([], 10, 0, 10)[2] == []
    assert len(pen.broken(words, 60, 10)) > 2 and sum(pen.broken(words, 60, 10), []) == words
    assert abs(pen.length([("R", "ab")]) - pen.length([("R", "a")]) - pen.length([("R", "b")])) < 1e-9
    assert pdfdraw.framed({"bbox": "5,5,900,20"}, (400, 600)) == (5, 5, 400, 20) and pdfdraw.framed({"bbox": "-5,5,9,20"}, (400, 600)) is None
    assert pdffile.Reader(pdfdraw.written({"A b": [1, -0.5, True, None, b"x(", pdffile.Ref(3), pdffile.Name("c#")]})).one() == {"A b": [1, -0.5, True, None, b"x(", pdffile.Ref(3), "c#"]}
