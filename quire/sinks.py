"""Sinks: books and reports out of block tables."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import pdfdraw
from .fonts import FontSet
from .functions import text as X
from .operators import layout, packing
from .schemas import TITLE_PAGE, TOC_PAGE
from .sources import html as html_source


class UnsupportedTarget(ValueError):
    """No sink of this kind, or an option that it hasn't."""


PDF_MODES = ("overlay", "reflow")


def output_name(fmt: str, bilingual: bool = False) -> str:
    return f"output.{'bilingual' if bilingual else 'vi'}.{fmt}"


def write(fmt: str, writer: dict[str, Callable], *args, mode: str | None = None, pages=None, dry_run: bool = False, probe: bool = False, **kw):
    """Gives the work to the sink of the format, after checking that it has the options."""
    if fmt not in writer:
        raise UnsupportedTarget(f"no sink for {fmt!r}")
    if fmt == "epub" and (mode or pages or dry_run or probe):
        raise UnsupportedTarget("an EPUB is written whole: no mode, pages, dry run or probe page")
    if fmt == "pdf" and mode not in (None, *PDF_MODES):
        raise UnsupportedTarget(f"no mode {mode!r}; there are {', '.join(PDF_MODES)}")
    options = {} if fmt == "epub" else {"mode": mode or PDF_MODES[0], "pages": pages, "dry_run": dry_run, "probe": probe}
    return writer[fmt](*args, **options, **kw)


def epub_parts(blocks: DataFrame) -> DataFrame:
    """(book_id, href, targets map<pos, html>): of every document, the contents (href ``toc``) and the title (``title``, without tags)."""
    href = F.when(F.col("page_no") == TOC_PAGE, "toc").when(F.col("page_no") == TITLE_PAGE, "title").otherwise(F.get_json_object("layout", "$.href"))
    target = F.when(F.col("page_no") == TITLE_PAGE, X.html_to_text(F.col("dst_html"))).otherwise(F.col("dst_html"))
    rows = blocks.where("dst_html IS NOT NULL").select("book_id", href.alias("href"), "pos", target.alias("dst")).dropDuplicates(["book_id", "href", "pos"])
    return rows.groupBy("book_id", "href").agg(F.map_from_entries(F.collect_list(F.struct("pos", "dst"))).alias("targets"))


def _retitled(package: str, title: str | None) -> str:
    """A package document in the target language, with the title where there is one."""
    out = re.sub(r"(<(?:\w+:)?language\b[^>]*>)[^<]*(</)", r"\g<1>vi\g<2>", package)
    return out if title is None else re.sub(r"(<(?:\w+:)?title\b[^>]*>)[^<]*(</)", lambda m: f"{m[1]}{html.escape(title, quote=False)}{m[2]}", out, count=1)


def _relabelled(contents: str, titles: dict[int, str]) -> str:
    """The contents' labels replaced by their place among all labels (of a list of points, or of the links of a navigation page)."""
    place = iter(range(1 << 30))
    at = re.compile(r"(<navLabel\b[^>]*>\s*<text\b[^>]*>)(.*?)(</text>)", re.S) if "<navLabel" in contents else re.compile(r"(<(?:a|span)\b[^>]*>)(.*?)(</(?:a|span)>)", re.S)
    return at.sub(lambda m: m[1] + titles.get(next(place), m[2]) + m[3], contents)


def epub_books(files: DataFrame, parts: DataFrame, bilingual: bool = False) -> DataFrame:
    """(book_id, content): EPUB files (path, content) with targets put back into documents, contents and title, in the target
    language; a task holds one book."""
    from .sources.epub import Book

    by_book = parts.groupBy("book_id").agg(F.collect_list(F.struct("href", "targets")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                told = {p["href"]: dict(p["targets"]) for p in r["parts"] or ()}
                book, out = Book(r["content"]), io.BytesIO()
                names = {book.path(h): h for h in book.documents()}
                lists = {book.path(x["href"]) for x in (book.ncx, book.nav) if x is not None}
                with zipfile.ZipFile(out, "w") as z:
                    for info in book.zip.infolist():
                        data = book.zip.read(info)
                        if told.get(names.get(info.filename)):
                            data = html_source.put_back(data.decode("utf-8", "replace"), told[names[info.filename]], bilingual).encode()
                        elif info.filename == book.package:
                            data = _retitled(data.decode("utf-8", "replace"), told.get("title", {}).get(0)).encode()
                        elif info.filename in lists and told.get("toc"):
                            data = _relabelled(data.decode("utf-8", "replace"), told["toc"]).encode()
                        z.writestr(info, data, zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), pa.array([out.getvalue()], pa.binary())], ["book_id", "content"])

    joined = files.join(by_book, files["path"] == by_book["book_id"], "left").select("path", "content", "parts")
    return joined.mapInArrow(run, "book_id string, content binary")


def draw_pages(items: DataFrame, build: Callable[[], Callable[[dict], tuple[bytes, list[tuple[int, float, bool]]]]]) -> DataFrame:
    """(book_id, page_no, content, stats array<struct<block_id, ratio, overflow>>) of page rows (pdf_items). ``build`` is made once
    a task and turns a page's row into its drawing and what became of its items: any drawing library can stand behind it."""
    schema = "book_id string, page_no int, content binary, stats array<struct<block_id: bigint, ratio: double, overflow: boolean>>"
    stat = pa.list_(pa.struct([("block_id", pa.int64()), ("ratio", pa.float64()), ("overflow", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = build()
        for b in batches:
            rows = b.to_pylist()
            done = [draw(r) for r in rows]
            told = [[dict(zip(("block_id", "ratio", "overflow"), s)) for s in stats] for _, stats in done]
            yield pa.RecordBatch.from_arrays([pa.array([r["book_id"] for r in rows], pa.string()), pa.array([r["page_no"] for r in rows], pa.int32()), pa.array([c for c, _ in done], pa.binary()), pa.array(told, stat)], ["book_id", "page_no", "content", "stats"])

    return items.mapInArrow(run, schema)


def pdf_items(blocks: DataFrame, pages: DataFrame, dry_run: bool = False) -> DataFrame:
    """What a page builder draws: every page of ``pages`` (also those without blocks) with its items in order. Open blocks show
    their source; a dry run shows it lengthened, as a stand-in for a target."""
    shown = X.pad_text(F.col("src_html")) if dry_run else F.coalesce("dst_html", "src_html")
    rows = blocks.where("kind <> 'skip' AND bbox IS NOT NULL").withColumn("shown", shown)
    size = [F.get_json_object("layout", "$.size").cast("double").alias("size")] if "layout" in blocks.columns else []
    done = F.lit(True) if dry_run else F.col("dst_html").isNotNull()
    item = F.struct("pos", "block_id", "bbox", "shown", "kind", done.alias("done"), *size)
    return pages.join(rows.groupBy("book_id", "page_no").agg(F.sort_array(F.collect_list(item)).alias("items")), ["book_id", "page_no"], "left")


def reflow_items(blocks: DataFrame, pages: DataFrame, dry_run: bool = False) -> DataFrame:
    """The same with the place of every item on a white page (left, top, right, height): at the largest scale at which all of a page's
    items fit by a rough measure; null where there is none, and the item is drawn in its own frame."""
    items = pdf_items(blocks, pages, dry_run).select("book_id", "page_no", "page_width", "page_height", F.explode("items").alias("i")).select("book_id", "page_no", "page_width", "page_height", "i.*")
    edge = F.split("bbox", ",")
    boxed = items.withColumns({c: edge[k].cast("double") for k, c in enumerate(("x0", "y0", "x1", "y1"))}).join(layout.column_body_size(blocks), "book_id")
    placed = packing.place_pages(boxed.withColumn("ord", F.col("pos")).withColumn("html", X.strip_tags(F.col("shown"))).withColumn("size", F.coalesce("size", F.lit(layout.DEFAULT_SIZE))))
    fits = lambda c: F.when(F.col("scale").isNotNull(), F.col(c)).alias(c)
    item = F.struct("pos", "block_id", "bbox", "shown", "kind", "done", (packing.font_size(F.col("kind"), F.col("size"), F.col("body_size")) * F.coalesce("scale", F.lit(1.0))).alias("size"), *map(fits, ("left", "top", "right", "height")))
    return placed.groupBy("book_id", "page_no").agg(F.sort_array(F.collect_list(item)).alias("items"))


DRAWN = "book_id string, content binary, stats array<struct<page_no: int, block_id: bigint, ratio: double, overflow: boolean>>"


def pdf_books(files: DataFrame, items: DataFrame, fonts: FontSet, mode: str = "overlay", pages: tuple[int, int] | None = None, report: list[str] | None = None) -> DataFrame:
    """(book_id, content, stats): PDF files (path, content) as double pages, the source beside its translation. ``items`` has the rows of
    pdf_items or reflow_items; a task holds one book. The fonts' files have to be where the tasks run."""
    by_book = items.where("items IS NOT NULL").groupBy("book_id").agg(F.collect_list(F.struct("page_no", "items")).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(drawn)
        for b in batches:
            for r in b.to_pylist():
                content, stats = pdfdraw.draw_book(r["content"], {p["page_no"]: p["items"] for p in r["pages"] or ()}, fonts, mode, pages, report or ())
                yield pa.RecordBatch.from_pylist([{"book_id": r["path"], "content": content, "stats": [dict(zip(("page_no", "block_id", "ratio", "overflow"), s)) for s in stats]}], schema=kind)

    drawn = T.StructType.fromDDL(DRAWN)
    return files.join(by_book, files["path"] == by_book["book_id"], "left").select("path", "content", "pages").mapInArrow(run, DRAWN)


def overlay_decision(target_fits: Column, usable: Column, has_target: Column) -> Column:
    """Of an item over the page's own image: replace, or keep the source (unusable frame, no target, or no fit)."""
    return F.when(~usable, "skip").when(~has_target, "keep").when(target_fits, "replace").otherwise("overflow")


def spreads(pages: DataFrame) -> DataFrame:
    """(book_id, page_no, width, height, label, label_x, label_y): double pages, the source on the left, the page's number between."""
    label = (F.col("page_no") + 1).cast("string")
    return pages.select("book_id", "page_no", (2 * F.col("page_width")).alias("width"), F.col("page_height").alias("height"), label.alias("label"), (F.col("page_width") - F.length(label) * 7.0 * 0.6 / 2).alias("label_x"), (F.col("page_height") - 6).alias("label_y"))


def report_lines(items: DataFrame, samples: int = 20) -> DataFrame:
    """(line) of a probe page: counts, the share of tight items, and the first overflows."""
    from .operators.status import render_totals

    head = render_totals(items).select(F.explode(F.array(F.format_string("items: %d", "items"), F.format_string("overflows: %d", "overflows"), F.format_string("median ratio: %.0f%%", F.col("median_ratio") * 100), F.format_string("below 85%%: %.0f%%", "percent_low"))).alias("line"))
    worst = items.where("overflow").orderBy("page_no", "block_id").limit(samples).select(F.format_string("page %d, block %d", F.col("page_no") + 1, "block_id").alias("line"))
    return head.unionAll(worst)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines of one text column as a text file."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
