"""PDF pages: from positioned spans (or recognised text) to paragraphs and blocks.

``pdffile`` reads a file's objects in the tasks; recognising text needs a library, which stands behind a function that a caller
gives. What they return are rows, and all rules on them are DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..operators import geometry, layout
from . import binary_files, pdffile, reader

COVER = 0.9
OCR_TILT, OCR_UPRIGHT, OCR_SIZE = 10.0, 1.5, 0.80


def page_lines(spans: DataFrame) -> DataFrame:
    """Lines of (book_id, page_no, line_no, span_no, text, font, size, block_type, dx, dy, x0..y1): images, rotated and blank
    lines dropped, spans merged."""
    flat = spans.where((F.col("block_type") == 0) & layout.near_horizontal(F.col("dx"), F.col("dy")))
    lines = layout.merge_spans(flat).where(X.strip(F.col("text")) != "")
    return lines.withColumnRenamed("line_no", "seq").withColumn("col", F.lit(0)).withColumn("end_para", F.lit(False))


def scanned_pages(images: DataFrame) -> DataFrame:
    """(book_id, page_no, scanned) of image boxes (x0..y1, in display space) with page_width and page_height."""
    w = F.greatest(F.lit(0.0), F.least("x1", "page_width") - F.greatest("x0", F.lit(0.0)))
    h = F.greatest(F.lit(0.0), F.least("y1", "page_height") - F.greatest("y0", F.lit(0.0)))
    covers = (w > 0) & (h > 0) & (w * h >= F.lit(COVER) * F.col("page_width") * F.col("page_height"))
    return images.groupBy("book_id", "page_no").agg(F.bool_or(covers).alias("scanned"))


def ocr_lines(results: DataFrame, scale: Column | float) -> DataFrame:
    """Lines of recognised text: (book_id, page_no, seq, quad array<array<double>>, text). Blank, tilted and upright texts go; the
    box is that of the four corners in points, the size four fifths of its height."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    q = F.col("quad")
    dx, dy = q[1][0] - q[0][0], q[1][1] - q[0][1]
    xs, ys = F.transform(q, lambda p: p[0] * s), F.transform(q, lambda p: p[1] * s)
    t = X.strip(F.coalesce("text", F.lit("")))
    rows = results.where((t != "") & (F.abs(F.degrees(F.atan2(dy, dx))) < OCR_TILT)).select(
        "book_id", "page_no", "seq", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), t.alias("text")
    )
    height = F.col("y1") - F.col("y0")
    upright = (F.length("text") >= 3) & (height > F.lit(OCR_UPRIGHT) * (F.col("x1") - F.col("x0")))
    return rows.where(~upright).select("*", X.escape_html(F.col("text")).alias("html"), (F.lit(OCR_SIZE) * height).alias("size"), F.lit(0).alias("col"), F.lit(False).alias("end_para"))


def recognise(rasters: DataFrame, engine: Callable[[], Callable[[bytes, int, int], list]]) -> DataFrame:
    """(book_id, page_no, seq, quad, text, score) of page images; ``engine`` is made once a task and gives [(quad, text, score)]."""
    schema = "book_id string, page_no int, seq int, quad array<array<double>>, text string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = engine()
        for b in batches:
            rows = [(r["book_id"], r["page_no"], i, *x) for r in b.to_pylist() for i, x in enumerate(read(r["gray"], r["width"], r["height"]) or [])]
            cols = zip(*rows) if rows else [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in schema.split(", ")])

    return rasters.select("book_id", "page_no", "gray", "width", "height").mapInArrow(run, schema)


def text_paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs of text pages: columns, order, grouping."""
    ordered = layout.reading_order(geometry.detect_columns(lines))
    return layout.paragraphs(layout.paragraph_numbers(ordered))


def scan_paragraphs(lines: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """Paragraphs of scanned pages: figure noise out, columns by rows, fragments and page numbers joined, bands grouped apart."""
    if figures is not None:
        lines = geometry.drop_figure_noise(lines, figures)
    sized = geometry.detect_columns(lines, scanned=True)
    pages = sized.groupBy("book_id", "page_no").agg(F.first("page_height").alias("page_height"))
    keyed = layout.merge_fragments(sized, F.col("page_height")).join(pages, ["book_id", "page_no"])
    attached = geometry.attach_numbers(keyed).join(pages, ["book_id", "page_no"])
    ordered = layout.reading_order(attached).withColumn("band", layout.band(F.col("y0"), F.col("page_height")))
    return layout.paragraphs(layout.paragraph_numbers(ordered, part="band"), part="band").drop("band")


def book_blocks(paras: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of paragraphs: kinds first, then running heads, then continuations, which take text only."""
    kinds = layout.mark_running(layout.classify(paras), pages)
    return layout.to_blocks(layout.link_continuations(kinds, ["page_no", "para_seq"], takes=F.col("kind") == "text"))


def load(spans: DataFrame, images: DataFrame, pages: DataFrame, rasters: DataFrame | None = None, engine: Callable[[], Any] | None = None) -> DataFrame:
    """Blocks of books from page rows. Text recognition runs only for books that have scanned pages and gave no paragraph at
    all from their text. ``pages``: book_id, page_no, page_width, page_height, n_pages."""
    sizes = pages.select("book_id", "page_no", "page_width", "page_height")
    lines = page_lines(spans).join(sizes, ["book_id", "page_no"])
    scanned = scanned_pages(images)
    marked = lines.join(scanned, ["book_id", "page_no"], "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    paras = text_paragraphs(marked.where("NOT scanned").drop("scanned")).unionByName(scan_paragraphs(marked.where("scanned").drop("scanned")))
    heads = pages.groupBy("book_id").agg(F.first("n_pages").alias("n_pages"), F.min_by("page_height", "page_no").alias("page_height"))
    if rasters is not None and engine is not None:
        empty = scanned.where("scanned").select("book_id").distinct().join(paras.select("book_id").distinct(), "book_id", "left_anti")
        todo = rasters.join(empty, "book_id", "left_semi")
        scale = todo.select("book_id", "page_no", "scale")
        found = ocr_lines(recognise(todo, engine).join(scale, ["book_id", "page_no"]), F.col("scale")).join(sizes, ["book_id", "page_no"])
        paras = paras.unionByName(scan_paragraphs(found))
    return book_blocks(paras, heads)


PAGES = (
    "book_id string, page_no int, page_width double, page_height double, n_pages int, "
    "spans array<struct<line_no: int, span_no: int, text: string, font: string, size: double, dx: double, dy: double, x0: double, y0: double, x1: double, y1: double>>, "
    "images array<struct<x0: double, y0: double, x1: double, y1: double>>, error string"
)


SPAN = ("line_no", "span_no", "text", "font", "size", "dx", "dy", "x0", "y0", "x1", "y1")


def file_pages(files: DataFrame) -> DataFrame:
    """One row a page of PDF files (path, content), with its size, spans and image boxes; a file that can't be read raises, with
    its path and why. A task holds one file at a time and gives its pages one by one."""
    kind = to_arrow_schema(T.StructType.fromDDL(PAGES))

    def rows(path: str, content: bytes) -> Iterator[dict]:
        try:
            pages = pdffile.Pdf(content).pages
            for n, page in enumerate(pages):
                spans, images = page.shown()
                told = [(i, k, s.text, s.font, s.size, *s.dir, *s.box) for i, line in enumerate(pdffile.lines_of(spans)) for k, s in enumerate(line)]
                yield {"book_id": path, "page_no": n, "page_width": page.size[0], "page_height": page.size[1], "n_pages": len(pages), "spans": [dict(zip(SPAN, x)) for x in told], "images": [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in images], "error": None}
        except pdffile.BrokenPdf as e:
            yield {"book_id": path, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                for row in rows(path.as_py(), content.as_py() or b""):
                    yield pa.RecordBatch.from_pylist([row], schema=kind)

    found = files.select("path", "content").mapInArrow(run, PAGES)
    message = F.concat(F.lit("unsupported source "), F.col("book_id"), F.lit(": "), F.col("error"))
    return found.withColumn("page_no", F.when(F.col("error").isNotNull(), F.raise_error(message).cast("int")).otherwise(F.col("page_no"))).drop("error")


def tables(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, images, pages) of ``file_pages``, as ``load`` takes them. Page rows are exchanged, so that a book's pages are worked on by
    several tasks, and kept (in memory, else on disk; a lost part is read anew), as each table is read more than once and a file is
    to be parsed once. ``spark.catalog.clearCache()`` lets go of them."""
    dealt = found.repartition("book_id", "page_no").persist(StorageLevel.MEMORY_AND_DISK)
    spans = dealt.select("book_id", "page_no", F.explode("spans").alias("s")).select("book_id", "page_no", "s.*", F.lit(0).alias("block_type"))
    images = dealt.select("book_id", "page_no", "page_width", "page_height", F.explode("images").alias("i")).select("book_id", "page_no", "i.*", "page_width", "page_height")
    return spans, images, dealt.select("book_id", "page_no", "page_width", "page_height", "n_pages")


@reader("pdf")
def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of the PDF files at ``path``. Books that only have scanned pages need a text recognition engine: ``load`` takes one."""
    files = binary_files(spark, path).where(F.substring("content", 1, 4) == F.lit(b"%PDF"))
    return load(*tables(file_pages(files)))
