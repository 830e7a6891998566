"""EPUB books: manifest, spine and table of contents, and their blocks."""

from __future__ import annotations

import html as H
import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TITLE_PAGE, TOC_PAGE
from . import binary_files, reader
from . import html as html_source

BLOCKS = "book_id string, page_no int, pos int, tag string, kind string, src_html string, layout string, href string"
NAV = "nav"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Book:
    """A book's package: documents in reading order, contents, title."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        box = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        self.package = next(e.attrib["full-path"] for e in box.iter() if _local(e.tag) == "rootfile")
        self.base = posixpath.dirname(self.package)
        root = ElementTree.fromstring(self.zip.read(self.package))
        self.items = {e.attrib["id"]: e.attrib for e in root.iter() if _local(e.tag) == "item"}
        self.spine = [e.attrib["idref"] for e in root.iter() if _local(e.tag) == "itemref"]
        self.title = next((e.text or "" for e in root.iter() if _local(e.tag) == "title"), "")
        self.ncx = next((a for a in self.items.values() if a.get("media-type") == "application/x-dtbncx+xml"), None)
        self.nav = next((a for a in self.items.values() if NAV in a.get("properties", "").split()), None)

    def path(self, href: str) -> str:
        return posixpath.normpath(posixpath.join(self.base, unquote(href.partition("#")[0])))

    def documents(self) -> list[str]:
        """Names of the content documents: those of the spine in its order, then the others; each once, navigation left out."""
        content = {i: a["href"] for i, a in self.items.items() if a.get("media-type") in ("application/xhtml+xml", "text/html") and a is not self.nav}
        names = [content[i] for i in self.spine if i in content] + list(content.values())
        return list(dict.fromkeys(names))

    def read(self, href: str) -> str:
        return self.zip.read(self.path(href)).decode("utf-8", "replace")

    def contents(self) -> list[str]:
        """Titles of the table of contents, a section before what it holds."""
        if self.ncx is not None:
            root = ElementTree.fromstring(self.zip.read(self.path(self.ncx["href"])))
            points = (e for e in root.iter() if _local(e.tag) == "navPoint")  # document order is pre-order
            return ["".join(next((l.itertext() for l in p if _local(l.tag) == "navLabel"), ())).strip() for p in points]
        if self.nav is not None:
            root = ElementTree.fromstring(self.zip.read(self.path(self.nav["href"])))
            toc = next((e for e in root.iter() if _local(e.tag) == "nav"), root)
            return ["".join(e.itertext()).strip() for li in toc.iter() if _local(li.tag) == "li" for e in li if _local(e.tag) in ("a", "span")]
        return []

    def blocks(self) -> list[tuple[int, int, str, str, str]]:
        """(page, pos, tag, html, href) of all documents, then the contents (page -1) and the title (-2), with letters only."""
        out = [(n, pos, tag, inner, href) for n, href in enumerate(self.documents()) for pos, tag, inner, _ in html_source.blocks_of(self.read(href))]
        out += [(TOC_PAGE, i, "toc", H.escape(t, quote=False), "") for i, t in enumerate(self.contents()) if any(map(str.isalpha, t))]
        if any(map(str.isalpha, self.title)):
            out.append((TITLE_PAGE, 0, "title", H.escape(self.title, quote=False), ""))
        return out


@reader("epub")
def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all EPUB books under ``path``; book_id is the file's path. A task holds one book at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(name, p, pos, tag, "text", inner, None, href) for p, pos, tag, inner, href in Book(data.as_py()).blocks()]
                cols = zip(*rows) if rows else [()] * 8
                types = [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in BLOCKS.split(", ")])

    files = binary_files(spark, path).where(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")).select("path", "content")
    return files.mapInArrow(run, BLOCKS).withColumn("layout", F.when(F.col("href") != "", F.to_json(F.struct("href")))).drop("href")


# ---- the same rules over tables of manifests -----------------------------------------------------------------


def ordered_documents(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """(book_id, name, place): documents of ``spine`` (book_id, item_id, place) first, then the others of ``manifest`` (book_id,
    item_id, name, media_type, properties, seq) in their order; of one name the first."""
    content = manifest.where("media_type IN ('application/xhtml+xml', 'text/html') AND NOT array_contains(split(coalesce(properties, ''), ' '), 'nav')")
    ranked = content.join(spine.select("book_id", "item_id", "place"), ["book_id", "item_id"], "left")
    order = F.struct(F.col("place").isNull(), F.coalesce("place", "seq"))
    first = ranked.groupBy("book_id", "name").agg(F.min(order).alias("o"))
    return first.select("book_id", "name", (F.row_number().over(Window.partitionBy("book_id").orderBy("o")) - 1).alias("place"))


def flatten_contents(entries: DataFrame) -> DataFrame:
    """(book_id, entry_id, title, depth, place) of trees of contents (book_id, entry_id, parent_id, ord, title), sections before
    what they hold, neighbours by ord and then id. A task walks one book's tree at a time, however deep or long; entries that no root
    leads to aren't in it."""
    kinds = dict(entries.dtypes)

    def walk(book: pa.Table) -> pa.Table:
        below: dict = {}
        ids, parents, titles, ords = (book.column(c).to_pylist() for c in ("entry_id", "parent_id", "title", "ord"))
        for row, up in enumerate(parents):
            below.setdefault(up, []).append(row)
        for rows in below.values():
            rows.sort(key=lambda r: (ords[r] is not None, ords[r], ids[r]), reverse=True)  # the next one lies on top
        stack, out = [(r, 0) for r in below.pop(None, ())], []
        while stack:
            row, depth = stack.pop()
            out.append((row, depth))
            stack += [(r, depth + 1) for r in below.pop(ids[row], ())]
        taken = book.take(pa.array([r for r, _ in out], pa.int64()))
        return pa.table([taken.column("book_id"), taken.column("entry_id"), taken.column("title"), pa.array([d for _, d in out], pa.int32()), pa.array(range(len(out)), pa.int64())], names=["book_id", "entry_id", "title", "depth", "place"])

    rows = entries.select("book_id", "entry_id", "parent_id", F.col("ord").cast("long").alias("ord"), "title")
    return rows.groupBy("book_id").applyInArrow(walk, f"book_id {kinds['book_id']}, entry_id {kinds['entry_id']}, title {kinds['title']}, depth int, place long")
