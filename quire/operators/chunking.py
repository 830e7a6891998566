"""Work chunks: greedy packing of ordered blocks, and the chunks that touch a page range."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_CHARS = 6000


def assign(sizes: list[int], pages: list[int], limit: int = DEFAULT_CHARS) -> list[int]:
    """Chunk number (from 0) of each block of a book, in order.

    A chunk is closed before a block that would make it larger than ``limit``, that begins another page when the
    chunk is at least half full, or that crosses between real pages and pseudo pages (below 0). A block larger than
    the limit stands alone.
    """
    out, chunk, filled, before = [], 0, 0, None
    for n, page in zip(sizes, pages):
        if before is not None:
            turned = page != before
            if filled + n > limit or (turned and (filled >= limit / 2 or page < 0 or before < 0)):
                chunk, filled = chunk + 1, 0
        out.append(chunk)
        filled, before = filled + n, page
    return out


def chunk_numbers(sizes: Column, pages: Column, limit: int = DEFAULT_CHARS) -> Column:
    """array<int> of chunk numbers for the arrays of a book's block sizes and pages: no exchange where a row holds a book."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def fold(n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else assign(list(a), list(b), limit) for a, b in zip(n, p)])

    return fold(sizes, pages)


def pack(blocks: DataFrame, limit: int = DEFAULT_CHARS) -> DataFrame:
    """``blocks`` with chunk_no: packed for each book in the order of block_id. Only sizes and pages of a book meet in a
    task; its texts stay where they are until the numbers are joined back."""
    slim = blocks.select("book_id", "block_id", "page_no", F.length("src_html").alias("n"))
    book = slim.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("block_id", "page_no", "n"))).alias("b"))
    numbered = book.select("book_id", F.col("b.block_id").alias("ids"), chunk_numbers(F.col("b.n"), F.col("b.page_no"), limit).alias("chunks"))
    flat = numbered.select("book_id", F.explode(F.arrays_zip("ids", "chunks")).alias("z")).select("book_id", F.col("z.ids").alias("block_id"), F.col("z.chunks").alias("chunk_no"))
    return blocks.join(flat, ["book_id", "block_id"])


def touching(blocks: DataFrame, first_page: int, last_page: int, chunk: str = "chunk_id") -> DataFrame:
    """(book_id, chunk, from_page, to_page): every chunk with a real page in the range, with all real pages it covers."""
    real = blocks.where("page_no >= 0").select("book_id", chunk, "page_no")
    spans = real.groupBy("book_id", chunk).agg(F.min("page_no").alias("from_page"), F.max("page_no").alias("to_page"), F.max(F.col("page_no").between(first_page, last_page)).alias("touches"))
    return spans.where("touches").drop("touches")


def coverage(touched: DataFrame) -> DataFrame:
    """One row per book: the pages that the touched chunks cover together."""
    return touched.groupBy("book_id").agg(F.min("from_page").alias("from_page"), F.max("to_page").alias("to_page"))


def page_range(spec: str | None) -> tuple[int, int] | None:
    """``"10-20"`` or ``"10"``, counted from 1, as a pair counted from 0; None for no spec."""
    if not spec:
        return None
    first, dash, last = spec.partition("-")
    try:
        a = int(first)
        b = int(last) if dash and last else a
    except ValueError:
        raise ValueError(f"pages must look like 10-20 or 10, not {spec!r}") from None
    if a < 1 or b < 1:
        raise ValueError(f"pages are counted from 1, not {spec!r}")
    return a - 1, b - 1


def page_range_columns(spec: Column) -> tuple[Column, Column]:
    """The same for a column of specs: (first, last), null where a spec is broken."""
    parts = F.split(spec, "-", 2)
    a = parts[0].try_cast("int")
    b = F.when((F.size(parts) > 1) & (F.trim(F.get(parts, F.lit(1))) != ""), F.get(parts, F.lit(1)).try_cast("int")).otherwise(a)
    fits = (a >= 1) & (b >= 1)
    return F.when(fits, a - 1), F.when(fits, b - 1)


def check_range(blocks: DataFrame, first: int, last: int) -> None:
    """Raises for a reversed range and for one outside the book: different mistakes, different messages."""
    if first > last:
        raise ValueError(f"the page range {first + 1}-{last + 1} is reversed")
    last_page = blocks.where("page_no >= 0").agg(F.max("page_no")).first()[0]
    pages = 0 if last_page is None else last_page + 1
    if first >= pages:
        raise ValueError(f"the page range {first + 1}-{last + 1} is outside the book: it has {pages} pages")
