"""Progress, cost and flag reports over blocks and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER = 1_000_000
CACHE_READ_SHARE, CACHE_WRITE_SHARE = 0.1, 1.25
CHARS_PER_TOKEN = 4


def totals(blocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """blocks, done, chars, chars_left, pages of all blocks (or of each group): one pass, one aggregate."""
    left = F.col("dst_html").isNull()
    return blocks.groupBy(*(by or [])).agg(
        F.count("*").alias("blocks"), F.count("dst_html").alias("done"),
        F.coalesce(F.sum(F.length("src_html")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.when(left, F.length("src_html"))), F.lit(0)).alias("chars_left"),
        F.count_distinct(F.when(F.col("page_no") >= 0, F.col("page_no"))).alias("pages"),
    )


def complete_pages(blocks: DataFrame) -> DataFrame:
    """(book_id, pages_complete): real pages of which every block is done."""
    pages = blocks.where("page_no >= 0").groupBy("book_id", "page_no").agg(F.every(F.col("dst_html").isNotNull()).alias("whole"))
    return pages.groupBy("book_id").agg(F.count_if("whole").alias("pages_complete"))


def by_status(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("status").agg(F.count("*").alias("n"))


def tokens(chunks: DataFrame) -> DataFrame:
    """One row: the four token sums, never null."""
    return chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("in_tokens", "out_tokens", "cache_read", "cache_write")))


def by_model(chunks: DataFrame) -> DataFrame:
    used = chunks.where("provider IS NOT NULL").groupBy("provider", "model")
    return used.agg(F.count("*").alias("n"), F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("in_tokens"), F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("out_tokens")).orderBy(F.desc("n"), "provider", "model")


def by_flag(blocks: DataFrame) -> DataFrame:
    return blocks.where("flag IS NOT NULL").groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag")


def flag_samples(blocks: DataFrame, n: int = 5) -> DataFrame:
    """The first flagged blocks with where to find them: the document's name, or the page as readers count."""
    where = F.coalesce(F.get_json_object("layout", "$.href"), F.concat(F.lit("page "), (F.col("page_no") + 1).cast("string")))
    return blocks.where("flag IS NOT NULL").select("book_id", "block_id", where.alias("place"), "flag").orderBy("book_id", "block_id").limit(n)


def failures(chunks: DataFrame, n: int = 5) -> DataFrame:
    return chunks.where("status = 'failed'").select("book_id", "chunk_id", "error").orderBy("book_id", "chunk_id").limit(n)


def chunk_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("book_id", "chunk_id").agg(F.count("*").alias("blocks"), F.sum(F.length("src_html")).alias("chars"))


def cost(price_in: float, price_out: float, price_read: float | None = None, price_write: float | None = None) -> Column:
    """Price of the columns in_tokens, out_tokens, cache_read, cache_write; prices are for a million tokens."""
    read = CACHE_READ_SHARE * price_in if price_read is None else price_read
    write = CACHE_WRITE_SHARE * price_in if price_write is None else price_write
    parts = (("in_tokens", price_in), ("cache_read", read), ("cache_write", write), ("out_tokens", price_out))
    return sum((F.col(c) * F.lit(float(p)) for c, p in parts), F.lit(0.0)) / PER


def whole_cost(spent: Column, chars_all: Column, chars_left: Column) -> Column:
    """What the whole book will have cost, by characters; null unless some are done and some are left."""
    done = chars_all - chars_left
    return F.when((done > 0) & (chars_left > 0), spent * chars_all / done)


def rough_tokens(chars: Column) -> Column:
    return chars / CHARS_PER_TOKEN


def inspect(blocks: DataFrame) -> DataFrame:
    """The blocks in reading order, shortened, each page's first marked with the page as readers count."""
    from pyspark.sql import Window

    from ..functions import text as X

    w = Window.partitionBy("book_id").orderBy("page_no", "pos")
    shown = F.when(F.col("page_no") >= 0, F.col("page_no") + 1).otherwise(F.col("page_no"))
    head = F.when(F.coalesce(F.lag("page_no").over(w) != F.col("page_no"), F.lit(True)), shown)
    return blocks.select("book_id", head.alias("page_header"), "page_no", "pos", "kind", "tag", "cont_group", X.collapse(X.html_to_text(F.col("src_html"))).alias("shown"))


def inspect_totals(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.count("*").alias("blocks"), F.count_distinct("page_no").alias("pages"), F.coalesce(F.sum(F.length("src_html")), F.lit(0)).alias("chars"))


def render_totals(items: DataFrame) -> DataFrame:
    """Items, overflows, median fit (1.0 without items) and the share below 0.85, of (ratio, overflow) rows."""
    return items.agg(
        F.count("*").alias("items"), F.count_if("overflow").alias("overflows"), F.coalesce(F.median("ratio"), F.lit(1.0)).alias("median_ratio"),
        F.coalesce(F.count_if(F.col("ratio") < 0.85) * F.lit(100.0) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("percent_low"),
    )
