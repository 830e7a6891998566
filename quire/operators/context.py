"""What stands before a chunk: the last done blocks, oldest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE, TAIL = 3, 600


def previous_rows(df: DataFrame, keys: list[str], order: list[str], value: Column, n: int = BEFORE) -> DataFrame:
    """``df`` with before: the values of up to n rows before each, oldest first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    return df.withColumn("before", F.collect_list(value).over(w))


def chunk_context(blocks: DataFrame, n: int = BEFORE) -> DataFrame:
    """(book_id, chunk_id, block_id, dst_html, age): for each chunk, the n last done blocks of real pages before its first.

    Done blocks and chunk heads are laid in one order per book, and each head takes the n latest from a running window:
    no join on an inequality.
    """
    done = blocks.where("dst_html IS NOT NULL AND page_no >= 0").select("book_id", "block_id", "dst_html", F.lit(None).cast("bigint").alias("chunk_id"))
    heads = blocks.where("chunk_id IS NOT NULL").groupBy("book_id", "chunk_id").agg(F.min("block_id").alias("block_id")).select("book_id", "block_id", F.lit(None).cast("string").alias("dst_html"), "chunk_id")
    # A head sorts before the block of the same number; only done rows enter the running list.
    w = Window.partitionBy("book_id").orderBy("block_id", F.col("chunk_id").isNull())
    both = done.unionByName(heads).withColumn("k", F.count("dst_html").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    numbered = both.where("dst_html IS NOT NULL").select("book_id", "k", "block_id", "dst_html")
    wanted = both.where("chunk_id IS NOT NULL").select("book_id", "chunk_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("age"), "k").withColumn("k", F.col("k") - F.col("age") + 1)
    return wanted.join(numbered, ["book_id", "k"]).select("book_id", "chunk_id", "block_id", "dst_html", "age")


def context_text(found: DataFrame) -> DataFrame:
    """(book_id, chunk_id, context): the visible tails, oldest first, a line each."""
    from ..functions import text as X

    rows = found.select("book_id", "chunk_id", F.struct(F.col("block_id"), X.plain_tail(F.col("dst_html"), TAIL).alias("t")).alias("x"))
    return rows.groupBy("book_id", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("context"))
