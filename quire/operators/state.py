"""Book state as snapshots: inserts, updates, resets and upserts make new tables, which replace the old ones whole.

Plain Parquet has no MERGE, and a table can't be overwritten while it is read; a snapshot is written beside the old one
and a small pointer table says which is current, so a run that stops anywhere leaves one that is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION

ATTEMPTS = 3


def append_blocks(existing: DataFrame | None, new: DataFrame, order: list[str]) -> DataFrame:
    """New blocks with ids after the largest of their book, in the given order; never by partition."""
    w = Window.partitionBy("book_id").orderBy(*order)
    if existing is None:
        return new.withColumn("block_id", F.row_number().over(w).cast("long"))
    last = existing.groupBy("book_id").agg(F.max("block_id").alias("_last"))
    numbered = new.join(last, "book_id", "left").withColumn("block_id", F.row_number().over(w) + F.coalesce("_last", F.lit(0))).drop("_last")
    return existing.unionByName(numbered, allowMissingColumns=True)


def update_blocks(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Blocks with dst_html and flag of ``changes`` (book_id, block_id, dst_html, flag) where they have a row; unknown ids
    are passed over."""
    new = changes.select("book_id", "block_id", F.col("dst_html").alias("_dst"), F.col("flag").alias("_flag"), F.lit(True).alias("_hit"))
    out = blocks.join(new, ["book_id", "block_id"], "left")
    hit = F.col("_hit").isNotNull()
    return out.withColumn("dst_html", F.when(hit, F.col("_dst")).otherwise(F.col("dst_html"))).withColumn("flag", F.when(hit, F.col("_flag")).otherwise(F.col("flag"))).drop("_dst", "_flag", "_hit")


def edit_block(blocks: DataFrame, book_id: str, block_id: int, html: str) -> DataFrame:
    """One block's target by hand; its flag goes. An empty target is refused."""
    if not html.strip():
        raise ValueError("an empty target isn't the same as none; reset the block instead")
    this = (F.col("book_id") == book_id) & (F.col("block_id") == block_id)
    return blocks.withColumn("dst_html", F.when(this, F.lit(html)).otherwise(F.col("dst_html"))).withColumn("flag", F.when(~this, F.col("flag")))


def reset_range(blocks: DataFrame, chunks: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Done blocks of a page range without target and flag, and their chunks pending again with no error and nothing spent."""
    inside = F.col("page_no").between(first, last) & F.col("dst_html").isNotNull()
    cleared = blocks.withColumn("_in", inside).withColumn("dst_html", F.when(~F.col("_in"), F.col("dst_html"))).withColumn("flag", F.when(~F.col("_in"), F.col("flag"))).drop("_in")
    hit = blocks.where(inside & F.col("chunk_id").isNotNull()).select("book_id", "chunk_id").distinct().withColumn("_hit", F.lit(True))
    told = chunks.join(hit, ["book_id", "chunk_id"], "left")
    hit_col = F.col("_hit").isNotNull()
    zero = {c: F.when(hit_col, F.lit(0)).otherwise(F.col(c)).cast("long") for c in ("in_tokens", "out_tokens", "cache_read", "cache_write")}
    renewed = told.withColumn("status", F.when(hit_col, "pending").otherwise(F.col("status"))).withColumn("error", F.when(~hit_col, F.col("error"))).withColumns(zero)
    return cleared, renewed.drop("_hit")


def reset_preview(blocks: DataFrame, chunks: DataFrame, first: int, last: int) -> DataFrame:
    """One row: the targets and chunks that a reset would take back, and the tokens spent on them."""
    inside = blocks.where(F.col("page_no").between(first, last) & F.col("dst_html").isNotNull())
    hit = chunks.join(inside.select("book_id", "chunk_id").distinct(), ["book_id", "chunk_id"], "left_semi")
    zero = [F.lit(0).cast("long").alias(c) for c in ("chunks", "in_tokens", "out_tokens")]
    spent = hit.select(F.lit(0).cast("long").alias("targets"), F.lit(1).cast("long").alias("chunks"), "in_tokens", "out_tokens")
    both = inside.select(F.lit(1).cast("long").alias("targets"), *zero).unionByName(spent)
    return both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("targets", "chunks", "in_tokens", "out_tokens")))


def overflow_flags(blocks: DataFrame, overflows: DataFrame, first: int, last: int) -> DataFrame:
    """Old overflow flags of a page range go; new ones are set where a block has no flag."""
    new = overflows.select("book_id", "block_id").distinct().withColumn("_over", F.lit(True))
    kept = F.when((F.col("flag") == "overflow") & F.col("page_no").between(first, last), F.lit(None)).otherwise(F.col("flag"))
    return blocks.join(new, ["book_id", "block_id"], "left").withColumn("flag", F.coalesce(kept, F.when(F.col("_over"), "overflow"))).drop("_over")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """``table`` with the last of ``changes`` (by ``seq``) for each key in the place of its own row."""
    old = table.withColumn("_new", F.lit(0)).withColumn("_seq", F.lit(0).cast("long"))
    new = changes.withColumn("_new", F.lit(1)).withColumn("_seq", (F.col(seq) if seq else F.lit(0)).cast("long")).select(old.columns)
    values = [c for c in table.columns if c not in keys]
    last = old.unionByName(new).groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_new", "_seq")).alias("v"))
    return last.select(*keys, "v.*").select(table.columns)


def migrate_v1(blocks: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Version 1 blocks (doc_index, doc_href) as version 2: page_no, kind, layout as JSON, and what is new as null."""
    moved = blocks.withColumnRenamed("doc_index", "page_no").withColumn("layout", F.to_json(F.struct(F.col("doc_href").alias("href")))).drop("doc_href")
    moved = moved.withColumn("kind", F.lit("text")).withColumn("bbox", F.lit(None).cast("string")).withColumn("line_bboxes", F.lit(None).cast("string")).withColumn("cont_group", F.lit(None).cast("int"))
    books = blocks.select("book_id").distinct().select("book_id", F.lit("schema_version").alias("key"), F.lit(str(SCHEMA_VERSION)).alias("value"))
    return moved, upsert(meta, books.select(meta.columns), ["book_id", "key"])


def version_of(blocks: DataFrame, meta: DataFrame) -> int:
    """The stored schema version, or what the shape of the table says where none is stored; newer ones are refused."""
    stored = meta.where("key = 'schema_version'").agg(F.max(F.col("value").cast("int"))).first()[0]
    found = stored if stored is not None else (1 if "doc_index" in blocks.columns else SCHEMA_VERSION)
    if found > SCHEMA_VERSION:
        raise ValueError(f"schema version {found} is newer than this engine's ({SCHEMA_VERSION})")
    return found


def get_meta(meta: DataFrame, book_id: str, key: str) -> str | None:
    row = meta.where((F.col("book_id") == book_id) & (F.col("key") == key)).select("value").first()
    return None if row is None else row[0]


# ---- resumable work ------------------------------------------------------------------------------------------


def pending_chunks(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks that aren't done, in order; ``limit`` is the caller's first N."""
    out = chunks.where("status <> 'done'").orderBy("book_id", "chunk_id")
    return out if limit is None else out.limit(limit)


def pending_in_pages(chunks: DataFrame, touched: DataFrame) -> DataFrame:
    return pending_chunks(chunks).join(touched.select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_semi")


def pending_blocks(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    return blocks.where("dst_html IS NULL").join(chunks.where("status <> 'done'").select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_semi")


def settle(answers: DataFrame, last: bool) -> DataFrame:
    """(book_id, chunk_id, block_id, dst, flag): what is taken of the answers (with flag, action and attempt) of several attempts: the
    first that is fine or advisory; when no attempt is left (``last``), else the latest one, if it has any text."""
    told = F.struct("dst", "flag")
    good = F.col("action").isin("accept", "advise")
    best = answers.groupBy("book_id", "chunk_id", "block_id").agg(F.min_by(told, F.when(good, F.col("attempt"))).alias("good"), F.count_if(good).alias("n"), F.max_by(told, "attempt").alias("latest"))
    chosen = best.withColumn("t", F.when(F.col("n") > 0, F.col("good")).when(F.lit(last) & ~F.col("latest.flag").eqNullSafe("empty"), F.col("latest")))
    return chosen.where("t IS NOT NULL").select("book_id", "chunk_id", "block_id", "t.dst", "t.flag")


def finalise(chunks: DataFrame, blocks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks after a run. ``ledger`` has a row for every attempt: book_id, chunk_id, provider, model, error, truncated, usage.

    A chunk is done when no block of it is left open, else failed, with the last attempt's error or what it left open and whether
    its answer was cut; attempts and tokens are added, missing usage counts 0.
    """
    left = blocks.where("chunk_id IS NOT NULL").groupBy("book_id", "chunk_id").agg(F.count_if(F.col("dst_html").isNull()).alias("_left"))
    spent = ledger.groupBy("book_id", "chunk_id").agg(
        F.count("*").alias("_tries"), F.max_by("provider", "attempt").alias("_p"), F.max_by("model", "attempt").alias("_m"), F.max_by("error", "attempt").alias("_e"), F.max_by("truncated", "attempt").alias("_cut"),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(f"_{c}") for c in ("in_tokens", "out_tokens", "cache_read", "cache_write")),
    )
    out = chunks.join(spent, ["book_id", "chunk_id"], "left").join(left, ["book_id", "chunk_id"], "left")
    tried, done = F.col("_tries").isNotNull(), F.coalesce("_left", F.lit(0)) == 0
    out = out.withColumn("status", F.when(tried & done, "done").when(tried, "failed").otherwise(F.col("status")))
    out = out.withColumn("error", F.when(tried & done, F.lit(None)).when(tried, F.coalesce("_e", F.concat(F.format_string("attempt %d: %d segments missing or wrong", "_tries", "_left"), F.when(F.col("_cut"), " (the answer was cut at the token limit; a smaller chunk size helps)").otherwise("")))).otherwise(F.col("error")))
    out = out.withColumn("attempts", (F.coalesce("attempts", F.lit(0)) + F.coalesce("_tries", F.lit(0))).cast("int"))
    out = out.withColumn("provider", F.coalesce("_p", "provider")).withColumn("model", F.coalesce("_m", "model"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in ("in_tokens", "out_tokens", "cache_read", "cache_write")})
    return out.select(chunks.columns)


class Store:
    """The tables of a project as numbered snapshots; ``commit`` writes all of a step's tables, then the pointer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last whole snapshot; 0 before the first."""
        fs, p = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        if not fs.exists(p(f"{self.path}/_commits")):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(p(f"{self.path}/_commits"))), default=0)

    def exists(self, table: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._at(table, self._of(table))))

    def _of(self, table: str) -> int:
        fs, p = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        return next((v for v in range(self.version(), 0, -1) if fs.exists(p(self._at(table, v)))), 0)

    def _at(self, table: str, version: int) -> str:
        return f"{self.path}/{table}/v={version:08d}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._at(table, self._of(table)))

    def commit(self, **tables: DataFrame) -> int:
        nxt = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._at(name, nxt))  # a step that broke off is written over
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs().mkdirs(p(f"{self.path}/_commits/{nxt}"))  # the pointer comes last
        return nxt
