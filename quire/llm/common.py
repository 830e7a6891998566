"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are worked on in slices of about so many bytes, so that
#: a worker's memory follows this figure and its longest text, not the batch.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads; a null text becomes an empty one.

    Selecting by position keeps extra columns, whatever their names, out of the plan.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def reliable_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset: a folder of the warehouse, if that is in a shared file
    system or all executors are on this machine; else there is none, and that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if not sc.master.startswith("local[") and sc.master != "local" and re.match(r"file:|/", top):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            own = f"{top}/_checkpoints"
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``limit`` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64)
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)


def all_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every column, a null text as an empty one."""
    return docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def with_texts(docs: DataFrame, change, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """Every column, the texts (a list of str, of one slice) replaced by ``change``; n_chars follows where there is one. Map only."""
    told = all_columns(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = change()
        for big in batches:
            for part in slices(big, text_col):
                i = part.schema.get_field_index(text_col)
                yield part.set_column(i, part.schema.field(i), pa.array(make(part.column(i).to_pylist()), part.schema.field(i).type))

    out = told.mapInArrow(run, told.schema)
    return out.withColumn(length_col, F.length(text_col).cast(dict(docs.dtypes)[length_col])) if length_col in docs.columns else out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): spreads the bits of an unsigned array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])


def gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin[i], ..., begin[i] + size[i] - 1 for every i, in a row."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def labels(n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning (Murmur3, seed 42) sends there: the number whose hash is
    the partition's, found by taking the hash's steps backwards."""
    full = (1 << 32) - 1
    h = np.arange(n, dtype=np.uint64)
    times = lambda x, c: x * np.uint64(pow(c, -1, 1 << 32)) & np.uint64(full)
    back = lambda x, r: (x >> np.uint64(r) | x << np.uint64(32 - r)) & np.uint64(full)
    h ^= h >> np.uint64(16)
    h = times(h, 0xC2B2AE35)
    h ^= h >> np.uint64(13) ^ h >> np.uint64(26)
    h = times(h, 0x85EBCA6B)
    h ^= h >> np.uint64(16)
    h = back(times((h ^ np.uint64(4)) + np.uint64((1 << 32) - 0xE6546B64), 5), 13)
    h = times(back(times(h ^ np.uint64(42), 0x1B873593), 15), 0xCC9E2D51)
    return h.astype(np.uint32).view(np.int32).tolist()


def label_column(place: Column, n: int) -> Column:
    """labels(n) at ``place``: one folded literal, not n expressions."""
    told = F.split(F.lit(",".join(map(str, labels(n)))), ",").cast("array<int>")
    return F.element_at(told, (place + 1).cast("int"))


def unique_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
