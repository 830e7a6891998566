"""Sources: what kind a file is, and adapters that turn it into blocks.

A file is told by its first bytes, never by its name. Files are read with Spark's binaryFile source, so they can be in any
store that Spark reads; parsing runs in Arrow batches on the executors.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = ("epub", "pdf")
EPUB_TYPE = "application/epub+zip"


class UnsupportedSource(ValueError):
    """The file isn't one that the engine reads."""


def sniff_bytes(data: bytes) -> tuple[str | None, str | None]:
    """(format, error): pdf, epub, or why not."""
    if not data:
        return None, "the file is empty"
    if data[:4] == b"%PDF":
        return "pdf", None
    if data[:4] != b"PK\x03\x04":
        return None, "the format is unknown"
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            kind = z.read("mimetype").decode("utf-8", "replace").strip()
    except zipfile.BadZipFile:
        return None, "the archive is broken"
    except KeyError:
        return None, "the archive has no mimetype"
    return ("epub", None) if kind == EPUB_TYPE else (None, f"the archive is {kind!r}, not a book")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of all files at ``path``. Spark's source passes over empty files, so these are listed apart: an
    empty book is an error that has to be told."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in fs.globStatus(where) or () for s in ([top] if top.isFile() else fs.listStatus(top.getPath()))]
    empty = [(s.getPath().toString(), 0, bytearray()) for s in found if s.isFile() and s.getLen() == 0 and not s.getPath().getName().startswith(("_", "."))]
    return files.unionByName(spark.createDataFrame(empty, "path string, length long, content binary")) if empty else files


def sniff(files: DataFrame) -> DataFrame:
    """(path, format, error) of files (path, content); whole archives are opened, other files told by their first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sniff_bytes(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f for f, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["path", "format", "error"])

    head = F.when(F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"), F.col("content")).otherwise(F.substring("content", 1, 4))
    return files.select("path", head.alias("content")).mapInArrow(run, "path string, format string, error string")


def ensure_supported(found: DataFrame) -> DataFrame:
    """``found`` itself; reading a row of a format that isn't supported raises, with its path and reason."""
    bad = F.col("format").isNull() | ~F.col("format").isin(*SUPPORTED)
    message = F.concat(F.lit("unsupported source "), F.col("path"), F.lit(": "), F.coalesce("error", F.concat(F.lit("format "), "format")))
    return found.withColumn("format", F.when(bad, F.raise_error(message)).otherwise(F.col("format")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        READERS[name] = f
        return f

    return add


def load(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of every book under ``path``, each by the reader of its format."""
    from . import epub, pdf  # noqa: F401  they register themselves

    kinds = [r[0] for r in sniff(binary_files(spark, path)).transform(ensure_supported).select("format").distinct().collect()]
    if not kinds:
        raise UnsupportedSource(f"nothing at {path}")
    out = None
    for k in sorted(kinds):
        part = READERS[k](spark, path)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
