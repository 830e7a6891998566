"""Structured Streaming entry points (an addition: the work they wrap is batch work)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import html


def watch_pages(spark: SparkSession, path: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Leaf blocks of pages as their Parquet files arrive, given to ``sink`` batch by batch; each file is taken once."""
    pages = spark.readStream.schema(schema).parquet(path)
    return html.leaf_blocks(pages).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(spark: SparkSession, path: str, schema: str, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, late rows beyond the watermark left out. The event time has
    no zone in the files, so it is cast before the watermark."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    window = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
