"""Sessions: sensible settings for a laptop, and the package's place made known to Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A local session for tests and measurements. On a cluster, pass the cluster's own session to the operators."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    builder = builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return on_workers(spark)


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import the package wherever the driver was started. Clusters ship it (--py-files)."""
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in held.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{held}".rstrip(":")
    return spark
