"""Connected components of a distributed list of links, and tables kept in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import reliable_dir, unique_name


class Shelf:
    """Intermediate tables as Parquet in the shared folder: compact, whole after the loss of any executor, and
    dropped as soon as a later table stands for them. What a returned DataFrame still reads stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.count = spark, f"{reliable_dir(spark)}/{unique_name(name)}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.top}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path  # of this very DataFrame; what is derived from it has none
        return out

    def drop(self, kept: DataFrame) -> None:
        """Deletes the table of a DataFrame that ``keep`` returned."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(kept._shelf_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, shelf: Shelf, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link between two nodes.

    Each round points every node at its smallest neighbour if that is smaller (a forest, as pointers only descend),
    shortens the pointers to roots by doubling, and keeps the links between different roots. At least every second
    node of a round is no root, so rounds and jumps are logarithmic in the nodes. A node with very many
    links costs no more than its rows: minima are pre-aggregated, and joins can be split where skewed. Null ends,
    links to oneself and repeated links are dropped; no links give an empty result.
    """
    links = shelf.keep(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    pointers: list[DataFrame] = []
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        table = shelf.keep(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")))
        moved = True
        while moved:
            to = table.select("node", "root")
            nxt = to.select(F.col("node").alias("root"), F.col("root").alias("far"))
            jumped = shelf.keep(to.join(nxt, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
            shelf.drop(table)
            table, moved = jumped, not jumped.where("moved").isEmpty()
        to = table.select("node", "root")
        pointers.append(to)
        left = links.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        fewer = shelf.keep(left.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct())
        shelf.drop(links)
        links = fewer
    if not pointers:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component"))
    out = pointers[0].select("node", F.col("root").alias("component"))
    for later in pointers[1:]:
        out = out.join(later.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return out
