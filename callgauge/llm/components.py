"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.sources.workspace import run_folder

#: Rounds grow with the logarithm of a component's diameter; more than this is an error.
MOST_ROUNDS = 60


#: Lets a command drop its shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: a lost executor costs no earlier
    round, and no shuffle files stay behind on the way."""
    spark = frame.sparkSession
    folder, before = run_folder(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(folder)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """node and root of every node in links (a, b, of which a node is its own root and is left out).

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest node
    in sight. Only minima per node are gathered, so a node may have any number of links.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        turned = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = stored(lowest.select("a", F.col("low").alias("b")).unionByName(turned).where("a <> b").distinct(), "links")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError("components did not settle")
