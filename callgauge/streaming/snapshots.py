"""Small state kept as tables between micro-batches.

Batch n writes slot n % SLOTS and reads slot (n - 1) % SLOTS, so a batch that is run again
after a failure starts from the same state and replaces its own output. A reader finds the
newest slot first and then reads that one alone, which is not written again for SLOTS - 1
batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 16


def save(state: DataFrame, path: str, batch_id: int) -> None:
    stamped = state.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    stamped.write.mode("overwrite").parquet(f"{path}/slot={batch_id % SLOTS}")


def of_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What batch ``batch_id`` saved."""
    return spark.read.parquet(f"{path}/slot={batch_id % SLOTS}").drop("batch_id")


def previous(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """State after the batch before this one; None for the first batch."""
    return None if batch_id == 0 else of_batch(spark, path, batch_id - 1)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """State after the last batch that had any. A slot that is replaced while the newest one
    is looked for isn't it."""
    slots = spark.read.option("ignoreMissingFiles", "true").parquet(path)
    newest = slots.groupBy("slot").agg(F.max("batch_id").alias("at")).orderBy(F.desc("at")).first()
    if newest is None:
        return slots.drop("batch_id", "slot")
    return spark.read.parquet(f"{path}/slot={newest['slot']}").drop("batch_id")


def upserted(state: DataFrame | None, changed: DataFrame, key: str) -> DataFrame:
    """State with the changed rows in place of the old ones of the same key."""
    if state is None:
        return changed
    kept = state.join(changed.select(key), key, "left_anti").select(*changed.columns)
    return kept.unionByName(changed)
