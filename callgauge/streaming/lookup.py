"""Lookups of a micro-batch in tables far larger than it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys sent to every task: as many as their number and 16 MB of text allow.
BROADCAST_KEYS = 200_000
BROADCAST_BYTES = 16 << 20


def referenced(table: DataFrame, column: str, batch: DataFrame, batch_column: str) -> DataFrame:
    """Rows of ``table`` that the batch refers to.

    The table is filtered to the range of the batch's keys, which goes down to its files: in
    a table stored in order of its keys, files and row groups outside of it are not read.
    Then the batch keys go to the table, which is filtered where it lies instead of being
    shuffled for every batch. A batch with too many keys leaves that to the join after this.
    """
    keys = batch.select(F.col(batch_column).alias(column)).filter(F.col(column).isNotNull()).distinct()
    size = F.sum(F.length(F.col(column).cast("string")) + 8).alias("bytes")
    found = keys.agg(F.count("*").alias("n"), size, F.min(column).alias("low"), F.max(column).alias("high")).first()
    if found["n"] == 0:
        return table.filter(F.lit(False))
    kind = keys.schema[column].dataType
    near = table.filter(F.col(column).between(F.lit(found["low"]).cast(kind), F.lit(found["high"]).cast(kind)))
    if found["n"] > BROADCAST_KEYS or found["bytes"] > BROADCAST_BYTES:
        return near
    return near.join(F.broadcast(keys), column, "left_semi")
