"""Work in order within a group, whatever its size.

Rows of a group carry an ordinal (a piece, line or sequence number, unique in the
group). They are shuffled by (group, block of ordinals), never by group alone, so that
one group may hold any share of all rows. What has to cross blocks travels as one small
summary row per block. Groups of one block take the same way, so no plan depends on a
count made before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16


def block_of(ordinal: Column | str) -> Column:
    """Number of the block that ``ordinal`` is in."""
    return F.shiftright(ordinal, BLOCK_BITS)


def blocks_up_to(ordinal: Column | str) -> Column:
    """One row per block from the first to the one of ``ordinal``."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), block_of(ordinal)))


def in_order(ordinal: Column | str, text: Column | str) -> Column:
    """Aggregate: texts of a bounded group put together by ordinal, NULLs left out."""
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    text = F.col(text) if isinstance(text, str) else text
    entry = F.when(text.isNotNull(), F.struct(ordinal.alias("at"), text.alias("text")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "")


def joined_text(rows: DataFrame, keys: list[str], ordinal: str, text: str, out: str) -> DataFrame:
    """One text per group: first put together within blocks, then across them.

    Only the finished text of a group, which is one value, meets in one task.
    """
    parts = (
        rows.withColumn("_block", block_of(ordinal))
        .groupBy(*keys, "_block")
        .agg(in_order(ordinal, text).alias("_part"))
    )
    return parts.groupBy(*keys).agg(in_order("_block", "_part").alias(out))
