"""Chunks of calls that are still streaming, kept as a table between micro-batches.

They wait by call and block of sequence numbers, so that no task holds a whole huge call. A
block's chunks are given out once it has been quiet for a while of event time; what remains
is a mark that it was, until that is forgotten too. All of it is joins and groupings: a call
costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.operators.ordered import block_of
from callgauge.streaming.lookup import referenced

BLOCK = ("call_id", "block")
TYPES = {"seq": "bigint", "ts": "timestamp_ntz", "type": "string", "content": "string", "input_tokens": "int", "output_tokens": "int", "error_msg": "string"}


def moment(at: str | None) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def newest(chunks: DataFrame) -> str | None:
    """Time of the newest chunk, as text. Of waiting chunks it is that of all chunks so far, as
    a block isn't quiet at its own newest chunk."""
    return chunks.agg(F.max("ts").cast("string")).first()[0]


def taken(batch: DataFrame) -> DataFrame:
    """Chunks of a micro-batch by block; columns beyond those of a chunk are left out."""
    return batch.select("call_id", block_of("seq").cast("bigint").alias("block"), *[F.col(name).cast(kind).alias(name) for name, kind in TYPES.items()])


def marked(chunks: DataFrame, marks: DataFrame | None) -> DataFrame:
    """``again``: whether chunks of the block were given out before, which ``marks`` tells."""
    if marks is None:
        return chunks.withColumn("again", F.lit(False))
    met = referenced(marks, "call_id", chunks, "call_id").select(*BLOCK).distinct().withColumn("again", F.lit(True))
    return chunks.join(met, list(BLOCK), "left").withColumn("again", F.coalesce("again", F.lit(False)))


def quiet_blocks(chunks: DataFrame, at: str | None, quiet: Column) -> DataFrame:
    """Blocks whose newest chunk is older than ``at`` by more than ``quiet``, or has no time."""
    blocks = chunks.groupBy(*BLOCK).agg(F.max("ts").alias("last"), F.max("again").alias("again"))
    return blocks.filter(F.coalesce(F.col("last") < moment(at) - quiet, F.lit(True))).drop("last")


def of_blocks(chunks: DataFrame, blocks: DataFrame, how: str) -> DataFrame:
    """Chunks in these blocks (``left_semi``) or in no such block (``left_anti``)."""
    keys = blocks.select(F.col("call_id").alias("_call"), F.col("block").alias("_block"))
    return chunks.join(keys, F.col("call_id").eqNullSafe(F.col("_call")) & F.col("block").eqNullSafe(F.col("_block")), how)


def folder_of(checkpoint: str) -> str:
    """Where the chunks that wait are kept, beside what Spark keeps of the stream."""
    return f"{checkpoint}/waiting"
