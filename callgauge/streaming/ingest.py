"""Ingestion: a stream of call log events into the date-partitioned log table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.functions.times import as_of_column
from callgauge.operators.integrity import check_logs
from callgauge.sources import dated
from callgauge.sources.sinks import EVENT_COLUMNS
from callgauge.streaming.lookup import referenced

Trigger = dict[str, object]
DRAIN: Trigger = {"availableNow": True}
EVERY_5_SECONDS: Trigger = {"processingTime": "5 seconds"}


def start_ingest(
    events: DataFrame,
    owners: Callable[[SparkSession], tuple[DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    now: datetime | Column | None = None,
    trigger: Trigger = DRAIN,
) -> StreamingQuery:
    """Store every event with the reason it was refused, if it was.

    A bad row never stops the stream: it lands next to the good ones, under
    outcome=refused. ``owners`` reads conversations and messages anew for each batch.
    A batch is written in one pass. Only the first batch of a run can be a repeated one:
    it replaces what was written of it, be it on another day. `dated.compact` puts the
    batches of a day together.
    """
    first = True

    def store(batch: DataFrame, batch_id: int) -> None:
        nonlocal first
        if first:
            dated.forget(batch.sparkSession, path, batch_id)
            first = False
        batch = batch.select(*EVENT_COLUMNS).persist()
        conversations, messages = owners(batch.sparkSession)
        conversations = referenced(conversations.select("id"), "id", batch, "conversation_id")
        messages = referenced(messages.select("id"), "id", batch, "message_id")
        at = as_of_column(now)
        rows = check_logs(batch, conversations, messages).select(
            F.expr("uuid()").alias("id"),
            *EVENT_COLUMNS,
            at.alias("created_at"),
            "reason",
            F.when(F.col("reason").isNull(), "stored").otherwise("refused").alias("outcome"),
            at.cast("date").alias("log_date"),
        )
        dated.write(rows, path, batch_id)
        batch.unpersist()

    writer = events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """Everything the stream wrote, with ``reason``, ``outcome`` and ``batch_id``."""
    return dated.read(spark, path)


def stored_logs(spark: SparkSession, path: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """The log table; given days (both included) are the only ones listed."""
    return dated.read(spark, path, "stored", since, until).drop("reason", "outcome", "batch_id")
