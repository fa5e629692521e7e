"""Rows to store: defaults for missing values, and date-partitioned appends."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.functions.times import as_of_column
from callgauge.sources.schemas import DEFAULT_TITLE

EVENT_COLUMNS = (
    "conversation_id",
    "message_id",
    "model",
    "provider",
    "latency_ms",
    "input_tokens",
    "output_tokens",
    "status",
    "error_msg",
    "input_preview",
    "output_preview",
)


def open_conversations(requests: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """A new conversation for every request(session_id)."""
    at = as_of_column(now)
    return requests.select(
        F.expr("uuid()").alias("id"),
        "session_id",
        F.lit(DEFAULT_TITLE).alias("title"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def new_messages(rows: DataFrame, now: datetime | Column | None = None, *more: str) -> DataFrame:
    """Messages to append: a given id is kept, a missing one is generated."""
    return rows.select(
        F.coalesce(F.col("id").cast("string"), F.expr("uuid()")).alias("id"),
        "conversation_id",
        "role",
        "content",
        as_of_column(now).alias("created_at"),
        *more,
    )


def new_logs(events: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Call logs to append: a new id, and the time of ingestion as ``created_at``."""
    at = as_of_column(now)
    return events.select(
        F.expr("uuid()").alias("id"), *EVENT_COLUMNS, at.alias("created_at"), at.cast("date").alias("log_date")
    )


def laid_out(logs: DataFrame, *folders: str, order: str = "conversation_id") -> DataFrame:
    """Rows ready to be written under ``folders``.

    Rows of one folder meet in few tasks, so it gets few files; a folder with very
    many rows is split again by size at run time. Within a file rows are in ``order``,
    by conversation, so a lookup of one skips row groups.
    """
    return logs.hint("rebalance", *folders).sortWithinPartitions(*folders, order)


def append_by_date(logs: DataFrame, path: str) -> None:
    """Append call logs under one folder per day, so that time filters skip files."""
    if "log_date" not in logs.columns:
        logs = logs.withColumn("log_date", F.col("created_at").cast("date"))
    laid_out(logs, "log_date").write.mode("append").partitionBy("log_date").parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int, *folders: str, order: str = "conversation_id") -> None:
    """Write the rows of one micro-batch; a repeated batch replaces its own folder."""
    if folders:
        rows = laid_out(rows, *folders, order=order)
    rows.write.mode("overwrite").partitionBy(*folders).parquet(f"{path}/batch_id={batch_id}")
