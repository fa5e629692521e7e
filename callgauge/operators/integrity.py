"""Integrity rules: which rows may be stored, and what a delete takes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.sources.schemas import ROLES, STATUSES

LOG_REQUIRED = ("conversation_id", "model", "provider", "latency_ms", "status")
CONVERSATION_REQUIRED = ("session_id", "title")
MESSAGE_REQUIRED = ("conversation_id", "role", "content")


def _first_null(columns: tuple[str, ...]) -> Column:
    """Reason for the first required column that is NULL, else NULL."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in columns]
    return F.coalesce(*checks)


def _matched(df: DataFrame, column: str, owners: DataFrame, flag: str) -> DataFrame:
    """``df`` with a flag: does ``column`` name a row of ``owners``?

    Owners have one row per id, so the left join keeps every row once, and a
    value shared by very many rows is split by the adaptive skew join.
    """
    ids = owners.select(F.col("id").alias(column)).distinct().withColumn(flag, F.lit(True))
    return df.join(ids, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _linked(df: DataFrame, messages: DataFrame, flag: str) -> DataFrame:
    """``_matched`` for the message link, which may be NULL: rows without one don't take part
    in the join, or they would all meet in one task."""
    without = df.filter(F.col("message_id").isNull()).withColumn(flag, F.lit(False))
    return _matched(df.filter(F.col("message_id").isNotNull()), "message_id", messages, flag).unionByName(without)


def check_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations with ``reason``: NULL where the row may be stored."""
    return conversations.withColumn("reason", _first_null(CONVERSATION_REQUIRED))


def check_logs(logs: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Call logs with ``reason``: NULL where the row may be stored.

    Checked in this order: required values, status domain, conversation exists,
    message exists (no message is fine).
    """
    flagged = _linked(logs, messages, "_message")
    flagged = _matched(flagged, "conversation_id", conversations, "_conversation")
    reason = F.coalesce(
        _first_null(LOG_REQUIRED),
        F.when(~F.col("status").isin(*STATUSES), F.lit("status not allowed")),
        F.when(~F.col("_conversation"), F.lit("conversation not found")),
        F.when(F.col("message_id").isNotNull() & ~F.col("_message"), F.lit("message not found")),
    )
    return flagged.withColumn("reason", reason).select(*logs.columns, "reason")


def check_messages(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages with ``reason``: NULL where the row may be stored.

    Messages that name a session_id may only go to a conversation of that session; another's
    looks like a missing one.
    """
    if "session_id" in messages.columns:
        keys = ["conversation_id", "session_id"]
        owned = conversations.select(F.col("id").alias("conversation_id"), "session_id").distinct().withColumn("_conversation", F.lit(True))
        flagged = messages.join(owned, keys, "left").withColumn("_conversation", F.coalesce("_conversation", F.lit(False)))
    else:
        flagged = _matched(messages, "conversation_id", conversations, "_conversation")
    reason = F.coalesce(
        _first_null(MESSAGE_REQUIRED),
        F.when(~F.col("role").isin(*ROLES), F.lit("role not allowed")),
        F.when(~F.col("_conversation"), F.lit("conversation not found")),
    )
    return flagged.withColumn("reason", reason).select(*messages.columns, "reason")


def check_keys(rows: DataFrame, arrival: str = "created_at") -> DataFrame:
    """Primary key rule: the first row of an id stays, later ones are refused.

    Returns each distinct row with ``copies`` (how often it came) and ``kept``
    (true for the one that is stored once; its other copies are refused). The
    winner of an id is a map-side minimum, so an id on very many rows costs one
    row per task, and nothing is collected per id.
    """
    distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    rest = [c for c in rows.columns if c not in ("id", arrival)]
    entry = F.struct(arrival, *rest)
    first = rows.groupBy("id").agg(F.min(entry).alias("_first"))
    return (
        distinct.join(first, "id", "left")
        .withColumn("kept", F.coalesce(F.col("_first").eqNullSafe(entry), F.lit(True)))
        .select(*rows.columns, "copies", "kept")
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNull()).drop("reason")


def refused(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull())


def without_deleted(rows: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    """Rows left after the owners in ``deleted(id)`` are gone (cascading delete)."""
    return rows.join(deleted.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)


def cascade_delete(
    conversations: DataFrame, messages: DataFrame, logs: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations, messages and calls left after deleting conversations."""
    kept_messages = without_deleted(messages, "conversation_id", deleted)
    gone = messages.join(deleted.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    kept_logs = cascade_set_null(without_deleted(logs, "conversation_id", deleted), gone.select("id"))
    return without_deleted(conversations, "id", deleted), kept_messages, kept_logs


def cascade_set_null(logs: DataFrame, deleted_messages: DataFrame) -> DataFrame:
    """Call logs after deleting messages: the link is cleared, the log stays."""
    flagged = _linked(logs, deleted_messages, "_gone")
    cleared = F.when(~F.col("_gone"), F.col("message_id"))
    return flagged.withColumn("message_id", cleared).select(*logs.columns)


def logs_with_reply(logs: DataFrame, messages: DataFrame) -> DataFrame:
    """Call logs next to the message they wrote, if it is still there."""
    reply = messages.select(
        F.col("id").alias("message_id"), F.col("role").alias("reply_role"), F.col("content").alias("reply")
    )
    linked = logs.filter(F.col("message_id").isNotNull()).join(reply, "message_id", "left")
    return linked.unionByName(logs.filter(F.col("message_id").isNull()), allowMissingColumns=True)
