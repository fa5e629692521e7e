"""Conversation state: titles, activity, feeds, last messages, full history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.functions import display
from callgauge.functions.text import trimmed
from callgauge.sources.schemas import DEFAULT_TITLE

# Fixed values.
TITLE_CHARS = 40
PROMPT_MESSAGES = 20
HISTORY_MESSAGES = 200


def last_n_messages(messages: DataFrame, n: int = PROMPT_MESSAGES, key: str = "conversation_id") -> DataFrame:
    """The newest ``n`` rows of every conversation.

    The rank filter becomes a group limit on both sides of the shuffle: each task
    sends at most ``n`` rows per conversation, so a huge one does not pile up.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return messages.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def _typed(messages: DataFrame) -> DataFrame:
    """Per conversation the first user text that can be a title, and the last user message."""
    start = F.substring("content", 1, TITLE_CHARS)
    titled = F.when(start != DEFAULT_TITLE, F.struct("created_at", "id"))
    return (
        messages.filter(F.col("role") == "user")
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(F.min_by(start, titled).alias("_first"), F.max("created_at").alias("_typed"))
    )


def _replied(messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Per conversation the time its last non-empty reply was finished.

    That is the time of the successful call that wrote it. Calls are reduced to one
    row per message before they meet the messages.
    """
    finished = (
        logs.filter((F.col("status") == "success") & F.col("message_id").isNotNull())
        .groupBy(F.col("message_id").alias("id"))
        .agg(F.max("created_at").alias("_finished"))
    )
    return (
        messages.filter((F.col("role") == "assistant") & (F.col("content") != ""))
        .select("id", "conversation_id")
        .join(finished, "id")
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(F.max("_finished").alias("_replied"))
    )


def _settled_title() -> Column:
    return F.when(F.col("title") == DEFAULT_TITLE, F.coalesce("_first", "title")).otherwise(F.col("title"))


def conversation_titles(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with their title settled.

    The first user message replaces the default title. One that reads like the
    default leaves it open for the next.
    """
    typed = _typed(messages).select("id", "_first")
    return conversations.join(typed, "id", "left").withColumn("title", _settled_title()).drop("_first")


def conversation_activity(conversations: DataFrame, messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Conversations with ``updated_at``: the last user message or finished, non-empty reply."""
    typed = _typed(messages).select("id", "_typed")
    return (
        conversations.join(typed, "id", "left")
        .join(_replied(messages, logs), "id", "left")
        .withColumn("updated_at", F.greatest("created_at", "_typed", "_replied"))
        .drop("_typed", "_replied")
    )


def conversation_state(conversations: DataFrame, messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Title and ``updated_at`` together, from one pass over the user messages."""
    return (
        conversations.join(_typed(messages), "id", "left")
        .join(_replied(messages, logs), "id", "left")
        .withColumn("title", _settled_title())
        .withColumn("updated_at", F.greatest("created_at", "_typed", "_replied"))
        .drop("_first", "_typed", "_replied")
    )


def session_feed(conversations: DataFrame) -> DataFrame:
    """Conversations of every session, most recently touched first.

    One range-partitioned sort: a session with very many conversations spans
    several tasks. ``session_id`` stays as the key to filter on.
    """
    return conversations.select("session_id", "id", "title", "created_at", "updated_at").orderBy(
        "session_id", F.desc("updated_at"), F.desc("id")
    )


def feed_labels(conversations: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    return conversations.select(
        "session_id",
        "id",
        F.coalesce(F.nullif("title", F.lit("")), F.lit(display.UNTITLED)).alias("title"),
        display.relative_age(F.col("updated_at"), as_of).alias("age"),
    )


def ownership_check(requests: DataFrame, conversations: DataFrame) -> DataFrame:
    """Requests with ``found``: true where the conversation exists and belongs to the session.

    A missing conversation and someone else's look the same.
    """
    owned = conversations.select(F.col("id").alias("conversation_id"), "session_id", F.lit(True).alias("_owned"))
    return (
        requests.join(owned, ["conversation_id", "session_id"], "left")
        .withColumn("found", F.coalesce("_owned", F.lit(False)))
        .drop("_owned")
    )


def conversation_detail(conversations: DataFrame, messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """Every conversation with its newest ``n`` messages, oldest first, as an array.

    A conversation without messages has an empty array. The grouping reuses the
    partitioning of the group limit, and no group holds more than ``n`` rows.
    """
    history = (
        last_n_messages(messages, n)
        .groupBy(F.col("conversation_id").alias("id"))
        .agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("_rows"))
        .select(
            "id",
            F.transform(
                "_rows",
                lambda m: F.struct(m["id"].alias("id"), m["role"].alias("role"), m["content"].alias("content"), m["created_at"].alias("created_at")),
            ).alias("messages"),
        )
    )
    none = F.array().cast(history.schema["messages"].dataType)
    return conversations.join(history, "id", "left").withColumn("messages", F.coalesce("messages", none))


def resume_view(detail: DataFrame) -> DataFrame:
    """History as a resumed chat shows it: empty assistant messages hidden."""
    shown = F.filter("messages", lambda m: ~((m["role"] == "assistant") & (m["content"] == "")))
    return detail.withColumn("messages", shown)


def clean_inputs(inputs: DataFrame, text: str = "text") -> DataFrame:
    """Typed inputs, trimmed; blank ones dropped."""
    return inputs.withColumn(text, trimmed(text)).filter(F.col(text) != "")
