"""The event stream a chat client gets: written from chunks, read back from bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.operators.fold import live_chunks
from callgauge.operators.frames import END_OF_STREAM, Rules, counted_lines, packed_lines
from callgauge.operators.ordered import block_of, in_order

KEEP_NULLS = {"ignoreNullFields": "false"}


def event_json(message_id: Column | str) -> Column:
    """One JSON event per chunk, keys in alphabetical order; NULL for a failed request."""
    message_id = F.col(message_id) if isinstance(message_id, str) else message_id
    kind = F.col("type")
    token = F.struct("content", kind.alias("type"))
    done = F.struct("input_tokens", message_id.alias("message_id"), "output_tokens", kind.alias("type"))
    error = F.struct(F.col("error_msg").alias("message"), kind.alias("type"))
    return (
        F.when(kind == "token", F.to_json(token, KEEP_NULLS))
        .when(kind == "done", F.to_json(done, KEEP_NULLS))
        .when(kind == "error", F.to_json(error, KEEP_NULLS))
    )


def chat_events_json(chunks: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, seq, event) up to the first error of each call."""
    linked = live_chunks(chunks).join(calls.select("call_id", "message_id"), "call_id")
    return linked.select("call_id", "seq", event_json("message_id").alias("event")).filter("event is not null")


def chat_events_parse(captures: DataFrame) -> DataFrame:
    """What a client shows per call: (call_id, content, error).

    Content is the text of all tokens, error the last error message. Reading ends
    at [DONE], or at an event that is not JSON, which is an error too.
    """
    rules = {"app": _rules()}
    read = counted_lines(packed_lines(captures, rules), rules).select("call_id", "line", "out.*")
    last_error = F.max_by("error", F.when(F.col("error").isNotNull(), F.col("line"))).alias("error")
    # Texts first meet within blocks of lines; a call's blocks and errors are one row each.
    parts = read.groupBy("call_id", block_of("line").alias("_block")).agg(
        in_order("line", "content").alias("_part"), last_error, F.max(F.when(F.col("error").isNotNull(), F.col("line"))).alias("_at")
    )
    return parts.groupBy("call_id").agg(in_order("_block", "_part").alias("content"), F.max_by("error", "_at").alias("error"))


def _rules() -> Rules:
    def text(path: str) -> Column:
        return F.try_variant_get("json", path, "string")

    content = F.when(text("$.type") == "token", text("$.content"))
    error = (
        F.when(F.col("failure").isNotNull(), F.col("failure"))
        .when(F.col("json").isNull(), "malformed event")
        .when(text("$.type") == "error", text("$.message"))
    )
    counts = F.col("data").isNull() | (F.col("data") != END_OF_STREAM)
    out = F.when(counts, F.struct(content.alias("content"), error.alias("error")))
    return Rules(out, F.col("data").isNotNull() & F.col("json").isNull())
