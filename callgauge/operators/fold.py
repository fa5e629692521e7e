"""Chunk rows to call logs: one row per finished call.

Rules: tokens add up; every done gives a success row with the text so far; the
first error gives an error row, with the latest usage before it, and ends the
call; a call that only stops gives no row. How chunks of short and of very long calls
move is told in ``ordered``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.functions.redaction import preview, preview_source, redact
from callgauge.functions.times import elapsed_ms
from callgauge.operators.ordered import block_of, in_order

FAILURES = ("error", "call_error")


def _is_end():
    return F.col("type").isin("done", *FAILURES)


def _usage():
    """Usage of a done chunk. The struct is there even if both counts are NULL."""
    return F.when(F.col("type") == "done", F.struct("input_tokens", "output_tokens"))


def _failed_at():
    return F.when(F.col("type").isin(*FAILURES), F.col("seq"))


def _not_past_failure():
    return F.col("_stop").isNull() | (F.col("seq") <= F.col("_stop"))


CALL = ["call_id"]
EARLIER = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def _chars():
    """Code points that a chunk adds to the text of its call."""
    return F.when(F.col("type") == "token", F.coalesce(F.length("content"), F.lit(0))).otherwise(0).cast("bigint")


def _live(chunks: DataFrame) -> DataFrame:
    """Chunks of calls up to their first failure, by (call, block).

    Adds ``block``, and the text length and latest usage of the call in earlier blocks.
    """
    rows = chunks.withColumn("block", block_of("seq"))
    earlier = Window.partitionBy(*CALL).orderBy("block").rowsBetween(*EARLIER)
    carried = (
        rows.groupBy("call_id", "block")
        .agg(
            F.min(_failed_at()).alias("_stop"),
            F.sum(_chars()).alias("_chars"),
            F.max_by(_usage(), F.when(F.col("type") == "done", F.col("seq"))).alias("_usage"),
        )
        .select(
            "call_id",
            "block",
            F.min("_stop").over(Window.partitionBy(*CALL)).alias("_stop"),
            F.coalesce(F.sum("_chars").over(earlier), F.lit(0)).alias("_earlier_chars"),
            F.last("_usage", ignorenulls=True).over(earlier).alias("_earlier_usage"),
        )
        .filter(F.col("_stop").isNull() | (F.col("block") <= block_of("_stop")))
    )
    return rows.join(carried, ["call_id", "block"]).filter(_not_past_failure())


def live_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks up to and including the first failure of their call."""
    return _live(chunks).select(*chunks.columns)


def _blocks(chunks: DataFrame) -> DataFrame:
    """One row per (call, block): its text, its ends, its last chunk.

    An end carries the length of the text before it instead of the text.
    """
    in_block = Window.partitionBy("call_id", "block").orderBy("seq").rowsBetween(*SO_FAR)
    usage = F.coalesce(F.last(_usage(), ignorenulls=True).over(in_block), "_earlier_usage")
    end = F.struct(
        "seq",
        "type",
        "ts",
        F.col("_usage.input_tokens").alias("input_tokens"),
        F.col("_usage.output_tokens").alias("output_tokens"),
        "error_msg",
        F.col("_so_far").alias("chars"),
    )
    return (
        _live(chunks)
        .withColumn("_so_far", F.col("_earlier_chars") + F.sum(_chars()).over(in_block))
        .withColumn("_usage", usage)
        .groupBy("call_id", "block")
        .agg(
            in_order("seq", F.when(F.col("type") == "token", F.col("content"))).alias("_part"),
            F.collect_list(F.when(_is_end(), end)).alias("_ends"),
            F.max("seq").alias("_seq"),
            F.max("ts").alias("_ts"),
        )
    )


def _whole_text():
    return F.coalesce(in_order("block", "_part"), F.lit(""))


def _outcomes(chunks: DataFrame, include_abandoned: bool, shortened: Callable[[Column], Column]) -> DataFrame:
    """A call meets once, as its text and its ends; each end then takes its beginning of the text."""
    calls = _blocks(chunks).groupBy(*CALL).agg(
        _whole_text().alias("text"),
        F.flatten(F.collect_list("_ends")).alias("ends"),
        F.max("_seq").alias("_seq"),
        F.max("_ts").alias("_ts"),
    )
    if include_abandoned:
        kind = calls.schema["ends"].dataType.elementType
        last = {"seq": F.col("_seq"), "type": F.lit("abandoned"), "ts": F.col("_ts"), "chars": F.length("text")}
        only = F.struct(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        calls = calls.withColumn("ends", F.when(F.size("ends") == 0, F.array(only)).otherwise(F.col("ends")))
    taken = calls.filter(F.size("ends") > 0).select("call_id", shortened(F.col("text")).alias("text"), "ends")
    return taken.select("call_id", "text", F.explode("ends").alias("e")).select(
        "call_id",
        "e.seq",
        "e.type",
        "e.ts",
        "e.input_tokens",
        "e.output_tokens",
        "e.error_msg",
        F.substring("text", F.lit(1), F.least("e.chars", F.lit(2**31 - 1)).cast("int")).alias("text"),
    )


def call_outcomes(chunks: DataFrame, include_abandoned: bool = False) -> DataFrame:
    """One row per end of a call: (call_id, seq, type, ts, usage, error_msg, text).

    ``text`` is the whole text before that end. With ``include_abandoned``, calls
    without any end give a row of type 'abandoned'.
    """
    return _outcomes(chunks, include_abandoned, lambda text: text)


def previewed_outcomes(chunks: DataFrame, include_abandoned: bool = False) -> DataFrame:
    """``call_outcomes`` with only as much of each text as its preview needs, so that a call
    with very many ends costs no more than its text and its ends."""
    return _outcomes(chunks, include_abandoned, preview_source)


def call_replies(chunks: DataFrame) -> DataFrame:
    """``finished_replies`` of the outcomes of these chunks: (call_id, reply), from one text per call."""
    done = F.max(F.array_max(F.transform(F.filter("_ends", lambda e: e["type"] == "done"), lambda e: e["chars"])))
    replies = _blocks(chunks).groupBy(*CALL).agg(_whole_text().alias("_text"), done.alias("_chars")).filter(F.col("_chars") > 0)
    return replies.select("call_id", F.substring("_text", F.lit(1), F.least("_chars", F.lit(2**31 - 1)).cast("int")).alias("reply"))


def fold_calls(calls: DataFrame, chunks: DataFrame, include_abandoned: bool = False) -> DataFrame:
    """Call log events, previews and error texts redacted."""
    outcomes = previewed_outcomes(chunks, include_abandoned)
    status = (
        F.when(F.col("type") == "done", "success").when(F.col("type").isin(*FAILURES), "error").otherwise(F.col("type"))
    )
    return outcomes.join(calls, "call_id").select(
        "call_id",
        "seq",
        "conversation_id",
        "message_id",
        "model",
        "provider",
        elapsed_ms("start_ts", "ts").alias("latency_ms"),
        "input_tokens",
        "output_tokens",
        status.alias("status"),
        redact("error_msg").alias("error_msg"),
        preview("input_text").alias("input_preview"),
        F.when(F.col("type") != "call_error", preview("text")).alias("output_preview"),
    )


def finished_replies(outcomes: DataFrame) -> DataFrame:
    """(call_id, reply) for calls with a done after a non-empty text; the last done wins."""
    return (
        outcomes.filter((F.col("type") == "done") & (F.col("text") != ""))
        .groupBy("call_id")
        .agg(F.max_by("text", "seq").alias("reply"))
    )


def resolve_placeholders(messages: DataFrame, replies: DataFrame) -> DataFrame:
    """Messages with empty placeholders filled from ``replies(message_id, reply)``.

    A failed or empty reply leaves the placeholder as it is.
    """
    filled = replies.select(F.col("message_id").alias("id"), "reply")
    return (
        messages.join(filled, "id", "left")
        .withColumn("content", F.coalesce("reply", "content"))
        .select(*messages.columns)
    )
