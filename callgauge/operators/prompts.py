"""Prompts: what each user turn sent to a model, and the request bodies for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.functions.redaction import PREVIEW_CHARS, preview
from callgauge.operators import ranged
from callgauge.operators.conversations import PROMPT_MESSAGES


def prompt_context(
    messages: DataFrame, n: int = PROMPT_MESSAGES, ranges: int = ranged.RANGES, least_rows: int = ranged.LEAST_ROWS
) -> DataFrame:
    """For every user message the prompt of that turn: up to ``n`` messages, itself last.

    Empty placeholders of earlier turns are part of it, the one of this turn is
    not (it is stored later). Messages are shuffled by conversation and range of
    (conversation, time, id), so no task has to order a huge conversation alone, at one
    instant or not; a range is preceded by the last ``n - 1`` messages before it.
    """
    order, shown = ["conversation_id", "created_at", "id"], ["role", "content"]
    found = ranged.cut_points(messages, order, ranges, least_rows)
    cut = messages.select(*order, *shown, ranged.range_of(order, found).alias("_range"))
    rows = cut.withColumn("_before", F.lit(False))
    if n > 1:
        rows = rows.unionByName(_before(cut, found, order, shown, n))
    turn = Window.partitionBy("conversation_id", "_range").orderBy("created_at", "id").rowsBetween(1 - n, 0)
    return _user_turns(rows.withColumn("messages", F.collect_list(F.struct(*shown)).over(turn)).filter(~F.col("_before")))


def _before(cut: DataFrame, found: Column, order: list[str], shown: list[str], n: int) -> DataFrame:
    """The last ``n - 1`` messages before each range that begins inside a conversation.

    One range may have fewer than that, so the ends of a conversation's ranges are ordered
    together: ``n - 1`` rows of each range at most.
    """
    newest = Window.partitionBy("conversation_id", "_range").orderBy(F.desc("created_at"), F.desc("id"))
    ends = (
        cut.filter(ranged.goes_on("conversation_id", "_range", found))
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") < n)
    )
    along = Window.partitionBy("conversation_id").orderBy("created_at", "id").rowsBetween(2 - n, 0)
    last = ends.withColumn("_last", F.collect_list(F.struct(*order, *shown)).over(along)).filter(F.col("_rank") == 1)
    copied = last.select(F.explode("_last").alias("_row"), (F.col("_range") + 1).alias("_range"))
    return copied.select("_row.*", "_range", F.lit(True).alias("_before"))


def _user_turns(framed: DataFrame) -> DataFrame:
    return framed.filter(F.col("role") == "user").select("conversation_id", F.col("id").alias("message_id"), "messages")


def prompt_input(messages: Column | str = "messages") -> Column:
    """The text a call answers: the last message of its prompt, NULL for an empty prompt."""
    return F.try_element_at(messages, F.lit(-1))["content"]


def input_previews(prompts: DataFrame, limit: int = PREVIEW_CHARS) -> DataFrame:
    return prompts.select("conversation_id", "message_id", preview(prompt_input(), limit).alias("input_preview"))


def openai_body(messages: Column | str, model: Column) -> Column:
    """Request body, keys in alphabetical order."""
    plain = F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    return F.to_json(
        F.struct(
            plain.alias("messages"),
            model.alias("model"),
            F.lit(True).alias("stream"),
            F.struct(F.lit(True).alias("include_usage")).alias("stream_options"),
        )
    )


# Fixed values.
GEMINI_ROLES = {"assistant": "model", "system": "user"}
GEMINI_MAX_TOKENS = 2048
GEMINI_THINKING = "minimal"
GEMINI_UNBLOCKED = (
    "HARM_CATEGORY_HARASSMENT",
    "HARM_CATEGORY_HATE_SPEECH",
    "HARM_CATEGORY_SEXUALLY_EXPLICIT",
    "HARM_CATEGORY_DANGEROUS_CONTENT",
)


def gemini_role(role: Column) -> Column:
    out = role
    for ours, theirs in GEMINI_ROLES.items():
        out = F.when(role == ours, theirs).otherwise(out)
    return out


def gemini_body(messages: Column | str) -> Column:
    """Request body, keys in alphabetical order."""
    contents = F.transform(
        messages,
        lambda m: F.struct(
            F.array(F.struct(m["content"].alias("text"))).alias("parts"),
            gemini_role(m["role"]).alias("role"),
        ),
    )
    thinking = F.struct(F.lit(GEMINI_THINKING).alias("thinkingLevel"))
    safety = [
        F.struct(F.lit(category).alias("category"), F.lit("BLOCK_NONE").alias("threshold"))
        for category in GEMINI_UNBLOCKED
    ]
    return F.to_json(
        F.struct(
            contents.alias("contents"),
            F.struct(F.lit(GEMINI_MAX_TOKENS).alias("maxOutputTokens"), thinking.alias("thinkingConfig")).alias(
                "generationConfig"
            ),
            F.array(*safety).alias("safetySettings"),
        )
    )


def prompt_openai(prompts: DataFrame, model: str) -> DataFrame:
    return prompts.select("conversation_id", "message_id", openai_body("messages", F.lit(model)).alias("body"))


def prompt_gemini(prompts: DataFrame) -> DataFrame:
    return prompts.select("conversation_id", "message_id", gemini_body("messages").alias("body"))


def user_previews(messages: DataFrame, limit: int = PREVIEW_CHARS) -> DataFrame:
    """``input_previews`` of the prompts of all user turns: a user message is the last of its own prompt."""
    turns = messages.filter(F.col("role") == "user")
    return turns.select("conversation_id", F.col("id").alias("message_id"), preview("content", limit).alias("input_preview"))
