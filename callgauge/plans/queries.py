"""Every operator as a query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.functions.redaction import PREVIEW_CHARS, redact, truncate
from callgauge.functions.text import error_text
from callgauge.functions.times import iso_utc
from callgauge.operators import conversations as conv
from callgauge.operators import events, fold, frames, integrity, metrics, prompts
from callgauge.plans import inputs
from callgauge.plans.inputs import AS_OF, table
from callgauge.sources import dated, keyed, rewritten, sinks
from callgauge.sources.workspace import run_folder
from callgauge.streaming import calls as call_stream
from callgauge.streaming import ingest, live

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}

# A conversation of the test tables has at most 8 messages, so 3 shows the cut.
SHORT = 3


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Metrics


@query
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metrics_summary(inputs.logs(spark, sf_dir), AS_OF)


@query
def latency_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_series(inputs.logs(spark, sf_dir), AS_OF)


@query
def recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent_logs(inputs.latest_previewed(spark, sf_dir, metrics.LATEST_CALLS))


@query
def log_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.log_display(inputs.latest_previewed(spark, sf_dir, metrics.LATEST_CALLS))


@query
def summary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary_cards(metrics_summary(spark, sf_dir))


@query
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chart_points(latency_series(spark, sf_dir))


# Text


@query
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return documents.unionByName(pages).select("kind", "id", redact("text").alias("text"))


@query
def redact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = inputs.logs(spark, sf_dir).filter(F.col("error_msg").isNotNull())
    return failed.select("id", redact("error_msg").alias("error_msg"))


@query
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate("text", PREVIEW_CHARS).alias("text"))


@query
def input_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.user_previews(inputs.messages(spark, sf_dir))


@query
def format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "element_at(array('http', 'api', 'malformed', 'internal'), cast(user_id % 4 as int) + 1)"
    failures = table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr(
        "event_id", f"{kinds} as kind", "cast(400 + event_id % 100 as int) as status", "props"
    )
    return failures.select("event_id", error_text(F.col("kind"), F.col("props"), F.col("status")).alias("error_msg"))


@query
def clean_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = inputs.messages(spark, sf_dir).select(
        "id", F.concat(F.lit("\t\xa0 "), "content", F.lit(" \r\n" + chr(0x2003))).alias("text")
    )
    return conv.clean_inputs(typed)


# Conversations


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.conversation_state(
        inputs.conversations(spark, sf_dir), inputs.messages(spark, sf_dir), inputs.logs(spark, sf_dir)
    )


@query
def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.last_n_messages(inputs.messages(spark, sf_dir), SHORT)


@query
def last_n_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.last_n_messages(inputs.logs(spark, sf_dir)).select("conversation_id", "id", "created_at")


@query
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.conversation_titles(inputs.conversations(spark, sf_dir), inputs.messages(spark, sf_dir))


@query
def conversation_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.conversation_activity(
        inputs.conversations(spark, sf_dir), inputs.messages(spark, sf_dir), inputs.logs(spark, sf_dir)
    )


@query
def session_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.session_feed(_state(spark, sf_dir))


@query
def feed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.feed_labels(_state(spark, sf_dir), AS_OF)


@query
def ownership_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.ownership_check(inputs.ownership_requests(spark, sf_dir), inputs.conversations(spark, sf_dir))


def _history_json() -> Column:
    shown = F.transform(
        "messages",
        lambda m: F.struct(
            m["id"].alias("id"),
            m["role"].alias("role"),
            m["content"].alias("content"),
            iso_utc(m["created_at"]).alias("created_at"),
        ),
    )
    return F.to_json(shown)


@query
def conversation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = conv.conversation_detail(_state(spark, sf_dir), inputs.messages(spark, sf_dir))
    return detail.select("id", "title", "created_at", "updated_at", _history_json().alias("messages"))


@query
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations far longer than what a resumed chat shows."""
    detail = conv.conversation_detail(*inputs.event_history(spark, sf_dir))
    shown = F.transform("messages", lambda m: F.concat_ws(":", m["id"].cast("string"), m["content"]))
    return detail.select("id", F.size("messages").cast("bigint").alias("n_messages"), F.array_join(shown, ",").alias("messages"))


@query
def resume_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = conv.conversation_detail(inputs.conversations(spark, sf_dir), inputs.messages(spark, sf_dir))
    return conv.resume_view(detail).select("id", _history_json().alias("messages"))


@query
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.prompt_context(inputs.messages(spark, sf_dir), SHORT)
    return turns.select("conversation_id", "message_id", F.to_json("messages").alias("messages"))


@query
def prompt_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.prompt_openai(prompts.prompt_context(inputs.messages(spark, sf_dir)), "gpt-4o-mini")


@query
def prompt_gemini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.prompt_gemini(prompts.prompt_context(inputs.messages(spark, sf_dir)))


# Integrity


@query
def integrity_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = integrity.check_logs(
        inputs.strict_logs(spark, sf_dir), inputs.conversations(spark, sf_dir), inputs.messages(spark, sf_dir)
    )
    return checked.select("id", "reason")


@query
def integrity_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = integrity.without_deleted(
        inputs.conversations(spark, sf_dir), "id", inputs.deleted_conversations(spark, sf_dir)
    )
    return integrity.check_messages(inputs.strict_messages(spark, sf_dir), owners).select("id", "reason")


@query
def integrity_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.check_conversations(inputs.strict_conversations(spark, sf_dir)).select("id", "session_id", "reason")


@query
def integrity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = table(spark, sf_dir, "events").selectExpr("user_id as id", "event_type", "ts as created_at")
    return integrity.check_keys(arrivals)


def _survivors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return integrity.cascade_delete(
        inputs.conversations(spark, sf_dir),
        inputs.messages(spark, sf_dir),
        inputs.logs(spark, sf_dir),
        inputs.deleted_conversations(spark, sf_dir),
    )


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dict(zip(("conversation", "message", "log"), _survivors(spark, sf_dir), strict=True))
    return _all([rows.select(F.lit(kind).alias("kind"), "id") for kind, rows in left.items()])


@query
def cascade_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = integrity.cascade_set_null(inputs.logs(spark, sf_dir), inputs.deleted_messages(spark, sf_dir))
    return cleared.select("id", "conversation_id", "message_id")


@query
def logs_with_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = integrity.logs_with_reply(inputs.logs(spark, sf_dir), inputs.messages(spark, sf_dir))
    return linked.select("id", "message_id", "status", "reply_role", "reply")


# Sources and sinks


@query
def stored_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message table itself, after finished replies were written into its placeholders."""
    path = run_folder(spark, "messages")
    rewritten.create(inputs.messages(spark, sf_dir).withColumn("content", F.expr("if(role = 'assistant', '', content)")), path, "conversation_id")
    replies = run_folder(spark, "replies")
    fold.call_replies(inputs.chunks(spark, sf_dir)).withColumnRenamed("call_id", "message_id").write.parquet(replies)
    rewritten.fill_placeholders(spark, path, spark.read.parquet(replies))
    return rewritten.read(spark, path)


@query
def stored_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored tables hold after conversations and then messages were deleted from them."""
    path = run_folder(spark, "deletes")
    tables = {"conversation": inputs.conversations, "message": inputs.messages, "log": inputs.logs}
    at = {kind: f"{path}/{kind}" for kind in tables}
    for kind, rows in tables.items():
        rewritten.create(rows(spark, sf_dir), at[kind], "id" if kind == "conversation" else "conversation_id")
    rewritten.delete_conversations(spark, inputs.deleted_conversations(spark, sf_dir), at["conversation"], at["message"], at["log"])
    rewritten.delete_messages(spark, inputs.deleted_messages(spark, sf_dir), at["message"], at["log"])
    link = {"log": F.col("message_id")}
    return _all([rewritten.read(spark, at[kind]).select(F.lit(kind).alias("kind"), "id", link.get(kind, F.lit(None).cast("bigint")).alias("message_id")) for kind in tables])


@query
def open_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("session_id"))
    path = run_folder(spark, "conversations")
    sinks.open_conversations(requests, AS_OF).write.parquet(path)
    return spark.read.parquet(path).drop("id")


@query
def store_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages sent in three batches, the last one twice: what was stored and what refused."""
    path = run_folder(spark, "messages")
    sent, owners = inputs.sent_messages(spark, sf_dir), inputs.conversations(spark, sf_dir)
    for batch in (0, 1, 2, 2):
        keyed.store_messages(sent.filter(F.col("conversation_id") % 3 == batch), owners, path, batch, AS_OF)
    keyed.store_messages(sent.filter("id % 5 = 0"), owners, path, 3, AS_OF)
    return keyed.message_outcomes(spark, path).select("id", "content", "outcome", "reason", "copies")


@query
def store_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations asked for by every signup; some requests name no session."""
    requests = table(spark, sf_dir, "events").filter("event_type = 'signup'").selectExpr("nullif(user_id % 7, 3) as session_id")
    path = run_folder(spark, "conversations")
    keyed.store_conversations(requests, path, 0, AS_OF)
    return spark.read.parquet(path).select("session_id", "title", "created_at", "updated_at", "reason", "outcome")


@query
def append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.messages(spark, sf_dir).withColumn("id", F.expr("if(role = 'user', null, id)"))
    path = run_folder(spark, "messages")
    sinks.new_messages(rows, AS_OF).write.parquet(path)
    stored = spark.read.parquet(path)
    return stored.withColumn("id", F.when(F.col("role") != "user", F.col("id")))


@query
def ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = integrity.check_logs(
        inputs.previewed_logs(spark, sf_dir), inputs.conversations(spark, sf_dir), inputs.messages(spark, sf_dir)
    )
    path = run_folder(spark, "logs")
    sinks.append_by_date(sinks.new_logs(integrity.accepted(checked), AS_OF), path)
    return spark.read.parquet(path).drop("id")


@query
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary, the latency series and the latest calls as JSON records."""

    def records(kind: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*"), events.KEEP_NULLS).alias("record"))

    series = latency_series(spark, sf_dir).withColumn("bucket", iso_utc("bucket"))
    latest = recent_logs(spark, sf_dir).withColumn("created_at", iso_utc("created_at"))
    return _all(
        [
            records("summary", metrics_summary(spark, sf_dir)),
            records("latency", series),
            records("log", latest),
        ]
    )


# Frames and calls


@query
def frames_openai(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frames_openai(inputs.openai_captures(spark, sf_dir)).drop("ts")


@query
def frames_gemini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.frames_gemini(inputs.gemini_captures(spark, sf_dir)).drop("ts")


@query
def fold_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_calls(inputs.calls(spark, sf_dir), inputs.chunks(spark, sf_dir))


@query
def resolve_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = inputs.messages(spark, sf_dir).withColumn("content", F.expr("if(role = 'assistant', '', content)"))
    replies = fold.call_replies(inputs.chunks(spark, sf_dir))
    return fold.resolve_placeholders(stored, replies.withColumnRenamed("call_id", "message_id"))


@query
def chat_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.chat_events_json(inputs.chunks(spark, sf_dir), inputs.calls(spark, sf_dir))


@query
def chat_events_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.chat_events_parse(inputs.event_captures(spark, sf_dir))


# Streams: each run takes in the whole table and then stops.


def _texts_left_out(events: DataFrame) -> DataFrame:
    no_text = F.lit(None).cast("string")
    return inputs.logs_of(events).withColumns({"input_preview": no_text, "output_preview": no_text})


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "ingest")

    def owners(session: SparkSession) -> tuple[DataFrame, DataFrame]:
        return inputs.conversations(session, sf_dir), inputs.messages(session, sf_dir)

    def start(events: DataFrame) -> StreamingQuery:
        return ingest.start_ingest(_texts_left_out(events), owners, f"{path}/logs", f"{path}/checkpoint", AS_OF)

    inputs.replayed(spark, sf_dir, "events", f"{path}/events", start)
    # Three of the four batches are read from their pack, the last one from its own folder.
    dated.compact(spark, f"{path}/logs", least=2)
    return ingest.ingested(spark, f"{path}/logs").drop("id", "batch_id", "input_preview", "output_preview")


@query
def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "latency")

    def start(events: DataFrame) -> StreamingQuery:
        return live.start_latency(inputs.logs_of(events), f"{path}/table", f"{path}/checkpoint")

    inputs.replayed(spark, sf_dir, "events", f"{path}/events", start)
    return live.live_latency(spark, f"{path}/table", inputs.logs(spark, sf_dir), AS_OF)


@query
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "summary")

    def start(events: DataFrame) -> StreamingQuery:
        return live.start_summary(inputs.logs_of(events), f"{path}/table", f"{path}/checkpoint")

    inputs.replayed(spark, sf_dir, "events", f"{path}/events", start)
    return live.live_summary(spark, f"{path}/table", inputs.logs(spark, sf_dir), AS_OF)


@query
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "recent")

    def start(events: DataFrame) -> StreamingQuery:
        return live.start_recent(_texts_left_out(events), f"{path}/table", f"{path}/checkpoint")

    inputs.replayed(spark, sf_dir, "events", f"{path}/events", start)
    return live.live_recent(spark, f"{path}/table")


@query
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = inputs.messages_of(inputs.stream_of(spark, sf_dir, "conversations"))
    chunks = inputs.chunks_of(inputs.replies_of(turns))
    path = run_folder(spark, "fold")

    def calls(session: SparkSession) -> DataFrame:
        return inputs.calls(session, sf_dir)

    call_stream.start_fold(chunks, calls, path, f"{path}/checkpoint").awaitTermination()
    return call_stream.folded(spark, calls, path, drained=True)
