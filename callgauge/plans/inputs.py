"""Conversations, messages, calls and captures as views over the given tables.

Everything here is derived row by row from whole tables, so it grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.functions.redaction import preview
from callgauge.operators.metrics import latest_calls

AS_OF = datetime(2024, 1, 31)

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def minutes(count: str) -> str:
    """An interval of so many minutes, for counts beyond 32 bits too."""
    return f"make_dt_interval(cast(({count}) div 1440 as int), 0, cast(({count}) % 1440 as int), 0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .select(F.col("conv_id").alias("id"))
        .distinct()
        .select(
            "id",
            F.expr("id % 10").alias("session_id"),
            F.lit("New conversation").alias("title"),
            F.expr(f"{EPOCH} + {minutes('id * 10')}").alias("created_at"),
        )
    )


def messages_of(turns: DataFrame) -> DataFrame:
    """One message per conversation turn; works on a stream as well."""
    return turns.select(
        F.expr("conv_id * 8 + turn").alias("id"),
        F.col("conv_id").alias("conversation_id"),
        "role",
        F.expr("case when role = 'assistant' and conv_id % 7 = 3 and turn < 2 then '' else text end").alias("content"),
        F.expr(f"{EPOCH} + {minutes('conv_id * 10 + turn')}").alias("created_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "conversations"))


def logs_of(events: DataFrame) -> DataFrame:
    """One call log per event; works on a stream as well."""
    failed = "event_type = 'error'"
    parsed = events.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k")
    return parsed.selectExpr(
        "event_id as id",
        "user_id as conversation_id",
        "user_id * 8 + event_id % 8 as message_id",
        "case when event_id % 3 = 0 then 'openai' else 'gemini' end as provider",
        "case when event_id % 3 = 0 then 'gpt-4o-mini' else 'gemini-3.1-flash-lite' end as model",
        "cast(round(value * 100) as bigint) as latency_ms",
        f"case when not {failed} then k end as input_tokens",
        f"case when not {failed} then k * 3 end as output_tokens",
        f"case when {failed} then 'error' else 'success' end as status",
        f"case when {failed} then concat('provider returned 429: key sk-', "
        "lpad(cast(event_id as string), 10, '0'), ' refused') end as error_msg",
        "ts as created_at",
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(table(spark, sf_dir, "events"))


def with_previews(calls: DataFrame, texts: DataFrame) -> DataFrame:
    """Calls with both previews: the reply they link to, and the message before it."""
    replies = texts.select(F.col("id").alias("message_id"), preview("content").alias("output_preview"))
    asked = texts.select((F.col("id") + 1).alias("message_id"), preview("content").alias("input_preview"))
    return calls.join(replies, "message_id", "left").join(asked, "message_id", "left")


def previewed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_previews(logs(spark, sf_dir), messages(spark, sf_dir))


def latest_previewed(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """The latest calls with previews. Only their messages are looked up and redacted: the
    ids of ``limit`` calls go to the message table."""
    latest = latest_calls(logs(spark, sf_dir), limit)
    linked = latest.select(F.explode(F.array("message_id", F.col("message_id") - 1)).alias("id")).distinct()
    return with_previews(latest, messages(spark, sf_dir).join(F.broadcast(linked), "id", "left_semi"))


def strict_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call logs as they might arrive: some break a rule of the log table."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "user_id as conversation_id",
        "case when event_type <> 'view' then user_id * 8 + event_id % 8 end as message_id",
        "'gpt-4o-mini' as model",
        "case when get_json_object(props, '$.k') <> '0' then 'openai' end as provider",
        "cast(round(value * 100) as bigint) as latency_ms",
        "case event_type when 'error' then 'error' when 'signup' then 'pending' else 'success' end as status",
    )


def strict_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as they might be opened: some name no session."""
    session = F.expr("nullif(session_id, 7)")
    return conversations(spark, sf_dir).withColumn("session_id", session)


def strict_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they might arrive: some break a rule of the message table."""
    return messages(spark, sf_dir).selectExpr(
        "id",
        "conversation_id",
        "case when id % 8 = 5 then 'tool' else role end as role",
        "nullif(content, '') as content",
        "created_at",
    )


def sent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as clients send them: some break a rule, some come twice, in the same words or
    in others, some name a session that isn't the conversation's."""
    sent = strict_messages(spark, sf_dir).drop("created_at")
    sent = sent.withColumn("session_id", F.expr("if(id % 11 = 4, conversation_id + 1, conversation_id) % 10"))
    again = sent.filter("id % 4 = 1").withColumn("content", F.expr("if(id % 3 = 0, content, concat(content, ' ~'))"))
    return sent.unionByName(again)


def event_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Three long conversations, made of all events, and their messages."""
    told = table(spark, sf_dir, "events").selectExpr(
        "event_id as id", "user_id % 3 as conversation_id", "'user' as role", "event_type as content", "ts as created_at"
    )
    return told.select(F.col("conversation_id").alias("id")).distinct(), told


def deleted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests: ids that the label table calls toxic."""
    return table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")).distinct()


def deleted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests: ids that the label table calls low quality."""
    return table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("id")).distinct()


def ownership_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as request_id", "user_id as conversation_id", "event_id % 10 as session_id"
    )


def replies_of(texts: DataFrame) -> DataFrame:
    """Assistant messages: the text of every call, with the words it was streamed in."""
    return texts.filter("role = 'assistant'").withColumn("words", F.split("content", " "))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies_of(messages(spark, sf_dir))


PIECE_BYTES = 97


def _pieces(texts: DataFrame, provider: str) -> DataFrame:
    """Whole response texts cut into network pieces that ignore line and character borders."""
    return (
        texts.withColumn("bytes", F.encode("body", "UTF-8"))
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, (octet_length(bytes) - 1) div {PIECE_BYTES})")))
        .select(
            F.col("id").alias("call_id"),
            F.lit(provider).alias("provider"),
            "piece",
            (F.col("created_at") + F.expr("make_dt_interval(0, 0, 0, piece * 0.005BD)")).alias("ts"),
            "http_status",
            F.expr(f"substring(bytes, cast(piece * {PIECE_BYTES} + 1 as int), {PIECE_BYTES})").alias("raw"),
        )
    )


WORD = "concat(w, if(i < size(words) - 1, ' ', ''))"
REFUSED = "concat('{\"error\":\"key sk-', lpad(cast(id as string), 12, '0'), ' refused\"}')"


def openai_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant message as an OpenAI response, in every way it may end."""
    frame = (
        "concat('data: ', to_json(named_struct('choices', array(named_struct('delta', "
        f"named_struct('content', {WORD}))))), '\\n\\n')"
    )
    body = f"""
      case when id % 13 = 0 then {REFUSED} else concat(
        ': connected\\ndata: {{"choices":[{{"delta":{{"role":"assistant"}}}}],"usage":null}}\\n\\n',
        array_join(transform(words, (w, i) -> {frame}), ''),
        case when id % 5 = 0 then 'data: {{"choices": [\\n\\ndata: [DONE]\\n\\n'
             when id % 7 = 0 then 'data: {{"choices":[],"usage":{{"prompt_tokens":"12","completion_tokens":7.5}}}}\\n\\n'
             when id % 11 = 0 then 'data: {{"choices":[],"usage":{{"prompt_tokens":12,"completion_tokens":7}}}}\\n'
             when id % 3 = 0 then concat('data: {{"usage":{{"prompt_tokens":', cast(4294967296 + id as string),
                                         ',"completion_tokens":4294967295}}}}\\r\\ndata:no space\\n\\ndata: [DONE]\\n\\n')
             else concat('data: {{"choices":[],"usage":{{"prompt_tokens":', cast(id as string), ',"completion_tokens":',
                         cast(size(words) as string), '}}}}\\n\\ndata: [DONE]\\n\\n',
                         'data: {{"choices":[{{"delta":{{"content":"late"}}}}]}}\\n\\n')
        end) end"""
    texts = replies(spark, sf_dir).selectExpr(
        "id", "created_at", "if(id % 13 = 0, 429, 200) as http_status", f"{body} as body"
    )
    return _pieces(texts, "openai")


def gemini_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant message as a Gemini response, in every way it may end."""
    frame = (
        "concat('data: ', to_json(named_struct('candidates', array(named_struct('content', "
        f"named_struct('parts', array(named_struct('text', {WORD}), named_struct('text', 'unread'))))))), '\\r\\n\\r\\n')"
    )
    usage = (
        "concat('{{\"promptTokenCount\":', cast(id as string), ',\"candidatesTokenCount\":', "
        "cast(size(words) as string), '}}')"
    ).replace("{{", "{").replace("}}", "}")
    body = f"""
      case when id % 13 = 0 then {REFUSED} else concat(
        array_join(transform(words, (w, i) -> {frame}), ''),
        case when id % 5 = 0 then concat('data: {{"candidates":[{{"content":{{"parts":[{{"text":"last"}}]}},',
                                         '"finishReason":"STOP"}}],"usageMetadata":', {usage},
                                         ',"error":{{"code":500}}}}\\r\\n\\r\\ndata: {{"error":null}}\\r\\n\\r\\n')
             when id % 7 = 0 then 'data: {{"error":{{"message":"quota"}}}}\\r\\n\\r\\ndata: {{broken\\r\\n\\r\\n'
             when id % 11 = 0 then 'data: {{"candidates":[{{"finishReason":"SAFETY"}}]}}\\r\\n\\r\\n'
             when id % 3 = 0 then 'data: {{broken\\r\\n\\r\\n'
             else concat('data: {{"candidates":[{{"finishReason":"STOP"}}],"usageMetadata":', {usage}, '}}\\r\\n\\r\\n')
        end) end"""
    texts = replies(spark, sf_dir).selectExpr(
        "id", "created_at", "if(id % 13 = 0, 503, 200) as http_status", f"{body} as body"
    )
    return _pieces(texts, "gemini")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call per assistant message; its input is the message before."""
    texts = messages(spark, sf_dir)
    asked = texts.select((F.col("id") + 1).alias("id"), F.col("content").alias("input_text"))
    return (
        replies(spark, sf_dir)
        .join(asked, "id", "left")
        .selectExpr(
            "id as call_id",
            "conversation_id",
            "id as message_id",
            "case when id % 3 = 0 then 'openai' else 'gemini' end as provider",
            "case when id % 3 = 0 then 'gpt-4o-mini' else 'gemini-3.1-flash-lite' end as model",
            "created_at as start_ts",
            "input_text",
        )
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(replies(spark, sf_dir))


def chunks_of(answers: DataFrame) -> DataFrame:
    """Every assistant message as chunk rows: word n is chunk 2n, ends are odd or after.

    id % 13 = 0 fails at once, id % 5 = 0 fails after the text (and one more token
    comes after that), id % 11 = 0 just stops, id % 7 = 0 has a done half-way too.
    """
    done = "named_struct('seq', {seq}, 'type', 'done', 'content', cast(null as string), 'input_tokens', {i}, 'output_tokens', {o}, 'error_msg', cast(null as string))"
    other = "named_struct('seq', {seq}, 'type', '{kind}', 'content', {content}, 'input_tokens', cast(null as int), 'output_tokens', cast(null as int), 'error_msg', {error})"
    null_text = "cast(null as string)"
    n = "cast(size(words) as bigint)"
    refused = "concat('provider returned 429: key sk-', lpad(cast(id as string), 12, '0'), ' refused')"
    tokens = f"transform(words, (w, i) -> {other.format(seq='cast(i as bigint) * 2', kind='token', content=WORD, error=null_text)})"
    half = done.format(seq=f"2 * ({n} div 2) + 1", i="cast(null as int)", o="cast(1 as int)")
    last = done.format(seq=f"2 * {n}", i="cast(id % 2147483648 as int)", o="cast(size(words) as int)")
    malformed = "'malformed stream chunk: mail ops@example.org'"
    failed = other.format(seq=f"2 * {n} + 1", kind="error", content=null_text, error=malformed)
    late = other.format(seq=f"2 * {n} + 2", kind="token", content="'late'", error=null_text)
    at_once = other.format(seq="0L", kind="call_error", content=null_text, error=refused)
    rows = f"""
      case when id % 13 = 0 then array({at_once}) else concat(
        {tokens},
        if(id % 7 = 0, array({half}), array()),
        case when id % 5 = 0 then array({failed}, {late}) when id % 11 = 0 then array() else array({last}) end) end"""
    return (
        answers.select(F.col("id").alias("call_id"), "created_at", F.explode(F.expr(rows)).alias("c"))
        .select(
            "call_id",
            "c.seq",
            F.expr("created_at + make_dt_interval(0, 0, 0, c.seq * 0.037BD)").alias("ts"),
            "c.type",
            "c.content",
            "c.input_tokens",
            "c.output_tokens",
            "c.error_msg",
        )
    )


def event_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chat client receives for the chunk rows, as network pieces.

    The events of a call are written one after another; after them, calls with
    id % 3 = 0 get an end marker and one more event, which does not count.
    """
    from callgauge.operators.events import chat_events_json
    from callgauge.operators.ordered import joined_text

    events = chat_events_json(chunks(spark, sf_dir), calls(spark, sf_dir)).withColumn(
        "frame", F.concat(F.lit("data: "), "event", F.lit("\n\n"))
    )
    tail = "if(call_id % 3 = 0, 'data: [DONE]\\n\\ndata: {\"content\":\"late\",\"type\":\"token\"}\\n\\n', '')"
    texts = joined_text(events, ["call_id"], "seq", "frame", "frames").select(
        F.col("call_id").alias("id"),
        F.expr(EPOCH).alias("created_at"),
        F.lit(200).alias("http_status"),
        F.concat("frames", F.expr(tail)).alias("body"),
    )
    return _pieces(texts, "app")


def stream_of(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A given table, one file or a folder of files, as a stream; ``max_files`` bounds a trigger.

    The path is a pattern that matches the table alone: a stream takes a folder or a
    pattern, not the name of a file.
    """
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def replayed(spark: SparkSession, sf_dir: str, name: str, path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Send a given table through a stream in two deliveries of two micro-batches each.

    Rows are dealt by a hash of all columns. ``start`` gets the stream of what lies in the
    folder and is called once for each delivery, so the second run goes on from the
    checkpoint of the first.
    """
    rows = table(spark, sf_dir, name)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(4)).cast("int"))
    seen = 0
    for parts in ((0, 1), (2, 3)):
        dealt.filter(F.col("part").isin(*parts)).write.mode("append").partitionBy("part").parquet(path)
        there = len(spark.read.schema(dealt.schema).parquet(path).inputFiles())
        stream = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", max(1, -(-(there - seen) // 2)))
        start(stream.parquet(path).drop("part")).awaitTermination()
        seen = there
