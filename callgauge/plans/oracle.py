"""The SQL twin of every query, for DuckDB on the same tables.

Each text is written against the meaning of a query, not after its Spark plan:
calls are folded by joining ends with earlier tokens, frames are cut at blank
lines, ranks are taken over whole groups.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"

CONVERSATIONS = f"""
conv AS (
  SELECT DISTINCT conv_id AS id, conv_id % 10 AS session_id, 'New conversation' AS title,
         {EPOCH} + to_minutes(conv_id * 10) AS created_at
  FROM conversations)"""

MESSAGES = f"""
msg AS (
  SELECT conv_id * 8 + turn AS id, conv_id AS conversation_id, role,
         CASE WHEN role = 'assistant' AND conv_id % 7 = 3 AND turn < 2 THEN '' ELSE text END AS content,
         {EPOCH} + to_minutes(conv_id * 10 + turn) AS created_at
  FROM conversations)"""

LOGS = """
log AS (
  SELECT event_id AS id, user_id AS conversation_id, user_id * 8 + event_id % 8 AS message_id,
         CASE WHEN event_id % 3 = 0 THEN 'openai' ELSE 'gemini' END AS provider,
         CASE WHEN event_id % 3 = 0 THEN 'gpt-4o-mini' ELSE 'gemini-3.1-flash-lite' END AS model,
         CAST(round(value * 100) AS BIGINT) AS latency_ms,
         CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) END AS input_tokens,
         CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INT) * 3 END AS output_tokens,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error'
              THEN 'provider returned 429: key sk-' || lpad(CAST(event_id AS VARCHAR), 10, '0') || ' refused'
         END AS error_msg,
         ts AS created_at
  FROM events)"""


def redacted(text: str) -> str:
    """Six passes with ASCII classes; the first also allows a non-ASCII letter after a card."""
    rules = [
        (r"\b(?:\d[ -]?){12,18}\d(?:[ -]([^\x00-\x7F])|[ -]?\b)", r"[REDACTED:card]\1"),
        (r"\b[\w.+%-]+@[\w-]+(?:\.[\w-]+)+\b", "[REDACTED:email]"),
        (r"\b(?:sk|pk|api|key|token|xox[baprs])-[A-Za-z0-9_\-]{8,}\b", "[REDACTED:secret]"),
        (r"\bBearer\s+[A-Za-z0-9._\-]{10,}\b", "[REDACTED:secret]"),
        (r"\bAIza[0-9A-Za-z_\-]{10,}\b", "[REDACTED:secret]"),
        (r"\+\d{1,3}[\d .\-()]{8,16}\d|\b\d{10}\b", "[REDACTED:phone]"),
    ]
    for pattern, tag in rules:
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g')"
    return text


def preview(text: str) -> str:
    return f"substring({redacted(text)}, 1, 500)"


def iso_utc(ts: str) -> str:
    micros = f"(epoch_us({ts}) % 1000000)"
    decimals = (
        f"CASE WHEN {micros} = 0 THEN '' WHEN {micros} % 1000 = 0 THEN '.' || lpad(CAST({micros} // 1000 AS VARCHAR), 3, '0') "
        f"ELSE '.' || lpad(CAST({micros} AS VARCHAR), 6, '0') END"
    )
    return f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || {decimals} || 'Z')"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


SUMMARY = f"""
summary AS (
  SELECT count(*) AS total_calls,
         count(*) FILTER (WHERE status = 'error') AS error_count,
         CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE status = 'error') / count(*) ELSE 0.0 END AS error_rate,
         coalesce(avg(latency_ms), 0) AS avg_latency_ms,
         percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_latency_ms,
         CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
         CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
         count(*) FILTER (WHERE created_at > {AS_OF} - INTERVAL 1 HOUR) AS calls_last_hour
  FROM log)"""

SERIES = f"""
series AS (
  SELECT date_trunc('minute', created_at) - to_minutes(extract(minute FROM created_at) % 5) AS bucket,
         avg(latency_ms) AS avg_latency_ms, count(*) AS calls,
         count(*) FILTER (WHERE status = 'error') AS error_count
  FROM log WHERE created_at > {AS_OF} - INTERVAL 24 HOUR GROUP BY 1)"""

PREVIEWED = f"""
previewed AS (
  SELECT log.*, {preview('asked.content')} AS input_preview, {preview('reply.content')} AS output_preview
  FROM log LEFT JOIN msg reply ON reply.id = log.message_id
           LEFT JOIN msg asked ON asked.id + 1 = log.message_id)"""

LOG_COLUMNS = (
    "id, conversation_id, model, provider, latency_ms, input_tokens, output_tokens, status, error_msg, "
    "input_preview, output_preview, created_at"
)

LATEST = f"""
latest AS (SELECT {LOG_COLUMNS} FROM previewed ORDER BY created_at DESC, id DESC LIMIT 100)"""

TITLED = """
firsts AS (
  SELECT conversation_id, left(content, 40) AS title,
         row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS n
  FROM msg WHERE role = 'user' AND left(content, 40) <> 'New conversation'),
titled AS (
  SELECT conv.id, conv.session_id, coalesce(firsts.title, conv.title) AS title, conv.created_at
  FROM conv LEFT JOIN firsts ON firsts.conversation_id = conv.id AND firsts.n = 1)"""

ACTIVITY = """
activity AS (
  SELECT titled.*, greatest(titled.created_at,
    coalesce((SELECT max(m.created_at) FROM msg m WHERE m.conversation_id = titled.id AND m.role = 'user'), titled.created_at),
    coalesce((SELECT max(l.created_at) FROM msg m JOIN log l ON l.message_id = m.id
              WHERE m.conversation_id = titled.id AND m.role = 'assistant' AND m.content <> '' AND l.status = 'success'),
             titled.created_at)) AS updated_at
  FROM titled)"""

HISTORY = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) AS n FROM msg),
shown AS (
  SELECT id, conversation_id, role, content, {iso_utc('created_at')} AS at, created_at FROM ranked WHERE n <= 200)"""


def prompts(n: int) -> str:
    return f"""
prompt AS (
  SELECT * FROM (
    SELECT conversation_id, id AS message_id, role AS own_role,
           list({{'role': role, 'content': content}}) OVER (PARTITION BY conversation_id ORDER BY created_at, id
             ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS messages
    FROM msg) WHERE own_role = 'user')"""


REPLIES = """
reply AS (
  SELECT id, conversation_id, created_at, string_split(content, ' ') AS words FROM msg WHERE role = 'assistant')"""

WORD = "w || CASE WHEN i < len(words) THEN ' ' ELSE '' END"

CHUNKS = f"""
chunk AS (
  SELECT call_id, seq, created_at + to_milliseconds(seq * 37) AS ts, type, content, input_tokens, output_tokens, error_msg
  FROM (
    SELECT id AS call_id, created_at, (generate_subscripts(words, 1) - 1) * 2 AS seq, 'token' AS type,
           unnest(list_transform(words, lambda w, i: {WORD})) AS content,
           CAST(NULL AS INT) AS input_tokens, CAST(NULL AS INT) AS output_tokens, CAST(NULL AS VARCHAR) AS error_msg
    FROM reply WHERE id % 13 <> 0
    UNION ALL
    SELECT id, created_at, 2 * (len(words) // 2) + 1, 'done', NULL, NULL, 1, NULL
    FROM reply WHERE id % 13 <> 0 AND id % 7 = 0
    UNION ALL
    SELECT id, created_at, 2 * len(words), 'done', NULL, CAST(id AS INT), CAST(len(words) AS INT), NULL
    FROM reply WHERE id % 13 <> 0 AND id % 5 <> 0 AND id % 11 <> 0
    UNION ALL
    SELECT id, created_at, 2 * len(words) + 1, 'error', NULL, NULL, NULL, 'malformed stream chunk: mail ops@example.org'
    FROM reply WHERE id % 13 <> 0 AND id % 5 = 0
    UNION ALL
    SELECT id, created_at, 2 * len(words) + 2, 'token', 'late', NULL, NULL, NULL
    FROM reply WHERE id % 13 <> 0 AND id % 5 = 0
    UNION ALL
    SELECT id, created_at, 0, 'call_error', NULL, NULL, NULL,
           'provider returned 429: key sk-' || lpad(CAST(id AS VARCHAR), 12, '0') || ' refused'
    FROM reply WHERE id % 13 = 0)),
live AS (
  SELECT * FROM chunk c WHERE NOT EXISTS (
    SELECT 1 FROM chunk e WHERE e.call_id = c.call_id AND e.type IN ('error', 'call_error') AND e.seq < c.seq))"""

OUTCOMES = """
usage AS (
  SELECT *, last_value(CASE WHEN type = 'done' THEN {'i': input_tokens, 'o': output_tokens} END IGNORE NULLS)
              OVER (PARTITION BY call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u
  FROM live),
outcome AS (
  SELECT e.call_id, e.seq, e.type, e.ts, e.u.i AS input_tokens, e.u.o AS output_tokens, e.error_msg,
         coalesce((SELECT string_agg(t.content, '' ORDER BY t.seq) FROM live t
                   WHERE t.call_id = e.call_id AND t.type = 'token' AND t.seq < e.seq), '') AS text
  FROM usage e WHERE e.type <> 'token')"""

FOLDED = f"""
folded AS (
  SELECT o.call_id, o.seq, r.conversation_id, o.call_id AS message_id,
         CASE WHEN o.call_id % 3 = 0 THEN 'gpt-4o-mini' ELSE 'gemini-3.1-flash-lite' END AS model,
         CASE WHEN o.call_id % 3 = 0 THEN 'openai' ELSE 'gemini' END AS provider,
         (epoch_us(o.ts) - epoch_us(r.created_at)) // 1000 AS latency_ms,
         o.input_tokens, o.output_tokens,
         CASE WHEN o.type = 'done' THEN 'success' ELSE 'error' END AS status,
         {redacted('o.error_msg')} AS error_msg,
         {preview('asked.content')} AS input_preview,
         CASE WHEN o.type <> 'call_error' THEN {preview('o.text')} END AS output_preview
  FROM outcome o JOIN reply r ON r.id = o.call_id LEFT JOIN msg asked ON asked.id + 1 = o.call_id)"""


def numbered_lines(body: str, drop_returns: bool) -> str:
    """Lines of complete frames, numbered as in the whole text, and their data."""
    text = f"replace({body}, chr(13), '')" if drop_returns else body
    return f"""
frame AS (
  SELECT id, unnest(f) AS frame, generate_subscripts(f, 1) - 1 AS fi
  FROM (SELECT id, list_slice(string_split({text}, E'\\n\\n'), 1, -2) AS f FROM body WHERE id % 13 <> 0)),
line AS (
  SELECT id, fi, unnest(string_split(frame, E'\\n')) AS text, generate_subscripts(string_split(frame, E'\\n'), 1) AS li
  FROM frame),
data AS (
  SELECT id, line, data, CASE WHEN json_valid(data) THEN CAST(data AS JSON) END AS j FROM (
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY fi, li) - 1 + fi AS line, text,
           rtrim(substring(text, 7), chr(13)) AS data
    FROM line) WHERE starts_with(text, 'data: '))"""


def json_count(path: str) -> str:
    value = f"CAST(json_extract_string(j, '{path}') AS HUGEINT)"
    return (
        f"CASE WHEN json_type(j, '{path}') IN ('BIGINT', 'UBIGINT') "
        f"THEN CAST(({value} + 2147483648) % 4294967296 - 2147483648 AS INT) END"
    )


def json_text(path: str) -> str:
    return f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN json_extract_string(j, '{path}') END"


REFUSED = "'{\"error\":\"key sk-' || lpad(CAST(id AS VARCHAR), 12, '0') || ' refused\"}'"

OPENAI_BODY = f"""
body AS (
  SELECT id, CASE WHEN id % 13 = 0 THEN {REFUSED} ELSE
    E': connected\\ndata: {{"choices":[{{"delta":{{"role":"assistant"}}}}],"usage":null}}\\n\\n'
    || array_to_string(list_transform(words, lambda w, i:
         'data: ' || CAST(to_json({{'choices': [{{'delta': {{'content': {WORD}}}}}]}}) AS VARCHAR) || E'\\n\\n'), '')
    || CASE WHEN id % 5 = 0 THEN E'data: {{"choices": [\\n\\ndata: [DONE]\\n\\n'
            WHEN id % 7 = 0 THEN E'data: {{"choices":[],"usage":{{"prompt_tokens":"12","completion_tokens":7.5}}}}\\n\\n'
            WHEN id % 11 = 0 THEN E'data: {{"choices":[],"usage":{{"prompt_tokens":12,"completion_tokens":7}}}}\\n'
            WHEN id % 3 = 0 THEN 'data: {{"usage":{{"prompt_tokens":' || CAST(4294967296 + id AS VARCHAR)
                 || E',"completion_tokens":4294967295}}}}\\r\\ndata:no space\\n\\ndata: [DONE]\\n\\n'
            ELSE 'data: {{"choices":[],"usage":{{"prompt_tokens":' || CAST(id AS VARCHAR) || ',"completion_tokens":'
                 || CAST(len(words) AS VARCHAR) || E'}}}}\\n\\ndata: [DONE]\\n\\n'
                 || E'data: {{"choices":[{{"delta":{{"content":"late"}}}}]}}\\n\\n' END
  END AS text FROM reply)"""

GEMINI_USAGE = "'{\"promptTokenCount\":' || CAST(id AS VARCHAR) || ',\"candidatesTokenCount\":' || CAST(len(words) AS VARCHAR) || '}'"

GEMINI_BODY = f"""
body AS (
  SELECT id, CASE WHEN id % 13 = 0 THEN {REFUSED} ELSE
    array_to_string(list_transform(words, lambda w, i:
         'data: ' || CAST(to_json({{'candidates': [{{'content': {{'parts': [{{'text': {WORD}}}, {{'text': 'unread'}}]}}}}]}}) AS VARCHAR)
         || E'\\r\\n\\r\\n'), '')
    || CASE WHEN id % 5 = 0 THEN 'data: {{"candidates":[{{"content":{{"parts":[{{"text":"last"}}]}},"finishReason":"STOP"}}],"usageMetadata":'
                 || {GEMINI_USAGE} || E',"error":{{"code":500}}}}\\r\\n\\r\\ndata: {{"error":null}}\\r\\n\\r\\n'
            WHEN id % 7 = 0 THEN E'data: {{"error":{{"message":"quota"}}}}\\r\\n\\r\\ndata: {{broken\\r\\n\\r\\n'
            WHEN id % 11 = 0 THEN E'data: {{"candidates":[{{"finishReason":"SAFETY"}}]}}\\r\\n\\r\\n'
            WHEN id % 3 = 0 THEN E'data: {{broken\\r\\n\\r\\n'
            ELSE 'data: {{"candidates":[{{"finishReason":"STOP"}}],"usageMetadata":' || {GEMINI_USAGE} || E'}}\\r\\n\\r\\n' END
  END AS text FROM reply)"""


def failed_request(status: int) -> str:
    return f"""
SELECT id AS call_id, CAST(0 AS BIGINT) AS seq, 'call_error' AS type, CAST(NULL AS VARCHAR) AS content,
       CAST(NULL AS INT) AS input_tokens, CAST(NULL AS INT) AS output_tokens,
       'provider returned {status}: ' || text AS error_msg
FROM body WHERE id % 13 = 0"""


OPENAI_FRAMES = f"""
{with_(MESSAGES, REPLIES, OPENAI_BODY, numbered_lines('text', False))},
kept AS (
  SELECT *, json_type(j, '$.usage') IS NOT NULL AND json_type(j, '$.usage') <> 'NULL' AS has_usage,
         {json_text('$.choices[0].delta.content')} AS token
  FROM data d WHERE data <> '[DONE]'
    AND NOT EXISTS (SELECT 1 FROM data e WHERE e.id = d.id AND e.data = '[DONE]' AND e.line < d.line))
SELECT id AS call_id, line * 4 + 2 AS seq, 'error' AS type, NULL AS content, NULL AS input_tokens, NULL AS output_tokens,
       'malformed stream chunk: invalid JSON' AS error_msg
FROM kept WHERE j IS NULL
UNION ALL
SELECT id, line * 4 + 1, 'done', NULL, {json_count('$.usage.prompt_tokens')}, {json_count('$.usage.completion_tokens')}, NULL
FROM kept WHERE has_usage
UNION ALL
SELECT id, line * 4, 'token', token, NULL, NULL, NULL FROM kept WHERE j IS NOT NULL AND NOT coalesce(has_usage, false) AND token IS NOT NULL
UNION ALL {failed_request(429)}"""

GEMINI_FRAMES = f"""
{with_(MESSAGES, REPLIES, GEMINI_BODY, numbered_lines('text', True))},
kept AS (
  SELECT *, {json_text('$.candidates[0].content.parts[0].text')} AS token, json_type(j, '$.error') IS NOT NULL AS failed
  FROM data d
  WHERE NOT EXISTS (SELECT 1 FROM data e WHERE e.id = d.id AND json_type(e.j, '$.error') IS NOT NULL AND e.line < d.line))
SELECT id AS call_id, line * 4 AS seq, 'token' AS type, token AS content, NULL AS input_tokens, NULL AS output_tokens,
       NULL AS error_msg
FROM kept WHERE token <> ''
UNION ALL
SELECT id, line * 4 + 1, 'done', NULL, {json_count('$.usageMetadata.promptTokenCount')},
       {json_count('$.usageMetadata.candidatesTokenCount')}, NULL
FROM kept WHERE json_type(j, '$.candidates[0].finishReason') = 'VARCHAR' AND json_type(j, '$.usageMetadata') IS NOT NULL
UNION ALL
SELECT id, line * 4 + 2, 'error', NULL, NULL, NULL,
       'malformed stream chunk: ' || CASE WHEN j IS NULL THEN 'invalid JSON'
         ELSE coalesce({json_text('$.error.message')}, 'unknown gemini error') END
FROM kept WHERE j IS NULL OR failed
UNION ALL {failed_request(503)}"""

CHECKED_LOGS = """
checked AS (
  SELECT l.*, CASE WHEN l.conversation_id IS NULL THEN 'conversation_id is null'
    WHEN l.model IS NULL THEN 'model is null' WHEN l.provider IS NULL THEN 'provider is null'
    WHEN l.latency_ms IS NULL THEN 'latency_ms is null' WHEN l.status IS NULL THEN 'status is null'
    WHEN l.status NOT IN ('success', 'error') THEN 'status not allowed'
    WHEN l.conversation_id NOT IN (SELECT id FROM conv) THEN 'conversation not found'
    WHEN l.message_id IS NOT NULL AND l.message_id NOT IN (SELECT id FROM msg) THEN 'message not found' END AS reason
  FROM {source} l)"""

STRICT_LOGS = """
strict AS (
  SELECT event_id AS id, user_id AS conversation_id,
         CASE WHEN event_type <> 'view' THEN user_id * 8 + event_id % 8 END AS message_id, 'gpt-4o-mini' AS model,
         CASE WHEN json_extract_string(props, '$.k') <> '0' THEN 'openai' END AS provider,
         CAST(round(value * 100) AS BIGINT) AS latency_ms,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'pending' ELSE 'success' END AS status
  FROM events)"""

TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"
POOR = "(SELECT doc_id FROM labels WHERE quality = 0)"

CARDS = f"""
SELECT CAST(total_calls AS VARCHAR) AS total_calls,
       CASE WHEN error_rate = 0 THEN '0%' ELSE printf('%.1f%%', error_rate * 100) END AS error_rate,
       CASE WHEN error_rate > 0.05 THEN 'bad' WHEN error_rate = 0 THEN 'good' ELSE 'neutral' END AS error_class,
       CAST(error_count AS VARCHAR) || ' failed' AS failed,
       printf('%.0f', avg_latency_ms) || ' ms' AS avg_latency,
       'p95 ' || CASE WHEN p95_latency_ms IS NULL THEN '—' ELSE printf('%.0f', p95_latency_ms) END || ' ms' AS p95_latency,
       CAST(calls_last_hour AS VARCHAR) AS calls_last_hour,
       format('{{:,}}', total_input_tokens + total_output_tokens) AS tokens,
       format('{{:,}}', total_input_tokens) || ' in · ' || format('{{:,}}', total_output_tokens) || ' out' AS tokens_split
FROM summary"""

ORACLE: dict[str, str] = {
    "metrics_summary": f"{with_(LOGS, SUMMARY)} SELECT * FROM summary",
    "latency_series": f"{with_(LOGS, SERIES)} SELECT * FROM series ORDER BY bucket",
    "recent_logs": f"{with_(MESSAGES, LOGS, PREVIEWED, LATEST)} SELECT * FROM latest",
    "log_display": f"""{with_(MESSAGES, LOGS, PREVIEWED, LATEST)}
        SELECT id, created_at, provider || '/' || model AS model_label, CAST(latency_ms AS VARCHAR) || 'ms' AS latency_label,
               coalesce(CAST(input_tokens AS VARCHAR), '?') || '/' || coalesce(CAST(output_tokens AS VARCHAR), '?') AS tokens_label,
               status, CASE status WHEN 'success' THEN 'ok' WHEN 'error' THEN 'err' END AS status_class,
               coalesce(input_preview, '') AS input_preview, coalesce(output_preview, '') AS output_preview
        FROM latest""",
    "summary_cards": f"{with_(LOGS, SUMMARY)} {CARDS}",
    "chart_points": f"""{with_(LOGS, SERIES)}
        SELECT bucket, i / (n - 1) * 860 AS x, 220 - avg_latency_ms / top * 190 AS y FROM (
          SELECT bucket, avg_latency_ms, row_number() OVER (ORDER BY bucket) - 1 AS i, count(*) OVER () AS n,
                 greatest(max(avg_latency_ms) OVER (), 1) AS top FROM series) WHERE n >= 2""",
    "redact_text": f"""
        SELECT 'document' AS kind, doc_id AS id, {redacted('text')} AS text FROM documents
        UNION ALL SELECT 'page', page_id, {redacted('html')} FROM pages""",
    "redact_errors": f"""{with_(LOGS)}
        SELECT id, {redacted('error_msg')} AS error_msg FROM log WHERE error_msg IS NOT NULL""",
    "truncate_text": "SELECT doc_id, substring(text, 1, 500) AS text FROM documents",
    "input_previews": f"""{with_(MESSAGES)}
        SELECT conversation_id, id AS message_id, {preview('content')} AS input_preview FROM msg WHERE role = 'user'""",
    "format_errors": """
        SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'http error: ' || props
          WHEN 1 THEN 'provider returned ' || CAST(400 + event_id % 100 AS VARCHAR) || ': ' || props
          WHEN 2 THEN 'malformed stream chunk: ' || props ELSE 'internal: ' || props END AS error_msg
        FROM events WHERE event_type = 'error'""",
    "clean_inputs": f"""{with_(MESSAGES)}
        SELECT id, text FROM (
          SELECT id, regexp_replace(content, '^[\\s\\v\\p{{Z}}\\x{{FEFF}}]+|[\\s\\v\\p{{Z}}\\x{{FEFF}}]+$', '', 'g') AS text FROM msg)
        WHERE text <> ''""",
    "last_n_messages": f"""{with_(MESSAGES)}
        SELECT id, conversation_id, role, content, created_at FROM msg
        QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) <= 3""",
    "last_n_calls": f"""{with_(LOGS)}
        SELECT conversation_id, id, created_at FROM log
        QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, id DESC) <= 20""",
    "conversation_titles": f"{with_(CONVERSATIONS, MESSAGES, TITLED)} SELECT * FROM titled",
    "conversation_activity": f"""{with_(CONVERSATIONS, MESSAGES, LOGS, 'titled AS (SELECT * FROM conv)', ACTIVITY)}
        SELECT * FROM activity""",
    "session_feed": f"""{with_(CONVERSATIONS, MESSAGES, LOGS, TITLED, ACTIVITY)}
        SELECT session_id, id, title, created_at, updated_at FROM activity ORDER BY session_id, updated_at DESC, id DESC""",
    "feed_labels": f"""{with_(CONVERSATIONS, MESSAGES, LOGS, TITLED, ACTIVITY)}
        SELECT session_id, id, coalesce(nullif(title, ''), 'Untitled') AS title,
               CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago'
                    WHEN m < 1440 THEN CAST(m // 60 AS VARCHAR) || 'h ago'
                    WHEN m < 10080 THEN CAST(m // 1440 AS VARCHAR) || 'd ago'
                    ELSE strftime(updated_at, '%Y-%m-%d') END AS age
        FROM (SELECT *, (epoch_us({AS_OF}) - epoch_us(updated_at)) // 60000000 AS m FROM activity)""",
    "ownership_check": f"""{with_(CONVERSATIONS)}
        SELECT event_id AS request_id, user_id AS conversation_id, event_id % 10 AS session_id,
               EXISTS (SELECT 1 FROM conv WHERE conv.id = user_id AND conv.session_id = event_id % 10) AS found
        FROM events""",
    "conversation_history": """
        SELECT conversation_id AS id, count(*) AS n_messages,
               string_agg(event_id || ':' || event_type, ',' ORDER BY ts, event_id) AS messages
        FROM (SELECT *, user_id % 3 AS conversation_id FROM events
              QUALIFY row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id DESC) <= 200)
        GROUP BY conversation_id""",
    "conversation_detail": f"""{with_(CONVERSATIONS, MESSAGES, LOGS, TITLED, ACTIVITY, HISTORY)}
        SELECT c.id, c.title, c.created_at, c.updated_at, CAST(coalesce((
          SELECT to_json(list({{'id': s.id, 'role': s.role, 'content': s.content, 'created_at': s.at}} ORDER BY s.created_at, s.id))
          FROM shown s WHERE s.conversation_id = c.id), '[]') AS VARCHAR) AS messages
        FROM activity c""",
    "resume_view": f"""{with_(CONVERSATIONS, MESSAGES, HISTORY)}
        SELECT c.id, CAST(coalesce((
          SELECT to_json(list({{'id': s.id, 'role': s.role, 'content': s.content, 'created_at': s.at}} ORDER BY s.created_at, s.id))
          FROM shown s WHERE s.conversation_id = c.id AND NOT (s.role = 'assistant' AND s.content = '')), '[]') AS VARCHAR) AS messages
        FROM conv c""",
    "prompt_context": f"""{with_(MESSAGES, prompts(3))}
        SELECT conversation_id, message_id, CAST(to_json(messages) AS VARCHAR) AS messages FROM prompt""",
    "prompt_openai": f"""{with_(MESSAGES, prompts(20))}
        SELECT conversation_id, message_id, CAST(to_json({{
          'messages': list_transform(messages, lambda m: {{'content': m.content, 'role': m.role}}),
          'model': 'gpt-4o-mini', 'stream': true, 'stream_options': {{'include_usage': true}}}}) AS VARCHAR) AS body
        FROM prompt""",
    "prompt_gemini": f"""{with_(MESSAGES, prompts(20))}
        SELECT conversation_id, message_id, CAST(to_json({{
          'contents': list_transform(messages, lambda m: {{'parts': [{{'text': m.content}}],
             'role': CASE m.role WHEN 'assistant' THEN 'model' WHEN 'system' THEN 'user' ELSE m.role END}}),
          'generationConfig': {{'maxOutputTokens': 2048, 'thinkingConfig': {{'thinkingLevel': 'minimal'}}}},
          'safetySettings': [
            {{'category': 'HARM_CATEGORY_HARASSMENT', 'threshold': 'BLOCK_NONE'}},
            {{'category': 'HARM_CATEGORY_HATE_SPEECH', 'threshold': 'BLOCK_NONE'}},
            {{'category': 'HARM_CATEGORY_SEXUALLY_EXPLICIT', 'threshold': 'BLOCK_NONE'}},
            {{'category': 'HARM_CATEGORY_DANGEROUS_CONTENT', 'threshold': 'BLOCK_NONE'}}]}}) AS VARCHAR) AS body
        FROM prompt""",
    "integrity_logs": f"""{with_(CONVERSATIONS, MESSAGES, STRICT_LOGS, CHECKED_LOGS.format(source='strict'))}
        SELECT id, reason FROM checked""",
    "integrity_messages": f"""{with_(MESSAGES)}
        SELECT id, CASE WHEN nullif(content, '') IS NULL THEN 'content is null'
          WHEN id % 8 = 5 THEN 'role not allowed'
          WHEN conversation_id IN {TOXIC} THEN 'conversation not found' END AS reason FROM msg""",
    "integrity_conversations": f"""{with_(CONVERSATIONS)}
        SELECT id, nullif(session_id, 7) AS session_id,
               CASE WHEN session_id = 7 THEN 'session_id is null' END AS reason FROM conv""",
    "integrity_keys": """
        SELECT id, event_type, created_at, copies,
               row_number() OVER (PARTITION BY id ORDER BY created_at, event_type) = 1 AS kept
        FROM (SELECT user_id AS id, event_type, ts AS created_at, count(*) AS copies FROM events GROUP BY ALL)""",
    "cascade_delete": f"""{with_(CONVERSATIONS, MESSAGES, LOGS)}
        SELECT 'conversation' AS kind, id FROM conv WHERE id NOT IN {TOXIC}
        UNION ALL SELECT 'message', id FROM msg WHERE conversation_id NOT IN {TOXIC}
        UNION ALL SELECT 'log', id FROM log WHERE conversation_id NOT IN {TOXIC}""",
    "cascade_set_null": f"""{with_(LOGS)}
        SELECT id, conversation_id, CASE WHEN message_id NOT IN {POOR} THEN message_id END AS message_id FROM log""",
    "stored_deletes": f"""{with_(CONVERSATIONS, MESSAGES, LOGS)}
        SELECT 'conversation' AS kind, id, CAST(NULL AS BIGINT) AS message_id FROM conv WHERE id NOT IN {TOXIC}
        UNION ALL SELECT 'message', id, NULL FROM msg WHERE conversation_id NOT IN {TOXIC} AND id NOT IN {POOR}
        UNION ALL SELECT 'log', id, CASE WHEN message_id NOT IN {POOR}
          AND message_id NOT IN (SELECT id FROM msg WHERE conversation_id IN {TOXIC}) THEN message_id END
        FROM log WHERE conversation_id NOT IN {TOXIC}""",
    "logs_with_reply": f"""{with_(MESSAGES, LOGS)}
        SELECT log.id, log.message_id, log.status, msg.role AS reply_role, msg.content AS reply
        FROM log LEFT JOIN msg ON msg.id = log.message_id""",
    "open_conversations": f"""
        SELECT user_id AS session_id, 'New conversation' AS title, {AS_OF} AS created_at, {AS_OF} AS updated_at
        FROM events WHERE event_type = 'signup'""",
    "store_conversations": f"""
        SELECT nullif(user_id % 7, 3) AS session_id, 'New conversation' AS title, {AS_OF} AS created_at, {AS_OF} AS updated_at,
               CASE WHEN user_id % 7 = 3 THEN 'session_id is null' END AS reason,
               CASE WHEN user_id % 7 = 3 THEN 'refused' ELSE 'stored' END AS outcome
        FROM events WHERE event_type = 'signup'""",
    "store_messages": f"""{with_(CONVERSATIONS, MESSAGES)},
        first AS (
          SELECT id, conversation_id, CASE WHEN id % 8 = 5 THEN 'tool' ELSE role END AS role, nullif(content, '') AS content,
                 (CASE WHEN id % 11 = 4 THEN conversation_id + 1 ELSE conversation_id END) % 10 AS session_id FROM msg),
        sent AS (
          SELECT * FROM first UNION ALL
          SELECT id, conversation_id, role, CASE WHEN id % 3 = 0 THEN content ELSE content || ' ~' END, session_id
          FROM first WHERE id % 4 = 1),
        batches AS (SELECT *, conversation_id % 3 AS batch FROM sent UNION ALL SELECT *, 3 FROM sent WHERE id % 5 = 0),
        ruled AS (
          SELECT batches.*, CASE WHEN content IS NULL THEN 'content is null' WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role not allowed'
                 WHEN c.id IS NULL THEN 'conversation not found' END AS rule
          FROM batches LEFT JOIN conv c ON c.id = conversation_id AND c.session_id = batches.session_id),
        good AS (SELECT batch, id, content, count(*) AS copies FROM ruled WHERE rule IS NULL GROUP BY ALL),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY batch, id ORDER BY content) AS place, min(batch) OVER (PARTITION BY id) < batch AS taken FROM good)
        SELECT CAST(id AS VARCHAR) AS id, content, 'refused' AS outcome, rule AS reason, 1 AS copies FROM ruled WHERE rule IS NOT NULL
        UNION ALL SELECT CAST(id AS VARCHAR), content, 'refused', 'id taken', copies FROM placed WHERE taken
        UNION ALL SELECT CAST(id AS VARCHAR), content, 'stored', NULL, 1 FROM placed WHERE NOT taken AND place = 1
        UNION ALL SELECT CAST(id AS VARCHAR), content, 'refused', 'id repeated', copies - (place = 1)::INT FROM placed
        WHERE NOT taken AND copies > (place = 1)::INT""",
    "append_messages": f"""{with_(MESSAGES)}
        SELECT CASE WHEN role <> 'user' THEN CAST(id AS VARCHAR) END AS id, conversation_id, role, content,
               {AS_OF} AS created_at FROM msg""",
    "ingest_logs": f"""{with_(CONVERSATIONS, MESSAGES, LOGS, PREVIEWED, CHECKED_LOGS.format(source='previewed'))}
        SELECT conversation_id, message_id, model, provider, latency_ms, input_tokens, output_tokens, status, error_msg,
               input_preview, output_preview, {AS_OF} AS created_at, CAST({AS_OF} AS DATE) AS log_date
        FROM checked WHERE reason IS NULL""",
    "results_json": f"""{with_(MESSAGES, LOGS, SUMMARY, SERIES, PREVIEWED, LATEST)}
        SELECT 'summary' AS kind, CAST(to_json(s) AS VARCHAR) AS record FROM summary s
        UNION ALL
        SELECT 'latency', CAST(to_json(s) AS VARCHAR) FROM (SELECT * REPLACE ({iso_utc('bucket')} AS bucket) FROM series) s
        UNION ALL
        SELECT 'log', CAST(to_json(l) AS VARCHAR) FROM (SELECT * REPLACE ({iso_utc('created_at')} AS created_at) FROM latest) l""",
    "frames_openai": OPENAI_FRAMES,
    "frames_gemini": GEMINI_FRAMES,
    "fold_calls": f"{with_(MESSAGES, REPLIES, CHUNKS, OUTCOMES, FOLDED)} SELECT * FROM folded",
    "resolve_placeholders": f"""{with_(MESSAGES, REPLIES, CHUNKS, OUTCOMES)}
        SELECT m.id, m.conversation_id, m.role,
               CASE WHEN m.role <> 'assistant' THEN m.content
                    ELSE coalesce((SELECT max_by(o.text, o.seq) FROM outcome o
                                   WHERE o.call_id = m.id AND o.type = 'done' AND o.text <> ''), '') END AS content,
               m.created_at
        FROM msg m""",
    "chat_events_json": f"""{with_(MESSAGES, REPLIES, CHUNKS)}
        SELECT call_id, seq, CAST(CASE type
          WHEN 'token' THEN json_object('content', content, 'type', type)
          WHEN 'done' THEN json_object('input_tokens', input_tokens, 'message_id', call_id,
                                       'output_tokens', output_tokens, 'type', type)
          ELSE json_object('message', error_msg, 'type', type) END AS VARCHAR) AS event
        FROM live WHERE type <> 'call_error'""",
    "chat_events_parse": f"""{with_(MESSAGES, REPLIES, CHUNKS)}
        SELECT call_id, coalesce(string_agg(content, '' ORDER BY seq) FILTER (WHERE type = 'token'), '') AS content,
               max(error_msg) AS error
        FROM live WHERE type <> 'call_error' GROUP BY call_id""",
    "stream_ingest": f"""{with_(CONVERSATIONS, MESSAGES, LOGS, CHECKED_LOGS.format(source='log'))}
        SELECT conversation_id, message_id, model, provider, latency_ms, input_tokens, output_tokens, status, error_msg,
               {AS_OF} AS created_at, CAST({AS_OF} AS DATE) AS log_date, reason,
               CASE WHEN reason IS NULL THEN 'stored' ELSE 'refused' END AS outcome
        FROM checked""",
    "stream_latency": f"{with_(LOGS, SERIES)} SELECT * FROM series",
    "stream_summary": f"{with_(LOGS, SUMMARY)} SELECT * FROM summary",
    "stream_recent": f"""{with_(LOGS)}
        SELECT id, conversation_id, model, provider, latency_ms, input_tokens, output_tokens, status, error_msg,
               CAST(NULL AS VARCHAR) AS input_preview, CAST(NULL AS VARCHAR) AS output_preview, created_at
        FROM log ORDER BY created_at DESC, id DESC LIMIT 100""",
    "stream_fold": f"{with_(MESSAGES, REPLIES, CHUNKS, OUTCOMES, FOLDED)} SELECT * FROM folded",
}

# The stored table read back is the frame with its replies filled in.
ORACLE["stored_replies"] = ORACLE["resolve_placeholders"]
