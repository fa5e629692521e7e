"""Schemas of the stored tables and of the rows in flight, as DDL for a reader.

Identifiers are strings in production tables. The operators never look inside
them, so any orderable key type works.
"""

from __future__ import annotations

CONVERSATIONS = (
    "id STRING NOT NULL, session_id STRING NOT NULL, title STRING NOT NULL, "
    "created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL"
)

MESSAGES = (
    "id STRING NOT NULL, conversation_id STRING NOT NULL, role STRING NOT NULL, "
    "content STRING NOT NULL, created_at TIMESTAMP_NTZ NOT NULL"
)

# One finished call as it leaves the fold: no id and no created_at yet.
LOG_EVENTS = (
    "conversation_id STRING NOT NULL, message_id STRING, model STRING NOT NULL, "
    "provider STRING NOT NULL, latency_ms BIGINT NOT NULL, input_tokens INT, output_tokens INT, "
    "status STRING NOT NULL, error_msg STRING, input_preview STRING, output_preview STRING"
)

INFERENCE_LOGS = (
    "id STRING NOT NULL, conversation_id STRING NOT NULL, message_id STRING, model STRING NOT NULL, "
    "provider STRING NOT NULL, latency_ms BIGINT NOT NULL, input_tokens INT, output_tokens INT, "
    "status STRING NOT NULL, error_msg STRING, input_preview STRING, output_preview STRING, "
    "created_at TIMESTAMP_NTZ NOT NULL"
)

# Bytes as they came from a provider, one row per network piece. A connection that
# broke has one more row, without bytes, that says why (the column may be left out).
RAW_CAPTURES = (
    "call_id STRING NOT NULL, provider STRING NOT NULL, piece BIGINT NOT NULL, "
    "ts TIMESTAMP_NTZ, http_status INT, raw BINARY, transport_error STRING"
)

# type is one of: token, done, error, call_error.
CHUNKS = (
    "call_id STRING NOT NULL, seq BIGINT NOT NULL, ts TIMESTAMP_NTZ, type STRING NOT NULL, "
    "content STRING, input_tokens INT, output_tokens INT, error_msg STRING"
)

CALLS = (
    "call_id STRING NOT NULL, conversation_id STRING NOT NULL, message_id STRING, "
    "provider STRING NOT NULL, model STRING NOT NULL, start_ts TIMESTAMP_NTZ NOT NULL, input_text STRING"
)

# Fixed values.
DEFAULT_TITLE = "New conversation"
ROLES = ("user", "assistant", "system")
STATUSES = ("success", "error")
