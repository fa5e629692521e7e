from __future__ import annotations

import random
from datetime import datetime, timedelta

from callgauge.operators import integrity

BASE = datetime(2024, 3, 1)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id BIGINT")


LOGS = "id BIGINT, conversation_id BIGINT, message_id BIGINT, model STRING, provider STRING, latency_ms BIGINT, status STRING"


def test_log_rules_in_order(spark):
    rows = [
        (1, 1, 10, "m", "p", 5, "success", None),
        (2, 1, None, "m", "p", 5, "error", None),
        (3, None, 10, "m", "p", 5, "success", "conversation_id is null"),
        (4, 9, 99, None, "p", 5, "odd", "model is null"),
        (5, 9, 99, "m", "p", 5, "odd", "status not allowed"),
        (6, 9, 99, "m", "p", 5, "error", "conversation not found"),
        (7, 1, 99, "m", "p", 5, "error", "message not found"),
        (8, 1, 10, "m", "p", None, "error", "latency_ms is null"),
    ]
    frame = spark.createDataFrame([r[:-1] for r in rows], LOGS)
    checked = integrity.check_logs(frame, ids(spark, [1, 1, 2]), ids(spark, [10, 10, 11]))
    assert checked.columns == [*frame.columns, "reason"]
    assert {r.id: r.reason for r in checked.collect()} == {r[0]: r[-1] for r in rows}
    assert {r.id for r in integrity.accepted(checked).collect()} == {1, 2}
    assert integrity.refused(checked).count() == 6


def test_message_rules(spark):
    rows = [(1, 1, "user", "x", None), (2, 1, "system", "", None), (3, 1, "tool", "x", "role not allowed"), (4, 1, "user", None, "content is null"),
            (5, 9, "assistant", "x", "conversation not found")]
    frame = spark.createDataFrame([r[:-1] for r in rows], "id BIGINT, conversation_id BIGINT, role STRING, content STRING")
    got = {r.id: r.reason for r in integrity.check_messages(frame, ids(spark, [1])).collect()}
    assert got == {r[0]: r[-1] for r in rows}


def test_keys_keep_the_first(spark):
    """A third of the rows share one id; identical copies are counted, not lost."""
    rng = random.Random(2)
    rows = [(rng.choice([0, rng.randint(1, 30)]), BASE + timedelta(seconds=rng.randint(0, 20)), rng.choice("ab")) for _ in range(600)]
    got = integrity.check_keys(spark.createDataFrame(rows, "id BIGINT, created_at TIMESTAMP_NTZ, v STRING")).collect()
    assert sum(r.copies for r in got) == len(rows)
    kept = [(r.id, r.created_at, r.v) for r in got if r.kept]
    assert sorted(kept) == sorted(min(r for r in rows if r[0] == i) for i in {r[0] for r in rows})
    assert {(r.id, r.created_at, r.v) for r in got} == set(rows)


def test_deletes(spark):
    messages = spark.createDataFrame([(10, 1), (11, 1), (20, 2)], "id BIGINT, conversation_id BIGINT")
    logs = spark.createDataFrame([(1, 1, 10), (2, 2, 20), (3, 2, 10), (4, 2, None)], "id BIGINT, conversation_id BIGINT, message_id BIGINT")
    left = integrity.cascade_delete(ids(spark, [1, 2]), messages, logs, ids(spark, [1, 7]))
    assert [sorted(tuple(r) for r in rows.collect()) for rows in left[:2]] == [[(2,)], [(20, 2)]]
    # A log of another conversation that pointed to a deleted message loses the link only.
    assert {r.id: r.message_id for r in left[2].collect()} == {2: 20, 3: None, 4: None}
    linked = integrity.logs_with_reply(logs, messages.selectExpr("id", "'assistant' as role", "'hi' as content"))
    assert {r.id: r.reply for r in linked.collect()} == {1: "hi", 2: "hi", 3: "hi", 4: None}


def test_conversation_rules(spark):
    rows = [(1, "s", "t", None), (2, None, "t", "session_id is null"), (3, "s", None, "title is null"), (4, None, None, "session_id is null")]
    frame = spark.createDataFrame([r[:-1] for r in rows], "id BIGINT, session_id STRING, title STRING")
    assert {r.id: r.reason for r in integrity.check_conversations(frame).collect()} == {r[0]: r[-1] for r in rows}


def test_rows_without_a_message_stay_out_of_the_join(spark):
    logs = spark.createDataFrame([(k, 1, None if k % 3 else k, "m", "p", 5, "error") for k in range(30)], LOGS)
    messages = spark.createDataFrame([(k, "assistant", f"text {k}") for k in range(0, 30, 2)], "id BIGINT, role STRING, content STRING")
    found = integrity.logs_with_reply(logs, messages)
    assert {r.id: r.reply for r in found.collect()} == {k: f"text {k}" if k % 6 == 0 else None for k in range(30)}
    kept = integrity.cascade_set_null(logs, messages.select("id"))
    assert {r.id: r.message_id for r in kept.collect()} == {k: k if k % 6 == 3 else None for k in range(30)}
