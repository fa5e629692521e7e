from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callgauge.functions.text import WHITE_SPACE, error_text, trimmed
from callgauge.operators import conversations as conv
from callgauge.operators import prompts, ranged
from callgauge.sources import sinks

BASE = datetime(2024, 3, 1)
MESSAGES = "id BIGINT, conversation_id BIGINT, role STRING, content STRING, created_at TIMESTAMP_NTZ"
CONVERSATIONS = "id BIGINT, session_id BIGINT, title STRING, created_at TIMESTAMP_NTZ"


def messages(spark, rows):
    return spark.createDataFrame([(i, c, r, t, BASE + timedelta(seconds=s)) for i, c, r, t, s in rows], MESSAGES)


def conversations(spark, ids, title="New conversation"):
    return spark.createDataFrame([(i, i % 2, title, BASE) for i in ids], CONVERSATIONS)


def test_titles(spark):
    long = "é" * 39 + "😀" + "tail"
    rows = [
        (1, 1, "user", "New conversation", 1), (2, 1, "user", "second", 2), (3, 1, "user", "third", 3),
        (4, 2, "user", long, 1),
        (5, 3, "user", "", 1), (6, 3, "user", "later", 2),
        (7, 4, "assistant", "not mine", 1), (8, 4, "system", "nor this", 2),
        (9, 5, "user", "same time, higher id", 1), (10, 5, "assistant", "x", 0),
        (8_000, 6, "user", "b", 1), (7_999, 6, "user", "a", 1),
        (11, 8, "user", "New conversation", 1),
    ]
    got = {r.id: r.title for r in conv.conversation_titles(conversations(spark, range(1, 9)), messages(spark, rows)).collect()}
    assert got == {1: "second", 2: "é" * 39 + "😀", 3: "", 4: "New conversation", 5: "same time, higher id", 6: "a",
                   7: "New conversation", 8: "New conversation"}
    kept = conv.conversation_titles(conversations(spark, [1], "mine"), messages(spark, rows)).first()
    assert kept.title == "mine"


def test_activity(spark):
    rows = [
        (1, 1, "user", "q", 10), (2, 1, "assistant", "a", 11),
        (3, 2, "user", "q", 10), (4, 2, "assistant", "", 11),
        (5, 3, "assistant", "a", 5), (6, 3, "system", "s", 900),
        (7, 4, "user", "q", 10), (8, 4, "assistant", "a", 11),
    ]
    logs = spark.createDataFrame(
        [(2, "success", BASE + timedelta(seconds=60)), (2, "success", BASE + timedelta(seconds=70)), (4, "success", BASE + timedelta(seconds=80)),
         (8, "error", BASE + timedelta(seconds=90)), (None, "success", BASE + timedelta(seconds=99))],
        "message_id BIGINT, status STRING, created_at TIMESTAMP_NTZ",
    )
    table = conversations(spark, range(1, 6))
    want = {1: 70, 2: 10, 3: 0, 4: 10, 5: 0}
    for result in (conv.conversation_activity(table, messages(spark, rows), logs), conv.conversation_state(table, messages(spark, rows), logs)):
        assert {r.id: (r.updated_at - BASE).seconds for r in result.collect()} == want


def test_feed_is_newest_first(spark):
    rows = conversations(spark, range(10)).withColumn("updated_at", F.expr("created_at + make_interval(0,0,0,0,0, cast(id * 7 % 5 as int))"))
    got = [(r.session_id, r.updated_at, r.id) for r in conv.session_feed(rows).collect()]
    assert got == sorted(got, key=lambda r: (r[0], -r[1].timestamp(), -r[2]))
    assert "session_id" not in conv.feed_labels(rows.withColumn("title", F.lit("")), BASE).first().title
    assert conv.feed_labels(rows.withColumn("title", F.lit("")), BASE).first().title == "Untitled"


def test_ownership(spark):
    requests = spark.createDataFrame([(1, 1), (1, 0), (99, 1), (1, 1)], "conversation_id BIGINT, session_id BIGINT")
    got = sorted(tuple(r) for r in conv.ownership_check(requests, conversations(spark, [1, 2])).collect())
    assert got == [(1, 0, False), (1, 1, True), (1, 1, True), (99, 1, False)]


def test_last_n_breaks_ties_by_id(spark):
    rows = [(i, 1, "user", str(i), 0) for i in range(30)] + [(100, 2, "user", "x", 0)]
    got = sorted(r.id for r in conv.last_n_messages(messages(spark, rows)).collect())
    assert got == [*range(10, 30), 100]


def test_detail_and_resume(spark):
    rows = [(i, 1, "assistant" if i % 2 else "user", "" if i % 4 == 3 else f"m{i}", i) for i in range(250)]
    detail = conv.conversation_detail(conversations(spark, [1, 2]), messages(spark, rows))
    got = {r.id: r for r in detail.collect()}
    assert [m.id for m in got[1].messages] == list(range(50, 250)) and got[2].messages == []
    shown = {r.id: r.messages for r in conv.resume_view(detail).collect()}
    assert [m.id for m in shown[1]] == [i for i in range(50, 250) if i % 4 != 3] and shown[2] == []


def test_clean_inputs(spark):
    texts = ["  a b ", "\t\n", "", WHITE_SPACE + "x" + WHITE_SPACE, "\x85y\x85", "a b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    got = {r.i: r.text for r in conv.clean_inputs(rows).collect()}
    assert got == {0: "a b", 3: "x", 4: "\x85y\x85", 5: "a b"}
    assert len(WHITE_SPACE) == 25
    assert rows.select(trimmed("text")).count() == 6


def prompt_loop(rows, n):
    out = {}
    for c in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: (r[4], r[0]))
        for i, r in enumerate(mine):
            if r[2] == "user":
                out[r[0]] = [(m[2], m[3]) for m in mine[max(0, i + 1 - n) : i + 1]]
    return out


@pytest.mark.parametrize("ranges,least_rows", [(4096, 1000), (8, 1), (64, 5), (4096, 1)])
@pytest.mark.parametrize("n", [6, 1])
def test_prompts_equal_the_loop(spark, ranges, least_rows, n):
    """One conversation holds a third of all messages; many share their time. Ranges go down to single rows."""
    rng = random.Random(ranges)
    rows = [
        (i, rng.choice([1, rng.randint(2, 40), rng.randint(2, 40)]), rng.choice(["user", "assistant", "system"]), f"m{i}", rng.randint(0, 300))
        for i in range(900)
    ]
    got = prompts.prompt_context(messages(spark, rows), n, ranges=ranges, least_rows=least_rows)
    assert {r.message_id: [(m.role, m.content) for m in r.messages] for r in got.collect()} == prompt_loop(rows, n)


def test_messages_of_one_instant_are_spread(spark):
    """No job runs while the query is built, and one conversation at one time falls into several ranges."""
    rows = messages(spark, [(i, 1, "user", f"m{i}", 0) for i in range(3000)]).withColumn("id", F.format_string("%05d", F.col("id").cast("int")))
    order = ["conversation_id", "created_at", "id"]
    spark.sparkContext.setJobGroup("built", "built")
    turns = prompts.prompt_context(rows, 4, least_rows=100)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setJobGroup("run", "run")
    found = ranged.cut_points(rows, order, least_rows=100)
    sizes = [r["count"] for r in rows.groupBy(ranged.range_of(order, found).alias("r")).count().collect()]
    assert 20 <= len(sizes) <= 32 and max(sizes) < 300
    got = {r.message_id: [m.content for m in r.messages] for r in turns.collect()}
    assert got == {f"{i:05d}": [f"m{k}" for k in range(max(0, i - 3), i + 1)] for i in range(3000)}


def test_prompts_of_nothing_and_of_missing_keys(spark):
    rows = messages(spark, [(i, None if i % 2 else 1, "user", f"m{i}", i) for i in range(12)])
    rows = rows.withColumn("created_at", F.when(F.col("id") >= 4, F.col("created_at")))
    got = {r.message_id: [m.content for m in r.messages] for r in prompts.prompt_context(rows, 3, least_rows=2).collect()}
    assert got == {r.message_id: [m.content for m in r.messages] for r in prompts.prompt_context(rows, 3).collect()} and len(got) == 12
    assert prompts.prompt_context(rows.limit(0)).count() == 0


def test_prompt_bodies(spark):
    rows = messages(spark, [(1, 1, "system", 's "q"', 0), (2, 1, "assistant", "", 1), (3, 1, "user", "u\n", 2)])
    turns = prompts.prompt_context(rows)
    assert json.loads(prompts.prompt_openai(turns, "gpt").first().body) == {
        "model": "gpt", "stream": True, "stream_options": {"include_usage": True},
        "messages": [{"role": "system", "content": 's "q"'}, {"role": "assistant", "content": ""}, {"role": "user", "content": "u\n"}],
    }
    body = json.loads(prompts.prompt_gemini(turns).first().body)
    assert [(c["role"], c["parts"]) for c in body["contents"]] == [
        ("user", [{"text": 's "q"'}]), ("model", [{"text": ""}]), ("user", [{"text": "u\n"}])]
    assert body["generationConfig"] == {"maxOutputTokens": 2048, "thinkingConfig": {"thinkingLevel": "minimal"}}
    assert {s["threshold"] for s in body["safetySettings"]} == {"BLOCK_NONE"} and len(body["safetySettings"]) == 4
    empty = turns.withColumn("messages", F.slice("messages", 1, 0))
    assert prompts.input_previews(empty).first().input_preview is None


def test_error_texts(spark):
    rows = spark.createDataFrame([("http", "x", None), ("api", "x", 429), ("malformed", "x", None), ("internal", "x", None)], "k STRING, d STRING, s INT")
    got = [r[0] for r in rows.select(error_text(F.col("k"), F.col("d"), F.col("s"))).collect()]
    assert got == ["http error: x", "provider returned 429: x", "malformed stream chunk: x", "internal: x"]


def test_new_rows_get_defaults(spark):
    opened = sinks.open_conversations(spark.createDataFrame([("s",), ("s",)], "session_id STRING"), BASE).collect()
    assert len({r.id for r in opened}) == 2 and {r.title for r in opened} == {"New conversation"}
    assert all(r.created_at == r.updated_at == BASE for r in opened)
    rows = spark.createDataFrame([("given", "c", "user", "x"), (None, "c", "user", "y")], "id STRING, conversation_id STRING, role STRING, content STRING")
    added = {r.content: r.id for r in sinks.new_messages(rows).collect()}
    assert added["x"] == "given" and len(added["y"]) == 36
