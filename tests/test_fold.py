"""Folding by hand, against a plain loop, and in a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from callgauge.operators import events, fold
from callgauge.streaming import calls as call_stream

SCHEMA = (
    "call_id STRING, seq BIGINT, ts TIMESTAMP_NTZ, type STRING, content STRING, input_tokens INT, "
    "output_tokens INT, error_msg STRING"
)
START = datetime(2024, 1, 1)


def tok(text):
    return ("token", text, None, None, None)


def done(a=None, b=None):
    return ("done", None, a, b, None)


def err(text="boom", kind="error"):
    return (kind, None, None, None, text)


def frame(spark, calls: dict[str, list[tuple]], step: int = 1):
    rows = [
        (call, i * step, START + timedelta(milliseconds=10 * i, microseconds=999), *chunk)
        for call, chunk_list in calls.items()
        for i, chunk in enumerate(chunk_list)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def call_table(spark, names):
    rows = [(n, f"conv-{n}", f"msg-{n}", "openai", "gpt", START, "ask me@x.org") for n in names]
    return spark.createDataFrame(
        rows, "call_id STRING, conversation_id STRING, message_id STRING, provider STRING, model STRING, start_ts TIMESTAMP_NTZ, input_text STRING"
    )


def looped(chunk_list: list[tuple]) -> list[tuple]:
    """The rules as a plain loop over one call."""
    text, usage, out = "", (None, None), []
    for kind, content, a, b, error in chunk_list:
        if kind == "token":
            text += content
        elif kind == "done":
            usage = (a, b)
            out.append(("done", text, usage, None))
        else:
            out.append((kind, text, usage, error))
            break
    return out


def outcomes(result) -> dict[str, list[tuple]]:
    got: dict[str, list[tuple]] = {}
    for r in result.orderBy("call_id", "seq").collect():
        got.setdefault(r.call_id, []).append((r.type, r.text, (r.input_tokens, r.output_tokens), r.error_msg))
    return got


CALLS = {
    "at once": [err("provider returned 429: key sk-abcdefgh12 refused", "call_error")],
    "done": [tok("a"), tok("b"), done(1, 2)],
    "error after tokens": [tok("a"), err("mail a@b.co")],
    "error first": [err()],
    "done then error": [tok("a"), done(1, 2), tok("b"), err()],
    "two dones": [tok("a"), done(1, 2), tok("b"), done(3, 4)],
    "done without counts": [tok("a"), done(1, 2), done(None, None), err()],
    "no end": [tok("a"), tok("b")],
    "more after the error": [tok("a"), err("first"), tok("b"), done(9, 9), err("second")],
    "tokens after done": [tok("a"), done(1, 1), tok("tail")],
    "long": [tok(str(i)) for i in range(40)] + [done(5, 6)],
}


def test_rules(spark, sizes):
    got = outcomes(fold.call_outcomes(frame(spark, CALLS)))
    assert {k: got.get(k, []) for k in CALLS} == {k: looped(v) for k, v in CALLS.items()}


@pytest.mark.parametrize("step", [1, 3])
def test_random_calls_equal_the_loop(spark, sizes, step):
    rng = random.Random(step)
    calls = {}
    for n in range(150):
        kinds = rng.choices("tdex", weights=[12, 2, 1, 0.3], k=rng.randint(1, 30))
        make = {"t": lambda: tok(rng.choice(["", "x", "yy "])), "d": lambda: done(rng.choice([None, 7]), rng.randint(0, 9)),
                "e": lambda: err(str(rng.random())), "x": lambda: err("no", "call_error")}
        calls[f"c{n}"] = [make[k]() for k in kinds]
    got = outcomes(fold.call_outcomes(frame(spark, calls, step)))
    assert {k: got.get(k, []) for k in calls} == {k: looped(v) for k, v in calls.items()}


def test_log_events(spark, sizes):
    rows = {(r.call_id, r.seq): r for r in fold.fold_calls(call_table(spark, CALLS), frame(spark, CALLS)).collect()}
    at_once = rows["at once", 0]
    assert (at_once.status, at_once.output_preview, at_once.input_tokens) == ("error", None, None)
    assert at_once.error_msg == "provider returned 429: key [REDACTED:secret] refused"
    assert at_once.input_preview == "ask [REDACTED:email]"
    assert rows["error first", 0].output_preview == ""
    assert rows["error after tokens", 1].error_msg == "mail [REDACTED:email]"
    assert rows["done", 2].latency_ms == 20 and rows["done", 2].message_id == "msg-done"
    assert ("no end", 1) not in rows


def test_abandoned_calls_on_request(spark, sizes):
    rows = fold.fold_calls(call_table(spark, CALLS), frame(spark, CALLS), include_abandoned=True)
    left = rows.filter("status = 'abandoned'").collect()
    assert [(r.call_id, r.output_preview, r.latency_ms) for r in left] == [("no end", "ab", 10)]


def test_preview_is_cut_after_redaction(spark):
    text = "w" * 490 + " ask lena_k@post.example today"
    (row,) = fold.fold_calls(call_table(spark, ["x"]), frame(spark, {"x": [tok(c) for c in text] + [done()]})).collect()
    assert row.output_preview == ("w" * 490 + " ask [REDACTED:email] today")[:500]


def test_placeholders(spark, sizes):
    replies = fold.finished_replies(fold.call_outcomes(frame(spark, CALLS))).withColumnRenamed("call_id", "message_id")
    messages = spark.createDataFrame([(k, "assistant", "") for k in CALLS] + [("other", "user", "kept")], "id STRING, role STRING, content STRING")
    got = {r.id: r.content for r in fold.resolve_placeholders(messages, replies).collect()}
    assert got == {**dict.fromkeys(CALLS, ""), "other": "kept", "done": "ab", "done then error": "a", "two dones": "ab",
                   "done without counts": "a", "tokens after done": "a", "long": "".join(map(str, range(40)))}


def test_client_events_are_json(spark, sizes):
    import json

    rows = events.chat_events_json(frame(spark, CALLS), call_table(spark, CALLS)).orderBy("call_id", "seq").collect()
    got: dict[str, list] = {}
    for r in rows:
        got.setdefault(r.call_id, []).append(r.event)
    assert got["done"] == ['{"content":"a","type":"token"}', '{"content":"b","type":"token"}',
                           '{"input_tokens":1,"message_id":"msg-done","output_tokens":2,"type":"done"}']
    assert got["done without counts"][2] == '{"input_tokens":null,"message_id":"msg-done without counts","output_tokens":null,"type":"done"}'
    assert [json.loads(e)["type"] for e in got["more after the error"]] == ["token", "error"]
    assert "at once" not in got


@pytest.mark.parametrize("spread", [False, True])
def test_stream_equals_batch(spark, sizes, tmp_path, spread):
    """Chunks come in over several batches; calls are folded when quiet, the rest when drained."""
    rng = random.Random(4)
    rows = []
    for n in range(30):
        start = START + timedelta(minutes=7 * n)
        for i, chunk in enumerate([tok("a "), tok("b "), tok("c"), done(n, 1)] if n % 3 else [tok("a"), err()]):
            rows.append((f"c{n}", i, start + timedelta(seconds=(400 if spread else 1) * i), *chunk))
    rows.sort(key=lambda r: r[2])
    source = tmp_path / "in"
    for n in range(0, len(rows), 25):
        part = rows[n : n + 25]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source / f"p{n:04d}"))
    batch = spark.createDataFrame(rows, SCHEMA)
    table = call_table(spark, {r[0] for r in rows})
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = str(tmp_path / "out")
    call_stream.start_fold(stream, lambda _: table, out, f"{out}/checkpoint").awaitTermination()
    early = call_stream.folded(spark, lambda _: table, out).count()
    got = call_stream.folded(spark, lambda _: table, out, drained=True)
    want = fold.fold_calls(table, batch)
    assert 0 < early < want.count()
    assert texts(got.select(*want.columns)) == texts(want)


def texts(frame) -> list[str]:
    return sorted(str(tuple(r)) for r in frame.collect())


def test_stream_takes_files_in_any_order(spark, tmp_path):
    """The end of a call comes after a call two hours newer; another call goes on after it was folded."""
    hours = lambda h: START + timedelta(hours=h)
    files = [
        [("old", 0, hours(0), *tok("a")), ("old", 1, hours(0), *tok("b"))],
        [("new", 0, hours(2), *tok("x")), ("new", 1, hours(2), *done(1, 1))],
        [("old", 2, hours(0.01), *done(2, 2))],
        [("far", 0, hours(9), *tok("q")), ("far", 1, hours(9), *done(3, 3))],
        [("new", 2, hours(2.1), *tok("y")), ("new", 3, hours(2.1), *done(4, 4))],
    ]
    source = tmp_path / "in"
    for n, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"p{n}"))
    batch = spark.createDataFrame([r for part in files for r in part], SCHEMA)
    table = call_table(spark, {"old", "new", "far"})
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = str(tmp_path / "out")
    call_stream.start_fold(stream, lambda _: table, out, f"{out}/checkpoint").awaitTermination()
    want = fold.fold_calls(table, batch)
    assert texts(call_stream.folded(spark, lambda _: table, out, drained=True).select(*want.columns)) == texts(want)
    assert spark.read.parquet(f"{out}/chunks").count() == batch.count()
