"""Captures by hand, one branch each; every test also runs the long way."""

from __future__ import annotations

import random

import pytest

from callgauge.operators import events, frames

SCHEMA = "call_id STRING, provider STRING, piece BIGINT, ts TIMESTAMP_NTZ, http_status INT, raw BINARY"


def captures(spark, calls: dict[str, list[bytes]], statuses: dict[str, int] | None = None, provider: str = "openai"):
    rows = [
        (call, provider, i, None, (statuses or {}).get(call, 200), bytearray(piece))
        for call, pieces in calls.items()
        for i, piece in enumerate(pieces)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def chunks(frame) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for r in frame.orderBy("call_id", "seq").collect():
        value = {"token": r.content, "done": (r.input_tokens, r.output_tokens)}.get(r.type, r.error_msg)
        out.setdefault(r.call_id, []).append((r.type, value))
    return out


def data(*payloads: str) -> bytes:
    return "".join(f"data: {p}\n\n" for p in payloads).encode()


def token(text: str) -> str:
    return '{"choices":[{"delta":{"content":"%s"}}]}' % text


USAGE = '{"choices":[],"usage":{"prompt_tokens":3,"completion_tokens":4}}'
BAD = ("error", "malformed stream chunk: invalid JSON")

OPENAI = {
    "plain": ([data(token("a"), token("b"), USAGE, "[DONE]")], [("token", "a"), ("token", "b"), ("done", (3, 4))]),
    "after the end": ([data(token("a"), "[DONE]", token("b"))], [("token", "a")]),
    "comment and other fields": ([b": hi\nevent: x\nid: 1\n\n" + data(token("a"))], [("token", "a")]),
    "no space": ([b"data:" + token("a").encode() + b"\n\n" + data(token("b"))], [("token", "b")]),
    "unfinished tail": ([data(token("a")) + b"data: " + token("b").encode() + b"\n"], [("token", "a")]),
    "two lines in a frame": ([f"data: {token('a')}\r\ndata: {token('b')}\n\n".encode()], [("token", "a"), ("token", "b")]),
    "windows line ends never end a frame": ([f"data: {token('a')}\r\n\r\n".encode()], []),
    "usage null": ([data('{"choices":[{"delta":{"content":"a"}}],"usage":null}')], [("token", "a")]),
    "usage wins over token": ([data('{"choices":[{"delta":{"content":"a"}}],"usage":{"prompt_tokens":1}}')], [("done", (1, None))]),
    "usage of wrong types": ([data('{"usage":{"prompt_tokens":"12","completion_tokens":12.0}}')], [("done", (None, None))]),
    "usage not an object": ([data('{"usage":5}')], [("done", (None, None))]),
    "counts wrap": ([data('{"usage":{"prompt_tokens":4294967298,"completion_tokens":2147483648}}')], [("done", (2, -2147483648))]),
    "count beyond 64 bits": ([data('{"usage":{"prompt_tokens":99999999999999999999,"completion_tokens":-1}}')], [("done", (None, -1))]),
    "empty token": ([data(token(""))], [("token", "")]),
    "content not a string": ([data('{"choices":[{"delta":{"content":5}}]}')], []),
    "nothing of use": ([data('{"choices":[]}', "[]", "5")], []),
    "broken, then more": ([data("{oops", token("a"))], [BAD, ("token", "a")]),
    "more than one value": ([data(token("a") + " x", token("a") + "]", token("a") + "}", token("a") + "," + token("b"),
                                  token("a") + ',"k":1', "")], [BAD] * 6),
    "repeated key": ([data('{"usage":null,"choices":[],"choices":[{"delta":{"content":"a"}}]}')], [("token", "a")]),
    "error object is not known": ([data('{"error":{"message":"x"}}')], []),
    "escapes": ([data(token("\\u00e9\\n\\\""))], [("token", "é\n\"")]),
    "many blank lines": ([b"\n\n\n" + data(token("a")) + b"\n\n\n\n"], [("token", "a")]),
    "nothing at all": ([b""], []),
}


def test_openai(spark, sizes):
    got = chunks(frames.frames_openai(captures(spark, {k: v for k, (v, _) in OPENAI.items()})))
    assert {k: got.get(k, []) for k in OPENAI} == {k: want for k, (_, want) in OPENAI.items()}


def g(text: str | None = None, finish: str | None = None, more: str = "") -> str:
    content = '"content":{"parts":[{"text":"%s"},{"text":"second"}]}' % text if text is not None else '"index":0'
    reason = ',"finishReason":"%s"' % finish if finish else ""
    return '{"candidates":[{%s%s}]%s}' % (content, reason, more)


COUNTS = ',"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":4}'
GEMINI = {
    "plain": (data(g("a"), g("b", "STOP", COUNTS)), [("token", "a"), ("token", "b"), ("done", (3, 4))]),
    "windows line ends": (data(g("a"), g("b")).replace(b"\n", b"\r\n"), [("token", "a"), ("token", "b")]),
    "empty token": (data(g("")), []),
    "stop without usage": (data(g("a", "SAFETY")), [("token", "a")]),
    "usage without stop": (data(g("a", None, COUNTS)), [("token", "a")]),
    "usage null": (data(g(None, "STOP", ',"usageMetadata":null')), [("done", (None, None))]),
    "all three": (data(g("a", "STOP", COUNTS + ',"error":{"message":"m"}'), g("b")),
                  [("token", "a"), ("done", (3, 4)), ("error", "malformed stream chunk: m")]),
    "error without message": (data('{"error":{"code":1}}', g("b")), [("error", "malformed stream chunk: unknown gemini error")]),
    "error null": (data('{"error":null}', g("b")), [("error", "malformed stream chunk: unknown gemini error")]),
    "broken, then more": (data("{oops", g("b")), [BAD, ("token", "b")]),
    "two ends": (data(g("a", "STOP", COUNTS), g("b", "STOP", COUNTS)), [("token", "a"), ("done", (3, 4)), ("token", "b"), ("done", (3, 4))]),
}


def test_gemini(spark, sizes):
    got = chunks(frames.frames_gemini(captures(spark, {k: [v] for k, (v, _) in GEMINI.items()}, provider="gemini")))
    assert {k: got.get(k, []) for k in GEMINI} == {k: want for k, (_, want) in GEMINI.items()}


def test_any_cut_gives_the_same_chunks(spark, sizes):
    """Pieces may end anywhere, inside a character too."""
    rng = random.Random(11)
    body = data(*[token(f"wörd{i} 漢字") for i in range(20)], "{bad", USAGE, "[DONE]", token("late")) + b"data: tail"
    cuts = {}
    for n in range(8):
        at = sorted(rng.sample(range(1, len(body)), rng.choice([1, 5, 60, 300])))
        cuts[f"c{n}"] = [body[a:b] for a, b in zip([0, *at], [*at, len(body)], strict=True)]
    got = chunks(frames.frames_openai(captures(spark, cuts)))
    want = [("token", f"wörd{i} 漢字") for i in range(20)] + [BAD, ("done", (3, 4))]
    assert got == dict.fromkeys(cuts, want)


def test_bytes_that_are_no_text(spark):
    got = chunks(frames.frames_openai(captures(spark, {"x": [data(token("a")).replace(b'"a"', b'"\xff\xc3b"')]})))
    assert got == {"x": [("token", "��b")]}


@pytest.mark.parametrize("provider", ["openai", "gemini"])
def test_broken_connections(spark, sizes, provider):
    say = token if provider == "openai" else g
    calls = {
        "midway": [data(say("a")) + b"data: {", None],
        "at once": [None],
        "open line": [data(say("a"), say("b")) + f"data: {say('c')}".encode(), None],
        "long": [data(say(str(i))) for i in range(30)] + [None],
        "fine": [data(say("a"))],
    }
    ended = data("[DONE]") if provider == "openai" else data('{"error":{"message":"m"}}')
    calls["after the end"] = [data(say("a")), ended, None]
    rows = [
        (call, provider, i, None, 200, None if piece is None else bytearray(piece), "reset" if piece is None else None)
        for call, pieces in calls.items()
        for i, piece in enumerate(pieces)
    ]
    frame = spark.createDataFrame(rows, f"{SCHEMA}, transport_error STRING").repartition(3)
    failed = ("error", "http error: reset")
    assert chunks(frames.PROVIDERS[provider](frame)) == {
        "midway": [("token", "a"), failed],
        "at once": [failed],
        "open line": [("token", "a"), ("token", "b"), failed],
        "long": [("token", str(i)) for i in range(30)] + [failed],
        "fine": [("token", "a")],
        "after the end": [("token", "a")] + ([] if provider == "openai" else [("error", "malformed stream chunk: m")]),
    }


def test_failed_requests(spark, sizes):
    calls = {"a": [b"too ", "viél".encode()[:3], "viél".encode()[3:]] + [b"."] * 9, "b": [data(token("x"))], "c": [b""]}
    frame = captures(spark, calls, {"a": 429, "c": 503})
    assert chunks(frames.frames_openai(frame)) == {
        "a": [("call_error", "provider returned 429: too viél" + "." * 9)],
        "b": [("token", "x")],
        "c": [("call_error", "provider returned 503: ")],
    }


def test_providers_together(spark):
    both = captures(spark, {"o": [data(token("x"))]}).unionByName(captures(spark, {"g": [data(g("y"))]}, provider="gemini"))
    assert chunks(frames.frames(both)) == {"o": [("token", "x")], "g": [("token", "y")]}


def event(kind: str, **fields) -> str:
    import json

    return json.dumps({"type": kind, **fields})


@pytest.mark.parametrize("cut", [7, 1000])
def test_client_events(spark, sizes, cut):
    calls = {
        "plain": data(event("token", content="a"), event("token", content="b"), event("done", message_id="m")),
        "error": data(event("token", content="a"), event("error", message="one"), event("error", message="two")),
        "marker": data(event("token", content="a"), "[DONE]", event("token", content="b")),
        "broken": data(event("token", content="a"), "{oops", event("token", content="b")),
        "empty": data(event("done", message_id="m")),
        "tail": data(event("token", content="a")) + b"data: {",
    }
    cuts = {k: [v[i : i + cut] for i in range(0, len(v), cut)] for k, v in calls.items()}
    got = {r.call_id: (r.content, r.error) for r in events.chat_events_parse(captures(spark, cuts, provider="app")).collect()}
    assert got == {
        "plain": ("ab", None),
        "error": ("a", "two"),
        "marker": ("a", None),
        "broken": ("a", "malformed event"),
        "empty": ("", None),
        "tail": ("a", None),
    }


def test_a_return_before_the_end_of_a_frame_is_part_of_the_line(spark, sizes):
    """``[DONE]`` and a return before a blank line is no end but a broken line; inside a frame
    it ends the call. Also where the next line is in another block or piece."""
    broken = ("error", "malformed stream chunk: invalid JSON")
    calls = {
        "frame": [data(token("a")) + b"data: [DONE]\r\n\n" + data(token("b"))],
        "inside": [data(token("a")) + b"data: [DONE]\r\nid: 1\n\n" + data(token("b"))],
        "plain": [data(token("a")) + b"data: [DONE]\n\n" + data(token("b"))],
    }
    for lines in range(1, 6):
        calls[f"far {lines}"] = [b": x\n" * lines + b"data: [DONE]\r\n", b"\n", data(token("b"))]
        calls[f"near {lines}"] = [b": x\n" * lines + b"data: [DONE]\r\n", b"id: 1\n\n", data(token("b"))]
    got = chunks(frames.frames_openai(captures(spark, calls)))
    assert got["frame"] == [("token", "a"), broken, ("token", "b")]
    assert got["inside"] == got["plain"] == [("token", "a")]
    for lines in range(1, 6):
        assert got[f"far {lines}"] == [broken, ("token", "b")] and f"near {lines}" not in got


def test_captures_are_read_once(spark, tmp_path):
    """All providers and refused requests from one scan, lines put together once."""
    path = str(tmp_path / "captures")
    captures(spark, {"a": [data(token("x"))], "b": [data(token("y"))]}).write.parquet(path)
    found = frames.frames(spark.read.parquet(path))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("FileScan") == 1 and final.count("posexplode") == 1
