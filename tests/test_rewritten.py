"""Stored tables that change: what is touched, what is not, and what readers see."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgauge.sources import rewritten

MESSAGES = "id long, conversation_id long, role string, content string"
LOGS = "id long, conversation_id long, message_id long"


def messages(spark, path):
    rows = [(c * 10 + k, c, "assistant" if k % 2 else "user", "" if k % 2 else f"t{k}") for c in range(40) for k in range(4)]
    rewritten.create(spark.createDataFrame(rows, MESSAGES), path, "conversation_id", folders=64)
    return rows


def files(spark, path) -> set[str]:
    return set(rewritten.read(spark, path).inputFiles())


def test_replies_are_written_into_the_table(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = messages(spark, path)
    before = files(spark, path)
    replies = spark.createDataFrame([(11, "done"), (13, ""), (9999, "nobody")], "message_id long, reply string")
    touched = rewritten.fill_placeholders(spark, path, replies)
    assert len(touched) == 1 and len(before - files(spark, path)) == 1  # all other files stay
    want = {(i, c, r, "done" if i == 11 else t) for i, c, r, t in rows}
    assert {tuple(r) for r in rewritten.read(spark, path).select("id", "conversation_id", "role", "content").collect()} == want
    after = files(spark, path)
    assert rewritten.fill_placeholders(spark, path, replies) == set() and files(spark, path) == after


def test_a_change_without_its_commit_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    messages(spark, path)
    before = files(spark, path)
    reader = rewritten.read(spark, path)
    replies = spark.createDataFrame([(11, "done")], "message_id long, reply string")

    def lost(*_):
        raise RuntimeError("the driver went away")

    with monkeypatch.context() as broken:
        broken.setattr(rewritten, "_commit", lost)
        try:
            rewritten.fill_placeholders(spark, path, replies)
        except RuntimeError:
            pass
    assert files(spark, path) == before
    rewritten.fill_placeholders(spark, path, replies)  # a new run replaces what was left behind
    assert rewritten.read(spark, path).filter("content = 'done'").count() == 1
    assert reader.filter("content = 'done'").count() == 0  # who began to read before still reads what was


def test_deletes_rewrite_only_what_they_touch(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in "cml"}
    messages(spark, at["m"])
    rewritten.create(spark.createDataFrame([(c,) for c in range(40)], "id long"), at["c"], "id", folders=64)
    rewritten.create(spark.createDataFrame([(c, c, c * 10 + 1 if c != 7 else 31) for c in range(40)] + [(99, 5, None)], LOGS), at["l"], "conversation_id", folders=64)
    before = files(spark, at["l"])
    deleted = spark.createDataFrame([(3,), (500,)], "id long")
    touched = rewritten.delete_conversations(spark, deleted, at["c"], at["m"], at["l"])
    assert len(touched["conversations"]) == len(touched["messages"]) == 1 and len(touched["logs"]) == 2
    assert len(before - files(spark, at["l"])) == 2
    assert rewritten.read(spark, at["c"]).count() == 39 and rewritten.read(spark, at["m"]).filter("conversation_id = 3").count() == 0
    logs = {r.id: r.message_id for r in rewritten.read(spark, at["l"]).collect()}
    assert 3 not in logs and logs[7] is None and logs[99] is None and logs[8] == 81
    touched = rewritten.delete_messages(spark, spark.createDataFrame([(81,), (82,)], "id long"), at["m"], at["l"])
    assert len(touched["logs"]) == len(touched["messages"]) == 1
    assert rewritten.read(spark, at["l"]).filter("id = 8").first().message_id is None


def test_a_table_may_lose_all_its_rows(spark, tmp_path):
    path = str(tmp_path / "c")
    rewritten.create(spark.createDataFrame([(1,), (2,)], "id long"), path, "id")
    rewritten.rewrite(spark, path, lambda t: t, lambda t: t.filter(F.lit(False)))
    assert rewritten.read(spark, path).count() == 0
    rewritten.create(spark.createDataFrame([], "id long"), str(tmp_path / "e"), "id")
    assert rewritten.read(spark, str(tmp_path / "e")).columns == ["id"]
