"""The streamed fold over many micro-batches, with late chunks, restarts and long calls."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from callgauge.operators import fold, ordered
from callgauge.plans import inputs
from callgauge.streaming import calls as call_stream
from conftest import SMALL


def rows(frame) -> list[str]:
    return sorted(str(tuple(r)) for r in frame.select(*sorted(frame.columns)).collect())


def calls(session):
    return inputs.calls(session, SMALL)


def start(spark, source, path, **options):
    stream = spark.readStream.schema(inputs.chunks(spark, SMALL).schema).option("maxFilesPerTrigger", 1).parquet(source)
    call_stream.start_fold(stream, calls, path, f"{path}/checkpoint", **options).awaitTermination()


def written(frame, folder):
    frame.coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("bits", [16, 4])
def test_late_chunks_and_a_restart(spark, tmp_path, monkeypatch, bits):
    """Files in order of time, but for one tenth of the chunks, which come last; the stream
    starts anew from its checkpoint in between. With small blocks calls have many of them."""
    monkeypatch.setattr(ordered, "BLOCK_BITS", bits)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    chunks = inputs.chunks(spark, SMALL).withColumn("late", F.xxhash64("call_id", "seq") % 10 == 0)
    parts = [chunks.filter(~F.col("late") & (F.col("call_id") % 3 == k)).drop("late") for k in range(3)]
    late = chunks.filter("late").drop("late")
    for part in parts[:2]:
        written(part, source)
    start(spark, source, path)
    before = call_stream.folded(spark, calls, path).count()
    written(parts[2], source)
    written(late, source)
    start(spark, source, path)
    assert call_stream.folded(spark, calls, path).count() > before > 0
    assert spark.read.parquet(f"{path}/logs").select("batch_id").distinct().count() >= 1
    want = fold.fold_calls(calls(spark), inputs.chunks(spark, SMALL))
    assert rows(call_stream.folded(spark, calls, path, drained=True)) == rows(want)


def test_closed_calls_leave_the_state(spark, tmp_path):
    """What waits at the end are the calls of the last half hour alone; and a batch that has
    no late chunk reads no chunk of an earlier one."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    written(inputs.chunks(spark, SMALL), source)
    start(spark, source, path)
    newest = inputs.chunks(spark, SMALL).agg(F.max("ts")).first()[0]
    waiting = call_stream.open_chunks(spark, f"{path}/checkpoint", f"{path}/open")
    last = inputs.chunks(spark, SMALL).groupBy("call_id").agg(F.max("ts").alias("last"))
    opened = last.filter(F.col("last") > F.lit(newest) - F.expr("interval 30 minutes")).select("call_id")
    assert {r[0] for r in waiting.select("call_id").distinct().collect()} <= {r[0] for r in last.collect()}
    assert {r[0] for r in opened.collect()} <= {r[0] for r in waiting.select("call_id").distinct().collect()}
    assert waiting.select("call_id").distinct().count() < last.count() / 2
    given = spark.read.parquet(f"{path}/chunks")
    assert given.count() + waiting.count() == inputs.chunks(spark, SMALL).count()


def test_a_call_with_very_many_ends_is_linear(spark):
    """100,000 chunks, every other one an end: each has a preview, none a copy of the text."""
    chunks = spark.range(100_000).selectExpr(
        "'c' as call_id", "id as seq", "timestamp_ntz'2024-01-01 00:00:00' as ts", "if(id % 2 = 1, 'done', 'token') as type",
        "if(id % 2 = 0, concat('word', id, ' and more '), null) as content", "cast(id as int) as input_tokens", "1 as output_tokens", "cast(null as string) as error_msg",
    )
    found = fold.previewed_outcomes(chunks)
    longest = found.agg(F.max(F.length("text")), F.count("*")).first()
    assert longest[0] < 1100 and longest[1] == 50_000
    assert fold.call_replies(chunks).select(F.length("reply")).first()[0] == sum(len(f"word{k} and more ") for k in range(0, 100_000, 2))


def test_waiting_calls_need_no_python(spark, tmp_path):
    """Ten thousand calls of one batch: no state operator and no Python is in the plan."""
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(10_000).selectExpr(
        "id as call_id", "0L as seq", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as ts", "'done' as type",
        "cast(null as string) as content", "1 as input_tokens", "1 as output_tokens", "cast(null as string) as error_msg",
    )
    written(rows, source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = call_stream.start_fold(stream, calls, path, f"{path}/checkpoint")
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "Python" not in plan and "Pandas" not in plan and not query.lastProgress.stateOperators
    given, waiting = spark.read.parquet(f"{path}/chunks"), call_stream.open_chunks(spark, f"{path}/checkpoint", f"{path}/open")
    assert (given.count(), waiting.count()) == (10_000 - 31, 31)
