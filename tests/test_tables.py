"""Stored tables end to end: captures to chunks to a log table and its reports."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import datetime, timedelta

from callgauge.operators import fold, frames, integrity, metrics
from callgauge.sources import schemas, sinks, tables
from callgauge.sources.workspace import run_folder
from callgauge.streaming import ingest
from test_frames import GEMINI, OPENAI, g

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NOW = datetime(2024, 6, 1, 12)


def capture_rows():
    out = []
    for i, (name, (pieces, _)) in enumerate(OPENAI.items()):
        out += [(f"o{i}", "openai", n, NOW + timedelta(milliseconds=5 * n), 200, bytearray(p), None) for n, p in enumerate(pieces)]
    for i, (name, (body, _)) in enumerate(GEMINI.items()):
        out.append((f"g{i}", "gemini", 0, NOW, 200, bytearray(body), None))
    out.append(("refused", "gemini", 0, NOW, 429, bytearray(g("x").encode()), None))
    return out


def test_captures_to_reports(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame(capture_rows(), schemas.RAW_CAPTURES).write.parquet(f"{path}/captures")
    captured = tables.captures(spark, f"{path}/captures")
    ids = sorted({r[0] for r in capture_rows()})
    calls = spark.createDataFrame(
        [(i, "c1", f"m-{i}", "openai", "gpt", NOW - timedelta(seconds=1), "hi") for i in ids], schemas.CALLS
    )
    spark.createDataFrame([("c1", "s", "t", NOW, NOW)], schemas.CONVERSATIONS).write.parquet(f"{path}/conversations")
    spark.createDataFrame([(f"m-{i}", "c1", "assistant", "", NOW) for i in ids], schemas.MESSAGES).write.parquet(f"{path}/messages")
    events = fold.fold_calls(calls, frames.frames(captured)).select(*sinks.EVENT_COLUMNS)
    checked = integrity.check_logs(events, tables.conversations(spark, f"{path}/conversations"), tables.messages(spark, f"{path}/messages"))
    sinks.append_by_date(sinks.new_logs(integrity.accepted(checked), NOW), f"{path}/logs")
    stored = tables.inference_logs(spark, f"{path}/logs")
    ends = sum(kind in ("done", "error") for want in [*OPENAI.values(), *GEMINI.values()] for kind, _ in want[1])
    row = metrics.metrics_summary(stored, NOW).first()
    assert row.total_calls == stored.count() > 0 and row.total_calls <= ends + 1
    assert row.calls_last_hour == row.total_calls
    (bucket,) = metrics.latency_series(stored, NOW).collect()
    assert bucket.bucket == NOW and bucket.calls == row.total_calls
    refused = stored.filter("error_msg like 'provider returned 429%'").first()
    assert refused.output_preview is None and refused.latency_ms == 1000
    # The same events as a stream give the same table.
    events.write.parquet(f"{path}/events")
    stream = tables.log_event_stream(spark, f"{path}/events", 2)

    def owners(session):
        return tables.conversations(session, f"{path}/conversations"), tables.messages(session, f"{path}/messages")

    ingest.start_ingest(stream, owners, f"{path}/live", f"{path}/checkpoint", NOW).awaitTermination()
    live = ingest.stored_logs(spark, f"{path}/live")
    assert metrics.metrics_summary(live, NOW).collect() == [row]


def test_files_per_day_stay_few(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 16).selectExpr(
        "cast(id as string) as id", "cast(id % 7 as string) as conversation_id", "cast(null as string) as message_id",
        "'m' as model", "'p' as provider", "id as latency_ms", "cast(null as int) as input_tokens",
        "cast(null as int) as output_tokens", "'success' as status", "cast(null as string) as error_msg",
        "cast(null as string) as input_preview", "cast(null as string) as output_preview",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 5 as int)) as created_at",
    )
    path = str(tmp_path / "logs")
    sinks.append_by_date(rows, path)
    stored = tables.inference_logs(spark, path)
    assert stored.count() == 20_000 and len(stored.inputFiles()) <= 10


def test_run_folder_is_shared_when_named(spark):
    """The setting is fixed when a session starts, so this one starts in a process of its own."""
    script = (
        "from pyspark.sql import SparkSession\n"
        "from callgauge.sources.workspace import run_folder\n"
        "builder = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false')\n"
        "spark = builder.config('spark.driver.host', '127.0.0.1').config('spark.checkpoint.dir', '/tmp/shared').getOrCreate()\n"
        "print('folder', run_folder(spark, 'x'))\n"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert "folder /tmp/shared/x-" in done.stdout
    assert run_folder(spark, "x") != run_folder(spark, "x")
