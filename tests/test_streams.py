"""Streams over several micro-batches give what their batch twins give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from callgauge.operators import integrity, metrics
from callgauge.plans import inputs
from callgauge.streaming import ingest, live, lookup
from conftest import SMALL


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """The events in eight files, rows dealt out at random, so many come late."""
    path = str(tmp_path_factory.mktemp("events"))
    inputs.table(spark, SMALL, "events").orderBy(F.rand(3)).repartition(8).write.mode("overwrite").parquet(path)
    return path


def logs(spark, source):
    schema = inputs.table(spark, SMALL, "events").schema
    no_text = F.lit(None).cast("string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return inputs.logs_of(stream).withColumn("input_preview", no_text).withColumn("output_preview", no_text)


def rows(frame) -> list[str]:
    return sorted(str(tuple(r)) for r in frame.select(*sorted(frame.columns)).collect())


def batch_logs(spark):
    no_text = F.lit(None).cast("string")
    return inputs.logs(spark, SMALL).withColumn("input_preview", no_text).withColumn("output_preview", no_text)


@pytest.mark.parametrize("keys", [200_000, 0])
def test_ingest(spark, source, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(lookup, "BROADCAST_KEYS", keys)
    path = str(tmp_path)

    def owners(session):
        return inputs.conversations(session, SMALL), inputs.messages(session, SMALL)

    started = ingest.start_ingest(logs(spark, source), owners, f"{path}/logs", f"{path}/c", inputs.AS_OF)
    started.awaitTermination()
    got = ingest.ingested(spark, f"{path}/logs")
    assert got.select("batch_id").distinct().count() == 8
    want = integrity.check_logs(batch_logs(spark), *owners(spark))
    assert rows(got.select("message_id", "latency_ms", "reason")) == rows(want.select("message_id", "latency_ms", "reason"))
    stored = ingest.stored_logs(spark, f"{path}/logs")
    assert stored.count() == integrity.accepted(want).count() and "reason" not in stored.columns
    assert got.select("id").distinct().count() == 1000
    # A second start with the same checkpoint finds nothing new and adds nothing.
    ingest.start_ingest(logs(spark, source), owners, f"{path}/logs", f"{path}/c", inputs.AS_OF).awaitTermination()
    assert ingest.ingested(spark, f"{path}/logs").count() == 1000


def test_latency_counts_late_calls(spark, source, tmp_path):
    path = str(tmp_path)
    live.start_latency(logs(spark, source), f"{path}/t", f"{path}/c").awaitTermination()
    for as_of in (inputs.AS_OF, inputs.AS_OF.replace(day=20, hour=7, minute=13, second=41)):
        got = live.live_latency(spark, f"{path}/t", batch_logs(spark), as_of)
        assert rows(got) == rows(metrics.latency_series(batch_logs(spark), as_of))


def test_summary(spark, source, tmp_path):
    path = str(tmp_path)
    live.start_summary(logs(spark, source), f"{path}/t", f"{path}/c").awaitTermination()
    for as_of in (inputs.AS_OF, inputs.AS_OF.replace(day=12)):
        got = live.live_summary(spark, f"{path}/t", batch_logs(spark), as_of)
        assert rows(got) == rows(metrics.metrics_summary(batch_logs(spark), as_of))


def test_recent(spark, source, tmp_path):
    path = str(tmp_path)
    live.start_recent(logs(spark, source), f"{path}/t", f"{path}/c").awaitTermination()
    assert live.live_recent(spark, f"{path}/t").collect() == metrics.recent_logs(batch_logs(spark)).collect()


def test_repeated_batch_replaces_itself(spark, tmp_path):
    from callgauge.streaming import snapshots

    path = str(tmp_path)
    frame = spark.createDataFrame([(i, random.random()) for i in range(5)], "k INT, v DOUBLE")
    snapshots.save(frame, path, 0)
    for _ in range(2):
        state = snapshots.previous(spark, path, 1)
        changed = spark.createDataFrame([(3, 9.0), (7, 1.0)], "k INT, v DOUBLE")
        snapshots.save(snapshots.upserted(state, changed, "k"), path, 1)
    got = {r.k: r.v for r in snapshots.latest(spark, path).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 7] and got[3] == 9.0


def test_a_reader_outlives_later_batches(spark, tmp_path):
    from callgauge.streaming import snapshots

    path = str(tmp_path)
    for batch in range(3):
        snapshots.save(spark.createDataFrame([(batch, 1.0)], "k INT, v DOUBLE"), path, batch)
    seen = snapshots.latest(spark, path)
    for batch in range(3, 3 + snapshots.SLOTS - 1):
        snapshots.save(spark.createDataFrame([(batch, 1.0)], "k INT, v DOUBLE"), path, batch)
    assert [r.k for r in seen.collect()] == [2]
    assert [r.k for r in snapshots.latest(spark, path).collect()] == [2 + snapshots.SLOTS - 1]


def test_tables_of_part_files_are_read_whole(spark, tmp_path):
    """A table that is a folder, next to one whose name only begins alike."""
    from callgauge.plans.queries import REGISTRY

    folder = str(tmp_path / "sf")
    for name in ("events", "conversations"):
        inputs.table(spark, SMALL, name).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    inputs.table(spark, SMALL, "events").write.parquet(f"{folder}/events_old.parquet")
    for name in ("stream_summary", "stream_fold"):
        assert rows(REGISTRY[name](spark, folder)) == rows(REGISTRY[name](spark, SMALL))


def test_ids_beyond_32_bits(spark, tmp_path):
    far = inputs.table(spark, SMALL, "conversations").withColumn("conv_id", F.col("conv_id") + F.lit(3 * 10**9))
    far.write.parquet(str(tmp_path / "conversations.parquet"))
    assert inputs.messages(spark, str(tmp_path)).filter("created_at is null").count() == 0
    assert inputs.chunks(spark, str(tmp_path)).count() > 0 and inputs.conversations(spark, str(tmp_path)).count() > 0
