"""Live dashboard: latency series, summary and latest calls over a stream of call logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.functions.times import as_of_column
from callgauge.operators.metrics import (
    BUCKET,
    LATEST_CALLS,
    between,
    in_last_hour,
    latency_buckets,
    recent_logs,
    summary_of,
)
from callgauge.streaming import snapshots
from callgauge.streaming.ingest import DRAIN, Trigger

AsOf = datetime | Column | None


def start_latency(
    logs: DataFrame, path: str, checkpoint: str, trigger: Trigger = DRAIN
) -> StreamingQuery:
    """Keep a table of five-minute buckets up to date.

    Each trigger hands on the buckets it changed. Late calls always count; the
    state is one row per bucket, some 100,000 a year.
    """
    buckets = latency_buckets(logs).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))

    def store(batch: DataFrame, batch_id: int) -> None:
        state = snapshots.previous(batch.sparkSession, path, batch_id)
        snapshots.save(snapshots.upserted(state, batch, "bucket"), path, batch_id)

    writer = buckets.writeStream.outputMode("update").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_latency(spark: SparkSession, path: str, logs: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Buckets of the last 24 hours: from the table, but the oldest one from the logs.

    The 24 hours begin inside that bucket, so its calls are counted when asked;
    the scan skips all dates but theirs.
    """
    start = as_of_column(as_of) - F.expr("interval 24 hours")
    oldest = latency_buckets(between(logs, start, start + F.expr(f"interval {BUCKET}")))
    whole = snapshots.latest(spark, path).filter(F.col("bucket") > start)
    return whole.unionByName(oldest.filter(F.col("bucket") <= start)).orderBy("bucket")


def start_summary(logs: DataFrame, path: str, checkpoint: str, trigger: Trigger = DRAIN) -> StreamingQuery:
    """Keep the latency histogram up to date.

    State is one row per latency value, spread over all tasks; from it the exact
    percentile follows at any time, however long the stream runs.
    """
    histogram = logs.groupBy("latency_ms").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.col("input_tokens").cast("bigint")).alias("input_tokens"),
        F.sum(F.col("output_tokens").cast("bigint")).alias("output_tokens"),
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        state = snapshots.previous(batch.sparkSession, path, batch_id)
        snapshots.save(snapshots.upserted(state, batch, "latency_ms"), path, batch_id)

    writer = histogram.writeStream.outputMode("update").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_summary(spark: SparkSession, path: str, logs: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Headline numbers: totals from the histogram, the last hour from the log table.

    The last hour moves with the clock, so it is counted when asked; the scan
    skips all dates but the newest.
    """
    last_hour = in_last_hour(logs, as_of).agg(F.count("*").alias("n"))
    totals = summary_of(snapshots.latest(spark, path).withColumn("recent", F.lit(0).cast("bigint")))
    return totals.withColumn("calls_last_hour", last_hour.scalar())


def start_recent(
    logs: DataFrame, path: str, checkpoint: str, limit: int = LATEST_CALLS, trigger: Trigger = DRAIN
) -> StreamingQuery:
    """Keep the latest calls: those kept so far and the new ones, cut to ``limit`` again."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = recent_logs(batch, limit)
        state = snapshots.previous(batch.sparkSession, path, batch_id)
        if state is not None:
            rows = recent_logs(state.unionByName(rows), limit)
        snapshots.save(rows, path, batch_id)

    writer = logs.writeStream.foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_recent(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.latest(spark, path).orderBy(F.desc("created_at"), F.desc("id"))
