from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.functions import display
from callgauge.functions.times import iso_utc
from callgauge.operators import metrics
from callgauge.sources import sinks

AS_OF = datetime(2024, 5, 2, 12, 3, 7)
SCHEMA = (
    "id BIGINT, conversation_id BIGINT, message_id BIGINT, model STRING, provider STRING, latency_ms BIGINT, "
    "input_tokens INT, output_tokens INT, status STRING, error_msg STRING, input_preview STRING, "
    "output_preview STRING, created_at TIMESTAMP_NTZ"
)


def log(i, at, latency=10, status="success", tokens=(1, 2)):
    return (i, 1, None, "m", "p", latency, *tokens, status, None, None, None, at)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_empty_table(spark):
    row = metrics.metrics_summary(frame(spark, []), AS_OF).first()
    assert row.asDict() == {
        "total_calls": 0,
        "error_count": 0,
        "error_rate": 0.0,
        "avg_latency_ms": 0.0,
        "p95_latency_ms": None,
        "total_input_tokens": 0,
        "total_output_tokens": 0,
        "calls_last_hour": 0,
    }
    cards = metrics.summary_cards(metrics.metrics_summary(frame(spark, []), AS_OF)).first()
    assert (cards.error_rate, cards.error_class, cards.p95_latency) == ("0%", "good", "p95 — ms")
    assert metrics.chart_points(metrics.latency_series(frame(spark, []), AS_OF)).count() == 0


def test_summary_equals_numpy(spark):
    rng = random.Random(3)
    latencies = [rng.choice([5, 7, 7, 7, 900, rng.randint(0, 5000)]) for _ in range(777)]
    rows = [log(i, AS_OF - timedelta(minutes=i), n, "error" if i % 9 == 0 else "success") for i, n in enumerate(latencies)]
    row = metrics.metrics_summary(frame(spark, rows), AS_OF).first()
    assert row.p95_latency_ms == pytest.approx(float(np.percentile(latencies, 95)))
    assert row.avg_latency_ms == pytest.approx(sum(latencies) / 777)
    assert row.error_rate == pytest.approx(87 / 777)
    assert row.calls_last_hour == 60


def test_time_limits_are_strict_and_open(spark):
    hour, day = AS_OF - timedelta(hours=1), AS_OF - timedelta(hours=24)
    tick = timedelta(microseconds=1)
    rows = [log(i, at) for i, at in enumerate([hour, hour + tick, AS_OF + timedelta(days=3), day, day + tick])]
    assert metrics.metrics_summary(frame(spark, rows), AS_OF).first().calls_last_hour == 2
    assert sum(r.calls for r in metrics.latency_series(frame(spark, rows), AS_OF).collect()) == 4


def test_missing_tokens_are_skipped(spark):
    rows = [log(1, AS_OF, tokens=(None, None)), log(2, AS_OF, tokens=(3, None))]
    row = metrics.metrics_summary(frame(spark, rows), AS_OF).first()
    assert (row.total_input_tokens, row.total_output_tokens) == (3, 0)
    label = metrics.log_display(frame(spark, rows)).orderBy("id").first()
    assert (label.tokens_label, label.input_preview, label.status_class) == ("?/?", "", "ok")


def test_buckets(spark):
    base = datetime(2024, 5, 2, 11, 0)
    rows = [log(i, base + timedelta(minutes=m), n, s) for i, (m, n, s) in enumerate([(0, 10, "success"), (4, 20, "error"), (12, 30, "success")])]
    got = [tuple(r) for r in metrics.latency_series(frame(spark, rows), AS_OF).collect()]
    assert got == [(base, 15.0, 2, 1), (base + timedelta(minutes=10), 30.0, 1, 0)]
    points = [tuple(r) for r in metrics.chart_points(metrics.latency_series(frame(spark, rows), AS_OF)).orderBy("bucket").collect()]
    assert points == [(base, 0.0, 125.0), (base + timedelta(minutes=10), 860.0, 30.0)]


def test_date_partitioned_table(spark, tmp_path):
    rows = [log(i, AS_OF - timedelta(hours=i // 3)) for i in range(600)]
    path = str(tmp_path / "logs")
    sinks.append_by_date(frame(spark, rows[:300]), path)
    sinks.append_by_date(frame(spark, rows[300:]), path)
    stored = spark.read.parquet(path)
    plain = frame(spark, rows)
    for n in (1, 100, 5000):
        assert metrics.recent_logs(stored, n).collect() == metrics.recent_logs(plain, n).collect()
    series = metrics.latency_series(stored, AS_OF)
    assert series.collect() == metrics.latency_series(plain, AS_OF).collect()
    plan = series._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "GreaterThan(created_at" in plan
    assert "log_date" in metrics.recent_logs(stored)._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:60]


def test_ties_in_time_are_ordered_by_id(spark):
    rows = [log(i, AS_OF) for i in range(10)]
    assert [r.id for r in metrics.recent_logs(frame(spark, rows), 3).collect()] == [9, 8, 7]


def test_fixed_point_rounds_the_binary_value(spark):
    rng = random.Random(5)
    values = [0.15, 0.25, 0.35, 0.45, 2.5, 3.5, 99.95, 1e-20, 0.0, 0.05, 0.95, 1234567.25]
    values += [rng.randint(0, 10**6) / rng.choice([7, 100, 1000, 2000, 4096]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    got = rows.select(display.fixed_point(F.col("x"), 1), display.fixed_point(F.col("x"), 0)).collect()
    for value, (one, none) in zip(values, got, strict=True):
        assert one == str(Decimal(value).quantize(Decimal("0.1"), ROUND_HALF_UP))
        assert none == str(Decimal(value).quantize(Decimal("1"), ROUND_HALF_UP))


def test_relative_age(spark):
    ages = [(timedelta(seconds=-5), "just now"), (timedelta(seconds=59), "just now"), (timedelta(seconds=60), "1m ago"),
            (timedelta(minutes=59, seconds=59), "59m ago"), (timedelta(minutes=60), "1h ago"), (timedelta(hours=23, minutes=59), "23h ago"),
            (timedelta(hours=24), "1d ago"), (timedelta(days=6, hours=23), "6d ago"), (timedelta(days=7), "2024-04-25")]
    rows = spark.createDataFrame([(i, AS_OF - age) for i, (age, _) in enumerate(ages)], "i INT, at TIMESTAMP_NTZ")
    got = [r[0] for r in rows.orderBy("i").select(display.relative_age(F.col("at"), AS_OF)).collect()]
    assert got == [label for _, label in ages]


def test_iso_times(spark):
    times = [(datetime(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04:05Z"), (datetime(2024, 1, 2, 3, 4, 5, 120000), "2024-01-02T03:04:05.120Z"),
             (datetime(2024, 1, 2, 3, 4, 5, 7), "2024-01-02T03:04:05.000007Z")]
    rows = spark.createDataFrame([(t,) for t, _ in times], "t TIMESTAMP_NTZ")
    assert [r[0] for r in rows.select(iso_utc("t")).collect()] == [text for _, text in times]
