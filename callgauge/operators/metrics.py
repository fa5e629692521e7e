"""Call metrics: headline summary, five-minute latency series, latest calls."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.functions import display
from callgauge.functions.times import as_of_column

AsOf = datetime | Column | None

# Fixed values.
BUCKET = "5 minutes"
LATEST_CALLS = 100
CHART_WIDTH = 860
CHART_HEIGHT = 220
CHART_MARGIN = 30

LOG_COLUMNS = (
    "id",
    "conversation_id",
    "model",
    "provider",
    "latency_ms",
    "input_tokens",
    "output_tokens",
    "status",
    "error_msg",
    "input_preview",
    "output_preview",
    "created_at",
)


def latency_histogram(logs: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Every counter of the summary, kept per latency value.

    The scan reads five columns once and combines map-side; what is shuffled is
    at most one row per task and latency value, however many calls share it.
    """
    recent = F.col("created_at") > as_of_column(as_of) - F.expr("interval 1 hour")
    return logs.groupBy("latency_ms").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.col("input_tokens").cast("bigint")).alias("input_tokens"),
        F.sum(F.col("output_tokens").cast("bigint")).alias("output_tokens"),
        F.count_if(recent).alias("recent"),
    )


def summary_of(histogram: DataFrame) -> DataFrame:
    """One row of headline numbers from a latency histogram.

    The 95th percentile is exact and interpolated. Its value-to-count map holds
    distinct latencies, not calls.
    """
    total = F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint")
    return histogram.agg(
        total.alias("total_calls"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("error_count"),
        F.sum(F.col("latency_ms") * F.col("calls")).alias("latency_sum"),
        F.percentile("latency_ms", F.lit(0.95), F.col("calls")).alias("p95_latency_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("total_output_tokens"),
        F.coalesce(F.sum("recent"), F.lit(0)).cast("bigint").alias("calls_last_hour"),
    ).select(
        "total_calls",
        "error_count",
        F.when(F.col("total_calls") > 0, F.col("error_count") / F.col("total_calls"))
        .otherwise(0.0)
        .alias("error_rate"),
        F.when(F.col("total_calls") > 0, F.col("latency_sum") / F.col("total_calls"))
        .otherwise(0.0)
        .alias("avg_latency_ms"),
        "p95_latency_ms",
        "total_input_tokens",
        "total_output_tokens",
        "calls_last_hour",
    )


def metrics_summary(logs: DataFrame, as_of: AsOf = None) -> DataFrame:
    return summary_of(latency_histogram(logs, as_of))


def in_last_day(logs: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Calls of the last 24 hours (strict, no upper bound)."""
    return between(logs, as_of_column(as_of) - F.expr("interval 24 hours"))


def in_last_hour(logs: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Calls of the last hour (strict, no upper bound)."""
    return between(logs, as_of_column(as_of) - F.expr("interval 1 hour"))


def between(logs: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Calls after ``start`` and before ``end``; on a date-partitioned table other dates are skipped."""
    rows = logs.filter(F.col("created_at") > start)
    if end is not None:
        rows = rows.filter(F.col("created_at") < end)
    if "log_date" in logs.columns:
        rows = rows.filter(F.col("log_date") >= start.cast("date"))
        if end is not None:
            rows = rows.filter(F.col("log_date") <= end.cast("date"))
    return rows


def latency_buckets(logs: DataFrame) -> DataFrame:
    """Five-minute buckets, unordered; a bucket without calls has no row."""
    return (
        logs.groupBy(F.window("created_at", BUCKET).alias("w"))
        .agg(
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.count("*").alias("calls"),
            F.count_if(F.col("status") == "error").alias("error_count"),
        )
        .select(F.col("w.start").alias("bucket"), "avg_latency_ms", "calls", "error_count")
    )


def latency_series(logs: DataFrame, as_of: AsOf = None) -> DataFrame:
    return latency_buckets(in_last_day(logs, as_of)).orderBy("bucket")


def latest_calls(logs: DataFrame, limit: int = LATEST_CALLS) -> DataFrame:
    """Latest calls with all their columns, newest first; equal times are ordered by id.

    On a date-partitioned table the top-k reads only the newest dates that hold
    ``limit`` calls between them. Finding those dates reads no data column.
    """
    if "log_date" in logs.columns:
        per_date = logs.groupBy("log_date").agg(F.count("*").alias("calls"))
        newest_first = per_date.select(
            "log_date",
            F.expr("sum(calls) over (order by log_date desc)").alias("so_far"),
        )
        oldest_needed = (
            newest_first.agg(
                F.coalesce(
                    F.max(F.when(F.col("so_far") >= limit, F.col("log_date"))),
                    F.min("log_date"),
                ).alias("log_date")
            )
        )
        logs = logs.filter(F.col("log_date") >= oldest_needed.scalar())
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def recent_logs(logs: DataFrame, limit: int = LATEST_CALLS) -> DataFrame:
    return latest_calls(logs, limit).select(*LOG_COLUMNS)


def log_display(logs: DataFrame, limit: int = LATEST_CALLS) -> DataFrame:
    """Latest calls with the labels the log table shows."""

    def tokens(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(display.UNKNOWN_TOKENS))

    return recent_logs(logs, limit).select(
        "id",
        "created_at",
        F.concat("provider", F.lit("/"), "model").alias("model_label"),
        F.concat(F.col("latency_ms").cast("string"), F.lit("ms")).alias("latency_label"),
        F.concat(tokens("input_tokens"), F.lit("/"), tokens("output_tokens")).alias("tokens_label"),
        "status",
        F.when(F.col("status") == "success", "ok").when(F.col("status") == "error", "err").alias("status_class"),
        F.coalesce("input_preview", F.lit("")).alias("input_preview"),
        F.coalesce("output_preview", F.lit("")).alias("output_preview"),
    )


def summary_cards(summary: DataFrame) -> DataFrame:
    tokens = F.col("total_input_tokens") + F.col("total_output_tokens")
    return summary.select(
        F.col("total_calls").cast("string").alias("total_calls"),
        display.percent_label(F.col("error_rate")).alias("error_rate"),
        display.health_class(F.col("error_rate")).alias("error_class"),
        F.concat(F.col("error_count").cast("string"), F.lit(" failed")).alias("failed"),
        F.concat(display.rounded_label(F.col("avg_latency_ms")), F.lit(" ms")).alias("avg_latency"),
        F.concat(F.lit("p95 "), display.rounded_label(F.col("p95_latency_ms")), F.lit(" ms")).alias("p95_latency"),
        F.col("calls_last_hour").cast("string").alias("calls_last_hour"),
        display.thousands(tokens).alias("tokens"),
        F.concat(
            display.thousands(F.col("total_input_tokens")),
            F.lit(" in · "),
            display.thousands(F.col("total_output_tokens")),
            F.lit(" out"),
        ).alias("tokens_split"),
    )


def chart_points(series: DataFrame) -> DataFrame:
    """Chart coordinates of a latency series; no rows for fewer than two buckets.

    A day has at most 289 buckets, so one window over all of them stays small.
    """
    numbered = series.select(
        "bucket",
        "avg_latency_ms",
        F.expr("row_number() over (order by bucket) - 1").alias("i"),
        F.expr("count(*) over (order by bucket rows between unbounded preceding and unbounded following)").alias("n"),
        F.expr(
            "greatest(max(avg_latency_ms) over "
            "(order by bucket rows between unbounded preceding and unbounded following), 1.0D)"
        ).alias("top"),
    ).filter("n >= 2")
    return numbered.select(
        "bucket",
        (F.col("i") / (F.col("n") - 1) * CHART_WIDTH).alias("x"),
        (F.lit(CHART_HEIGHT) - F.col("avg_latency_ms") / F.col("top") * (CHART_HEIGHT - CHART_MARGIN)).alias("y"),
    )
