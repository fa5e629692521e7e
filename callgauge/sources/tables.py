"""Readers of the stored tables and of captures, with fixed schemas: no file is opened to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callgauge.sources import schemas


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CONVERSATIONS).parquet(path)


def messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MESSAGES).parquet(path)


def inference_logs(spark: SparkSession, path: str) -> DataFrame:
    """Call logs with their folder date ``log_date``, which reports filter on."""
    return spark.read.schema(f"{schemas.INFERENCE_LOGS}, log_date DATE").parquet(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RAW_CAPTURES).parquet(path)


def chunk_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Chunk rows as files arrive; ``max_files`` bounds what one trigger takes in."""
    return _stream(spark, schemas.CHUNKS, path, max_files)


def log_event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Call log events as files arrive; ``max_files`` bounds what one trigger takes in."""
    return _stream(spark, schemas.LOG_EVENTS, path, max_files)


def _stream(spark: SparkSession, schema: str, path: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
