"""Tables with a primary key: repeated ids are refused, with a reason, where rows are stored.

Next to the rows lies an index of their ids, dealt to folders by a hash of the id. A batch
reads the folders its own ids fall into, and of these only its ids, and adds its own files
there, which a repeated run of the batch replaces.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.operators import integrity
from callgauge.sources import sinks

BUCKETS = 32


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _bucket(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.col(key) if isinstance(key, str) else key), F.lit(BUCKETS)).cast("int")


def known_ids(spark: SparkSession, index: str, ids: DataFrame, batch_id: int) -> DataFrame:
    """Which of ``ids(id)`` other batches have stored."""
    if not _exists(spark, index):
        return ids.limit(0)
    buckets = [r["bucket"] for r in ids.select(_bucket("id").alias("bucket")).distinct().collect()]  # BUCKETS rows at most
    stored = spark.read.schema("id STRING, bucket INT, batch_id BIGINT").parquet(index)
    here = stored.filter(F.col("bucket").isin(buckets) & (F.col("batch_id") != batch_id))
    return here.select("id").join(ids, "id", "left_semi")


def add_ids(ids: DataFrame, index: str, batch_id: int) -> None:
    """Put the ids of a batch into the index; a repeated batch replaces its own."""
    rows = ids.select("id", _bucket("id").alias("bucket"), F.lit(batch_id).cast("bigint").alias("batch_id"))
    writer = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(index)


def check_new_keys(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct rows with ``reason`` and ``copies``: one row of each new id is free to be stored.

    Of several rows of one id the smallest stays, once. The winner of an id is a map-side
    minimum and equal rows are counted, so an id on very many rows costs a row per task.
    """
    rest = F.struct(*[F.col(c) for c in rows.columns if c != "id"])
    distinct = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    first = rows.groupBy("id").agg(F.min(rest).alias("_first"))
    taken = known.select("id").distinct().withColumn("_taken", F.lit(True))
    met = distinct.join(first, "id").join(taken, "id", "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))

    def outcome(reason: str | None, copies: Column) -> Column:
        return F.struct(F.lit(reason).cast("string").alias("reason"), copies.cast("bigint").alias("copies"))

    wins = F.col("_first").eqNullSafe(rest)
    copies = F.col("copies")
    outcomes = (
        F.when(F.col("_taken"), F.array(outcome("id taken", copies)))
        .when(wins & (copies > 1), F.array(outcome(None, F.lit(1)), outcome("id repeated", copies - 1)))
        .when(wins, F.array(outcome(None, copies)))
        .otherwise(F.array(outcome("id repeated", copies)))
    )
    return met.withColumn("_o", F.explode(outcomes)).select(*rows.columns, "_o.reason", "_o.copies")


def store_messages(
    rows: DataFrame, conversations: DataFrame, path: str, batch_id: int = 0, now: datetime | Column | None = None
) -> None:
    """Append messages (id, conversation_id, role, content, perhaps session_id) under their rules.

    Required values, role, conversation (with a session_id: one of that session; another's
    looks like a missing one), and the key: an id that is stored or that comes twice is
    refused. A row without id gets one. Refused rows lie next to the stored ones, under
    outcome=refused, with ``reason`` and ``copies``. A repeated batch replaces its own rows.
    """
    spark = rows.sparkSession
    given = rows.withColumn("id", F.col("id").cast("string"))
    checked = integrity.check_messages(given, conversations)
    good, bad = integrity.accepted(checked), integrity.refused(checked).withColumn("copies", F.lit(1).cast("bigint"))
    keyed = good.filter(F.col("id").isNotNull())
    new = good.filter(F.col("id").isNull()).withColumns({"reason": F.lit(None).cast("string"), "copies": F.lit(1).cast("bigint")})
    known = known_ids(spark, f"{path}/ids", keyed.select("id").distinct(), batch_id)
    every = check_new_keys(keyed, known).unionByName(new).unionByName(bad)
    stamped = sinks.new_messages(every, now, "reason", "copies")
    outcome = F.when(F.col("reason").isNull(), "stored").otherwise("refused")
    sinks.write_batch(stamped.withColumn("outcome", outcome), f"{path}/rows", batch_id, "outcome")
    add_ids(stored_messages(spark, path, batch_id).select("id"), f"{path}/ids", batch_id)


def message_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Everything that was sent to the table, with ``outcome``, ``reason`` and ``copies``."""
    return spark.read.parquet(f"{path}/rows")


def stored_messages(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """The message table, or the rows that one batch added to it."""
    rows = message_outcomes(spark, path).filter(F.col("outcome") == "stored")
    if batch_id is not None:
        rows = rows.filter(F.col("batch_id") == batch_id)
    return rows.drop("outcome", "reason", "copies", "batch_id")


def store_conversations(requests: DataFrame, path: str, batch_id: int = 0, now: datetime | Column | None = None) -> None:
    """Open a conversation for every request(session_id); one without session is refused."""
    checked = integrity.check_conversations(sinks.open_conversations(requests, now))
    outcome = F.when(F.col("reason").isNull(), "stored").otherwise("refused")
    rows = checked.withColumn("outcome", outcome)
    sinks.write_batch(rows, path, batch_id, "outcome", order="session_id")
