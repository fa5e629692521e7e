"""Folding calls from a stream of chunks that may come in over many micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.operators.fold import fold_calls
from callgauge.operators.frames import CHUNK_COLUMNS
from callgauge.sources.sinks import write_batch
from callgauge.streaming import openchunks, snapshots
from callgauge.streaming.ingest import DRAIN, Trigger
from callgauge.streaming.lookup import referenced

Calls = Callable[[SparkSession], DataFrame]

#: Folders that given-out chunks are dealt to by call, so that a call's earlier ones are found.
BUCKETS = 64
#: In place of a batch: chunks that still waited when the table was last asked for drained calls.
WAITING = -1


def _interval(spark: SparkSession, length: str) -> Column:
    ms = spark.sql(f"select unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {length})").first()[0]
    return F.make_dt_interval(secs=(F.lit(int(ms)) / 1000).cast("decimal(18,6)"))


def _bucket():
    return F.pmod(F.xxhash64("call_id"), F.lit(BUCKETS)).cast("int")


def _given_before(spark: SparkSession, path: str, calls: DataFrame, batch_id: int | None = None) -> DataFrame:
    """Chunks of ``calls(call_id)`` given out in other batches; only their folders are read."""
    keyed = calls.withColumn("bucket", _bucket())
    buckets = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # BUCKETS rows at most
    stored = spark.read.parquet(f"{path}/chunks").filter(F.col("bucket").isin(buckets) & (F.col("batch_id") != WAITING))
    if batch_id is not None:
        stored = stored.filter(F.col("batch_id") != batch_id)
    return stored.join(calls, "call_id", "left_semi").select(*CHUNK_COLUMNS)


def start_fold(
    chunks: DataFrame,
    calls: Calls,
    path: str,
    checkpoint: str,
    quiet: str = "30 minutes",
    trigger: Trigger = DRAIN,
    remember: str = "7 days",
) -> StreamingQuery:
    """Fold each call once it has been quiet for ``quiet`` of event time.

    Chunks wait in a table beside the checkpoint, by call and block of sequence numbers, and
    leave it when their block is quiet; a batch reads the chunks it brings, those that wait
    and the marks of blocks given out before. Given-out chunks are written once, to the chunk
    table. If a call has had chunks given out before (late ones came, or it has several
    blocks), it is folded anew from all of its chunks, which are looked up in the folders of
    these calls; readers take the rows of a call's latest folding. So files may come in any
    order. That chunks were given out is remembered for ``remember`` of event time; a chunk
    later than that is folded alone. A batch that is run again starts from what waited before
    it and replaces its own output. Folding is joins and groupings over blocks of chunks, as
    in the batch fold.
    """
    session, state = chunks.sparkSession, openchunks.folder_of(checkpoint)
    quiet_for, remembered = _interval(session, quiet), _interval(session, remember)

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = openchunks.taken(batch).persist()
        before, marks = snapshots.previous(spark, state, batch_id), None
        times = [openchunks.newest(taken)]
        if before is not None:
            times.append(openchunks.newest(before))
            given = spark.read.parquet(f"{path}/given").filter(F.col("batch_id") < batch_id)
            marks = given.filter(F.col("until") > openchunks.moment(times[-1]))
        now = max(filter(None, times), default=None)
        rows = openchunks.marked(taken, marks)
        if before is not None:
            rows = before.unionByName(rows)
        quiet_now = openchunks.quiet_blocks(rows, now, quiet_for).withColumn("until", openchunks.moment(now) + remembered)
        write_batch(quiet_now, f"{path}/given", batch_id)
        closed = spark.read.schema(quiet_now.schema).parquet(f"{path}/given/batch_id={batch_id}")
        out = openchunks.of_blocks(rows, closed, "left_semi").withColumn("bucket", _bucket())
        write_batch(out, f"{path}/chunks", batch_id, "bucket", order="call_id")
        arrived = spark.read.schema(out.schema).parquet(f"{path}/chunks/batch_id={batch_id}")
        several = closed.filter("block > 0").select("call_id").distinct()
        if batch_id == 0 or not several.isEmpty():
            write_batch(several, f"{path}/long", batch_id)
        known = spark.read.parquet(f"{path}/long").select("call_id")
        again = closed.filter("again").select("call_id").unionByName(known.join(closed, "call_id", "left_semi")).distinct()
        folding = arrived.select(*CHUNK_COLUMNS)
        if not again.isEmpty():
            folding = folding.unionByName(_given_before(spark, path, again, batch_id))
        table = referenced(calls(spark), "call_id", closed, "call_id")
        write_batch(fold_calls(table, folding), f"{path}/logs", batch_id)
        snapshots.save(openchunks.of_blocks(rows, closed, "left_anti"), state, batch_id)
        taken.unpersist()

    writer = chunks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def open_chunks(spark: SparkSession, checkpoint: str, path: str) -> DataFrame:
    """Chunks that wait in the table of a stream that has stopped, written to ``path``."""
    snapshots.latest(spark, openchunks.folder_of(checkpoint)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select(*CHUNK_COLUMNS)


def folded(spark: SparkSession, calls: Calls, path: str, drained: bool = False, checkpoint: str | None = None) -> DataFrame:
    """Call log events so far; ``drained`` also folds the calls that are open.

    Use ``drained`` when the source is closed and no chunk can follow. ``checkpoint`` is that
    of the stream, by default the folder of this name in ``path``.
    """
    rows = spark.read.parquet(f"{path}/logs")
    latest = rows.groupBy("call_id").agg(F.max("batch_id").alias("batch_id"))
    done = rows.join(latest, ["call_id", "batch_id"]).drop("batch_id")
    if not drained:
        return done
    waiting = open_chunks(spark, checkpoint or f"{path}/checkpoint", f"{path}/open")
    shown = spark.read.parquet(f"{path}/open").withColumn("bucket", _bucket())
    write_batch(shown, f"{path}/chunks", WAITING, "bucket", order="call_id")  # so the table has every chunk once
    opened = waiting.select("call_id").distinct()
    folded_now = fold_calls(calls(spark), waiting.unionByName(_given_before(spark, path, opened)))
    return done.join(opened, "call_id", "left_anti").select(*folded_now.columns).unionByName(folded_now)
