"""Stored tables whose rows change: folders that hold a changed row are written anew.

A table lies in folders by a hash of its dealing column, each under the version that wrote it
last. A change writes the folders it touches under a new version and then a commit, a small
table that names the version of every folder. One job changes a table at a time. Readers follow the last finished commit, so
they see a change whole or not at all, and folders without a changed row keep their files. A
change that finds nothing to do writes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.operators import fold, integrity

FOLDERS = 16
#: The row of a commit that holds what the table is.
ABOUT = -1


class State(NamedTuple):
    """A commit: its number, the version of every folder, and how the table is laid out."""

    number: int
    versions: dict[int, int]
    schema: str
    dealt_by: str
    folders: int

    def folder(self) -> Column:
        return F.pmod(F.xxhash64(self.dealt_by), F.lit(self.folders)).cast("int")


def finished_commits(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.removeprefix("commit=")) for name in done)


def state(spark: SparkSession, path: str) -> State:
    """The last finished commit; as many rows as the table has folders."""
    last = finished_commits(spark, path)[-1]
    rows = spark.read.schema("folder INT, version BIGINT, about STRING").parquet(f"{path}/commits/commit={last}").collect()
    about = next(json.loads(r["about"]) for r in rows if r["folder"] == ABOUT)
    return State(last, {r["folder"]: r["version"] for r in rows if r["folder"] != ABOUT}, **about)


def _commit(spark: SparkSession, path: str, new: State) -> None:
    about = json.dumps({"schema": new.schema, "dealt_by": new.dealt_by, "folders": new.folders})
    rows = [(folder, version, None) for folder, version in new.versions.items()] + [(ABOUT, None, about)]
    table = spark.createDataFrame(rows, "folder INT, version BIGINT, about STRING")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={new.number}")


def _write(rows: DataFrame, path: str, version: int, layout: State) -> dict[int, int]:
    """Write rows under a new version; which folders have some."""
    target, dealt = f"{path}/version={version}", rows.withColumn("folder", layout.folder())
    ordered = dealt.hint("rebalance", "folder").sortWithinPartitions("folder", layout.dealt_by)
    ordered.write.mode("overwrite").partitionBy("folder").parquet(target)
    found = rows.sparkSession.read.schema(dealt.schema).parquet(target).select("folder").distinct().collect()
    return {r["folder"]: version for r in found}


def create(rows: DataFrame, path: str, dealt_by: str, folders: int = FOLDERS) -> None:
    """Store a table; what was stored there before is no longer part of it."""
    commits = finished_commits(rows.sparkSession, path)
    number = commits[-1] + 1 if commits else 0
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    layout = State(number, {}, columns, dealt_by, folders)
    _commit(rows.sparkSession, path, layout._replace(versions=_write(rows, path, number, layout)))


def _read(spark: SparkSession, path: str, at: State, folders: set[int] | None = None) -> DataFrame:
    paths = [f"{path}/version={v}/folder={k}" for k, v in at.versions.items() if folders is None or k in folders]
    if not paths:
        return spark.createDataFrame([], at.schema)
    stored = spark.read.schema(f"{at.schema}, folder INT, version BIGINT").option("basePath", path).parquet(*paths)
    return stored.drop("folder", "version")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last commit."""
    return _read(spark, path, state(spark, path))


def rewrite(spark: SparkSession, path: str, changed: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> set[int]:
    """Change a table: ``changed`` picks the rows that will differ, ``change`` gives the new rows
    of whole folders. Returns the folders written."""
    now = state(spark, path)
    touched = {r["folder"] for r in changed(_read(spark, path, now)).select(now.folder().alias("folder")).distinct().collect()}
    if not touched:
        return touched
    left = _write(change(_read(spark, path, now, touched)), path, now.number + 1, now)
    kept = {k: v for k, v in now.versions.items() if k not in touched}
    _commit(spark, path, now._replace(number=now.number + 1, versions=kept | left))
    return touched


def fill_placeholders(spark: SparkSession, path: str, replies: DataFrame) -> set[int]:
    """Write finished replies(message_id, reply) into a message table dealt by conversation_id.

    An empty reply changes nothing; a reply that is there already is not written again.
    """
    useful = replies.filter(F.col("reply") != "")

    def changed(table: DataFrame) -> DataFrame:
        wanted = useful.select(F.col("message_id").alias("id"), "reply")
        return table.select("id", "conversation_id", "content").join(wanted, "id").filter(~F.col("content").eqNullSafe(F.col("reply")))

    return rewrite(spark, path, changed, lambda rows: fold.resolve_placeholders(rows, useful))


def delete_conversations(spark: SparkSession, deleted: DataFrame, conversations: str, messages: str, logs: str) -> dict[str, set[int]]:
    """Delete conversations(id) with their messages and logs from stored tables: conversations
    dealt by id, the others by conversation_id. A log elsewhere that names a message that
    goes loses the link. Returns the folders written, by table."""
    ids = deleted.select("id").distinct()
    owned = ids.select(F.col("id").alias("conversation_id"))
    gone = read(spark, messages).join(owned, "conversation_id", "left_semi").select("id")

    def of_owner(table: DataFrame) -> DataFrame:
        return table.join(owned, "conversation_id", "left_semi")

    def dead_link(table: DataFrame) -> DataFrame:
        named = table.filter(F.col("message_id").isNotNull()).join(gone.withColumnRenamed("id", "message_id"), "message_id", "left_semi")
        return of_owner(table).select("conversation_id").unionByName(named.select("conversation_id"))

    out = {
        "logs": rewrite(spark, logs, dead_link, lambda rows: integrity.cascade_set_null(integrity.without_deleted(rows, "conversation_id", ids), gone)),
        "messages": rewrite(spark, messages, of_owner, lambda rows: integrity.without_deleted(rows, "conversation_id", ids)),
    }
    out["conversations"] = rewrite(spark, conversations, lambda table: table.join(ids, "id", "left_semi"), lambda rows: integrity.without_deleted(rows, "id", ids))
    return out


def delete_messages(spark: SparkSession, deleted: DataFrame, messages: str, logs: str) -> dict[str, set[int]]:
    """Delete messages(id) from the stored message table and clear the links of logs to them."""
    ids = deleted.select("id").distinct()
    linked = ids.withColumnRenamed("id", "message_id")
    return {
        "logs": rewrite(spark, logs, lambda t: t.filter("message_id is not null").join(linked, "message_id", "left_semi"), lambda rows: integrity.cascade_set_null(rows, ids)),
        "messages": rewrite(spark, messages, lambda t: t.join(ids, "id", "left_semi"), lambda rows: integrity.without_deleted(rows, "id", ids)),
    }
