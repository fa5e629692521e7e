"""Log rows in folders by outcome and date, with a folder per batch below, and their compaction.

    rows/outcome=stored/log_date=2024-06-01/batch_id=17      what a batch wrote
    packs/pack=3/outcome=stored/log_date=2024-06-01          batches put together
    commits/commit=3                                         (outcome, log_date, pack, through)

A reader of some days lists these days alone. Of a packed day it takes the pack, and of the
batches only those after ``through``. A pack is seen once its commit is finished, as a whole.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.sources.rewritten import finished_commits
from callgauge.sources.sinks import laid_out

#: Folders of batches that a day has, at least, to be packed.
LEAST_BATCHES = 32
COMMIT = "outcome STRING, log_date STRING, pack BIGINT, through BIGINT"
#: A day of one outcome, as its folders spell it.
Day = tuple[str, str]


class Packed(NamedTuple):
    """Where the rows of a day up to a batch lie."""

    pack: int
    through: int


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match a pattern of paths; none if there is nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [s.getPath().toString() for s in listed or [] if s.isDirectory()]


def _remove(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _values(folder: str) -> dict[str, str]:
    return dict(part.split("=", 1) for part in folder.split("/") if "=" in part)


def _day(folder: str) -> Day:
    values = _values(folder)
    return values["outcome"], values["log_date"]


def packed_days(spark: SparkSession, path: str) -> dict[Day, Packed]:
    """The last finished commit; a row for each packed day."""
    commits = finished_commits(spark, path)
    if not commits:
        return {}
    rows = spark.read.schema(COMMIT).parquet(f"{path}/commits/commit={commits[-1]}").collect()
    return {(r["outcome"], r["log_date"]): Packed(r["pack"], r["through"]) for r in rows}


def forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove what an earlier try of a batch wrote, under whatever day that was."""
    _remove(spark, _found(spark, f"{path}/rows/outcome=*/log_date=*/batch_id={batch_id}"))


def write(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows (with outcome and log_date) of a batch; a repeated batch replaces its
    folders of the same days. `forget` removes those of other days."""
    stamped = laid_out(rows, "outcome", "log_date").withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("outcome", "log_date", "batch_id").parquet(f"{path}/rows")


def _batches(spark: SparkSession, path: str, day: Day) -> dict[int, str]:
    outcome, log_date = day
    found = _found(spark, f"{path}/rows/outcome={outcome}/log_date={log_date}/batch_id=*")
    return {int(_values(folder)["batch_id"]): folder for folder in found}


def _read(spark: SparkSession, path: str, batches: list[str], packs: list[str]) -> DataFrame:
    """Rows of folders of batches and of packs; at least one is needed."""
    parts = []
    if batches:
        parts.append(spark.read.option("basePath", f"{path}/rows").parquet(*batches))
    if packs:
        parts.append(spark.read.option("basePath", f"{path}/packs").parquet(*packs).drop("pack"))
    typed = [p.withColumns({"log_date": F.col("log_date").cast("date"), "batch_id": F.col("batch_id").cast("bigint")}) for p in parts]
    return reduce(DataFrame.unionByName, typed)


def days(spark: SparkSession, path: str, outcome: str = "*", since: date | None = None, until: date | None = None) -> list[Day]:
    """Days that have rows, between two dates (both included); lists the date folders alone."""
    found = {_day(folder) for folder in _found(spark, f"{path}/rows/outcome={outcome}/log_date=*")}
    packed = {day for day in packed_days(spark, path) if outcome in ("*", day[0])}
    low, high = (since.isoformat() if since else ""), (until.isoformat() if until else "~")
    return sorted(day for day in found | packed if low <= day[1] <= high)


def read(spark: SparkSession, path: str, outcome: str = "*", since: date | None = None, until: date | None = None) -> DataFrame:
    """The rows of some days, with outcome, log_date and batch_id; by default all rows.

    Folders of other days are not listed. Without such days the table is empty, with its
    columns if it has any day at all; a table without a day raises ValueError.
    """
    packed, plain, packs = packed_days(spark, path), [], []
    wanted = days(spark, path, outcome, since, until)
    if not wanted:
        every = days(spark, path)
        if not every:
            raise ValueError(f"{path} holds no rows")
        return read(spark, path, every[0][0], date.fromisoformat(every[0][1]), date.fromisoformat(every[0][1])).limit(0)
    for day in wanted:
        if day not in packed:
            plain.append(f"{path}/rows/outcome={day[0]}/log_date={day[1]}")
            continue
        pack, through = packed[day]
        packs.append(f"{path}/packs/pack={pack}/outcome={day[0]}/log_date={day[1]}")
        plain += [folder for batch, folder in _batches(spark, path, day).items() if batch > through]
    return _read(spark, path, plain, packs)


def compact(spark: SparkSession, path: str, least: int = LEAST_BATCHES, through: int | None = None) -> list[Day]:
    """Put the batches of every day that has ``least`` of them or more into few files; the days packed.

    Batches up to ``through`` are taken, by default all but the newest, which may be written
    again. The stream may go on meanwhile; two compactions may not run at once. What the
    compaction before has replaced is removed first, so a reader keeps its files for one
    compaction.
    """
    before = packed_days(spark, path)
    _sweep(spark, path, before)
    present = {day: _batches(spark, path, day) for day in days(spark, path)}
    if through is None:
        through = max((batch for batches in present.values() for batch in batches), default=0) - 1
    due = {day: [folder for batch, folder in batches.items() if batch <= through] for day, batches in present.items()}
    due = {day: folders for day, folders in due.items() if len(folders) >= least}
    if not due:
        return []
    old = [f"{path}/packs/pack={before[day].pack}/outcome={day[0]}/log_date={day[1]}" for day in due if day in before]
    rows = _read(spark, path, [folder for folders in due.values() for folder in folders], old)
    number = max(finished_commits(spark, path), default=-1) + 1
    laid_out(rows, "outcome", "log_date").write.mode("overwrite").partitionBy("outcome", "log_date").parquet(f"{path}/packs/pack={number}")
    after = before | {day: Packed(number, through) for day in due}
    table = spark.createDataFrame([(*day, *packed) for day, packed in after.items()], COMMIT)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={number}")
    return sorted(due)


def _sweep(spark: SparkSession, path: str, packed: dict[Day, Packed]) -> None:
    """Remove the batches and packs that the last finished commit has replaced."""
    gone = [folder for day, (_, through) in packed.items() for batch, folder in _batches(spark, path, day).items() if batch <= through]
    named = {(str(pack), *day) for day, (pack, _) in packed.items()}
    for folder in _found(spark, f"{path}/packs/pack=*/outcome=*/log_date=*"):
        if (_values(folder)["pack"], *_day(folder)) not in named:
            gone.append(folder)
    _remove(spark, gone)
