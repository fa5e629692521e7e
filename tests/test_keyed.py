"""Tables that refuse repeated ids."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from callgauge.plans.inputs import AS_OF
from callgauge.sources import keyed

SCHEMA = "id string, conversation_id long, role string, content string"


def outcomes(spark, path):
    return Counter((r.batch_id, r.id, r.content, r.reason, r.copies) for r in keyed.message_outcomes(spark, path).collect())


def test_repeated_ids_are_refused(spark, tmp_path):
    path, owners = str(tmp_path), spark.createDataFrame([(1,), (2,)], "id long")

    def send(batch, *rows):
        keyed.store_messages(spark.createDataFrame(list(rows), SCHEMA), owners, path, batch, AS_OF)

    send(0, ("a", 1, "user", "x"), ("a", 1, "user", "y"), ("b", 1, "user", "z"), ("b", 1, "user", "z"), ("b", 1, "user", "z"), ("c", 9, "user", "no owner"))
    first = {(0, "a", "x", None, 1): 1, (0, "a", "y", "id repeated", 1): 1, (0, "b", "z", None, 1): 1, (0, "b", "z", "id repeated", 2): 1, (0, "c", "no owner", "conversation not found", 1): 1}
    assert outcomes(spark, path) == first
    for _ in range(2):  # a batch that is run again replaces itself
        send(1, ("a", 2, "user", "late"), ("c", 2, "user", "free"), ("d", 1, "cook", "v"), ("d", 1, "user", None))
        second = {(1, "a", "late", "id taken", 1): 1, (1, "c", "free", None, 1): 1, (1, "d", "v", "role not allowed", 1): 1, (1, "d", None, "content is null", 1): 1}
        assert outcomes(spark, path) == first | second
    assert sorted(r.id for r in keyed.stored_messages(spark, path).collect()) == ["a", "b", "c"]


def test_rows_without_id_get_one_each(spark, tmp_path):
    path, owners = str(tmp_path), spark.createDataFrame([(1, 5)], "id long, session_id long")
    rows = spark.createDataFrame([(None, 1, "user", "same", 5), (None, 1, "user", "same", 5), (None, 1, "user", "other's", 6)], SCHEMA + ", session_id long")
    keyed.store_messages(rows, owners, path, 0, AS_OF)
    stored = keyed.stored_messages(spark, path)
    assert stored.select("id").distinct().count() == stored.count() == 2 and stored.filter("id is null").count() == 0
    assert [r.reason for r in keyed.message_outcomes(spark, path).filter("outcome = 'refused'").collect()] == ["conversation not found"]


def test_a_batch_reads_the_folders_of_its_ids(spark, tmp_path):
    path, owners = str(tmp_path), spark.createDataFrame([(1,)], "id long")
    many = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("conversation_id"), F.lit("user").alias("role"), F.lit("t").alias("content"))
    keyed.store_messages(many, owners, path, 0, AS_OF)
    found = keyed.known_ids(spark, f"{path}/ids", spark.createDataFrame([("7",), ("x",)], "id string"), 1)
    assert [r.id for r in found.collect()] == ["7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan[plan.index("PartitionFilters") :]
    assert len(found.inputFiles()) <= keyed.BUCKETS


def test_conversations_need_a_session(spark, tmp_path):
    keyed.store_conversations(spark.createDataFrame([("s",), (None,)], "session_id string"), str(tmp_path), 0, AS_OF)
    assert Counter((r.session_id, r.reason, r.outcome) for r in spark.read.parquet(str(tmp_path)).collect()) == {("s", None, "stored"): 1, (None, "session_id is null", "refused"): 1}
