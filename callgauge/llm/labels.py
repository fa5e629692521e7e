"""A bounded sample of labelled texts for classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm import rows


def labelled(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int) -> DataFrame:
    """doc_id, text, y (0 or 1) and weight of about per_class documents of each class,
    4 * per_class documents at most. weight is how many labelled documents a row stands for.

    Only rows where learn holds (a condition on doc_id) are taken. Labels that are null, or
    that contradict each other for one doc_id, are left out. Rows are drawn by a hash of
    doc_id, at a rate set by the size of the class. Of several rows of one doc_id the text
    with the smallest hash stands for all.
    """
    known = labels.where(F.col(target).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    one = known.where(learn).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most and y in (0, 1)").drop("most")
    counts = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    every = F.when(F.col("y") == 1, max(1, counts.get(1, 0) // per_class)).otherwise(max(1, counts.get(0, 0) // per_class))
    drawn = one.withColumn("weight", every.cast("double")).where(F.pmod(F.xxhash64("doc_id"), every.cast("long")) == 0).limit(4 * per_class)
    # The limit bounds what is broadcast: 4 * per_class rows of three numbers.
    met = rows.texts(docs).join(F.broadcast(drawn), "doc_id")
    return met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"), F.first("weight").alias("weight"))
