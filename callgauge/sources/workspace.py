"""Folders for tables a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one the cluster names in spark.checkpoint.dir.

    Only a session without that setting (a test on one machine) gets a local one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not shared:
        shared = tempfile.mkdtemp(prefix="callgauge-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
