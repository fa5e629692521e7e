from __future__ import annotations

import os
import time

from callgauge.llm import ctw
from callgauge.llm.components import CLEANUP, stored


def shuffle_files(folder):
    return sum(name.startswith("shuffle_") for _, _, names in os.walk(folder) for name in names)


def test_stored_tables_leave_no_shuffle_files(spark):
    folder = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp")
    own = [os.path.join(folder, x) for x in os.listdir(folder) if x.startswith(("blockmgr", "spark-"))]
    before = spark.conf.get(CLEANUP), sum(map(shuffle_files, own))
    found = stored(spark.range(5000).selectExpr("id % 500 as k").groupBy("k").count(), "cleanup")
    for _ in range(50):  # files go in the background
        if sum(map(shuffle_files, own)) <= before[1]:
            break
        time.sleep(0.1)
    assert (spark.conf.get(CLEANUP), sum(map(shuffle_files, own))) <= before
    assert found.count() == 500


def test_sent_grams_are_bounded():
    assert 1 / ctw.GRAM_SHARE * 16 <= 64 << 20
