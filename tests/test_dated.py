"""Log tables by date: what is listed, what a compaction changes, and what readers see."""

from __future__ import annotations

from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from callgauge.sources import dated

SCHEMA = "id long, conversation_id long, outcome string, log_date date"


def batch(spark, batch_id, days=(1, 2, 3), refused=True):
    kinds = ("stored", "refused") if refused else ("stored",)
    rows = [(batch_id * 100 + d, d, kind, date(2024, 6, d)) for d in days for kind in kinds]
    return spark.createDataFrame(rows, SCHEMA)


def filled(spark, path, batches=6):
    for k in range(batches):
        dated.write(batch(spark, k), path, k)


def seen(frame):
    return Counter((r.id, r.outcome, r.log_date, r.batch_id) for r in frame.collect())


def test_a_day_lists_that_day_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    filled(spark, path, 3)
    one = dated.read(spark, path, "stored", date(2024, 6, 2), date(2024, 6, 2))
    assert seen(one) == Counter((k * 100 + 2, "stored", date(2024, 6, 2), k) for k in range(3))
    assert all("outcome=stored/log_date=2024-06-02/" in file for file in one.inputFiles())
    assert dated.read(spark, path, since=date(2025, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        dated.read(spark, str(tmp_path / "nothing"))


def test_compaction_keeps_rows_and_bounds_files(spark, tmp_path):
    path = str(tmp_path / "t")
    filled(spark, path)
    before = seen(dated.read(spark, path))
    reader = dated.read(spark, path)
    assert dated.compact(spark, path, least=7) == [] and dated.packed_days(spark, path) == {}
    assert len(dated.compact(spark, path, least=2)) == 6
    after = dated.read(spark, path)
    assert seen(after) == before == seen(reader)  # an older reader still finds its files
    for day in dated.days(spark, path):
        files = [f for f in after.inputFiles() if f"outcome={day[0]}/log_date={day[1]}/" in f]
        assert len(files) == 2  # the pack and the newest batch
    # Later batches join the pack; a day without new ones keeps its own.
    for k in (6, 7, 8):
        dated.write(batch(spark, k, days=(3,)), path, k)
        before += seen(batch(spark, k, days=(3,)).withColumn("batch_id", F.lit(k)))
    assert dated.compact(spark, path, least=2) == [("refused", "2024-06-03"), ("stored", "2024-06-03")]
    assert seen(dated.read(spark, path)) == before
    assert {p.pack for day, p in dated.packed_days(spark, path).items() if day[1] == "2024-06-03"} == {1}
    assert dated.compact(spark, path, least=2) == [] and seen(dated.read(spark, path)) == before
    assert not list((tmp_path / "t").glob("packs/pack=0/*/log_date=2024-06-03"))


def test_a_compaction_without_its_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    filled(spark, path, 4)
    before = seen(dated.read(spark, path))
    dated.compact(spark, path, least=2)
    (tmp_path / "t" / "commits" / "commit=0" / "_SUCCESS").unlink()
    assert dated.packed_days(spark, path) == {} and seen(dated.read(spark, path)) == before
    assert len(dated.compact(spark, path, least=2)) == 6 and seen(dated.read(spark, path)) == before


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    filled(spark, path, 2)
    # The second try of batch 1 comes after midnight and refuses nothing.
    dated.forget(spark, path, 1)
    dated.write(batch(spark, 1, days=(4,), refused=False), path, 1)
    want = seen(batch(spark, 0).withColumn("batch_id", F.lit(0))) + Counter([(104, "stored", date(2024, 6, 4), 1)])
    assert seen(dated.read(spark, path)) == want
    dated.write(batch(spark, 1, days=(4,), refused=False), path, 1)
    assert seen(dated.read(spark, path)) == want


def test_an_empty_batch_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    filled(spark, path, 1)
    dated.write(batch(spark, 1).limit(0), path, 1)
    assert dated.read(spark, path).count() == 6
