"""A beginning of a text settles its preview."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from callgauge.functions import redaction

PARTS = [
    "word", "Bearer", "Bearer\n", "abcdefghij0123", "sk-abcdefgh12", "token-", "4111 1111 1111 1111", "4111-1111-1111", "1111", "+49 170 123 4567",
    "0123456789", "a.b@c.de", "@", "mail", "x@y", ".org", "AIza0123456789ab", "é", "日本", "٤٤٤٤", "-", "(", " ", "end.", "Bearer\tzzzzzzzzzz",
]


def test_a_beginning_has_the_preview_of_every_longer_text(spark, monkeypatch):
    """Random texts, cut anywhere behind the beginning; small sizes, so that cuts are many."""
    monkeypatch.setattr(redaction, "BEGINNINGS", (60, 150))
    draw = random.Random(11)
    texts = ["".join(draw.choice(PARTS) + draw.choice([" ", " ", "", "\n", "  "]) for _ in range(draw.randint(0, 80))) for _ in range(1500)]
    rows = spark.createDataFrame([(k, t, draw.randint(0, max(1, len(t)))) for k, t in enumerate(texts)], "id int, text string, size int")
    limit = 30
    cut = F.substring("text", F.lit(1), F.col("size"))
    short = F.substring(redaction.preview_source("text", limit), F.lit(1), F.col("size"))
    met = rows.select("text", "size", redaction.preview(cut, limit).alias("want"), redaction.preview(short, limit).alias("got"), F.length(redaction.preview_source("text", limit)).alias("taken"))
    wrong = [r for r in met.collect() if r.want != r.got]
    assert wrong == []
    shortened = met.filter(F.col("taken") < F.length("text"))
    assert shortened.count() > 300 and shortened.filter("size > taken").count() > 50


def test_texts_without_a_border_are_taken_whole(spark):
    rows = spark.createDataFrame([("9" * 40_000,), ("a" * 40_000,), (None,), ("",)], "text string")
    assert [len(r[0]) if r[0] is not None else None for r in rows.select(redaction.preview_source("text")).collect()] == [40_000, 40_000, None, 0]
