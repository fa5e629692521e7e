"""Documents for the edge cases that every operator has to take."""

from __future__ import annotations

import random

LANGS = {"aa": ["lado", "mira", "tosen", "vel", "quira"], "bb": ["schten", "krüg", "wolt", "ßamer", "düng"]}


def prose(words: int, lang: str = "aa", seed: int = 1) -> str:
    """Made-up words of one language; few repeat."""
    draw = random.Random(seed)
    return " ".join(draw.choice(LANGS[lang]) + draw.choice(LANGS[lang]) + draw.choice(LANGS[lang]) for _ in range(words))


ROWS = [
    (1, prose(60, seed=1)),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, prose(30_000, seed=2)),
    (6, "wort"),
    (7, prose(40, "bb", seed=3)),
    (7, prose(40, "bb", seed=3)),  # a row twice
    (7, prose(25, "aa", seed=4)),  # an id with two texts
    (None, prose(50, seed=5)),
    (8, "日本語のテキスト 123 \U0001f600 end"),
    (9, prose(60, seed=1)),  # a copy
]
SCHEMA = "doc_id long, text string"


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(spark):
    """The same with columns that operators use names of for themselves."""
    from pyspark.sql import functions as F

    names = ("score", "node", "row", "n_words", "spans", "items", "kept", "y", "weight", "ids", "lang", "source", "_size", "word_bytes")
    return frame(spark).withColumns({name: F.lit("x") for name in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(found, *columns):
    """Rows in an order of their own, to compare."""
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
