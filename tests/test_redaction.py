from __future__ import annotations

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callgauge.functions import redaction as R

CASES = [
    # Mail addresses: accents count as letters, a dash or dot at an end is left over.
    ("write lena_k@post.example or ask at the desk", "write [REDACTED:email] or ask at the desk"),
    ("<o+tag@q.w.e>;<r@t.z>", "<[REDACTED:email]>;<[REDACTED:email]>"),
    ("größe@haus.test", "[REDACTED:email]"),
    ("m@n.o-", "[REDACTED:email]-"),
    ("m@n.--", "m@n.--"),
    ("--m@n.o", "--[REDACTED:email]"),
    ("m@n.o-@p.q", "[REDACTED:email][REDACTED:email]"),
    ("no.domain@here", "no.domain@here"),
    # Cards: 13 to 19 digits, apart by one space or dash, which the last one takes along.
    ("paid by 5500 0000 0000 0004, thanks", "paid by [REDACTED:card], thanks"),
    ("3400-000000-00009", "[REDACTED:card]"),
    ("6011000000000004", "[REDACTED:card]"),
    ("5500 0000 0000 0004 ok", "[REDACTED:card]ok"),
    ("98765432109 87", "[REDACTED:card]"),
    ("98765432109876543210", "98765432109876543210"),
    ("98765432109 or 987654321098", "98765432109 or 987654321098"),
    # Secrets: a known start, a dash, and eight characters more.
    ("set pk-QQ77_rr88-ss to rotate", "set [REDACTED:secret] to rotate"),
    ("token-short, xoxp-11112222", "token-short, [REDACTED:secret]"),
    ("key-generation", "[REDACTED:secret]"),
    ("Authorization=Bearer  QQ77.rr88_ss-tt", "Authorization=[REDACTED:secret]"),
    ("bearer QQ77rr88sstt", "bearer QQ77rr88sstt"),
    ("geo AIzaQQ_77-rr88ss.", "geo [REDACTED:secret]."),
    # Phone numbers: a plus and a country code, or ten digits of any script.
    ("ring +358 9 5550 1234 now", "ring [REDACTED:phone] now"),
    ("9876543210", "[REDACTED:phone]"),
    ("९८७६५४३२१०", "[REDACTED:phone]"),
    ("98765432109.", "98765432109."),
    ("room 12, 7 of 9 boxes", "room 12, 7 of 9 boxes"),
    ("", ""),
    (None, None),
]


def column(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, s STRING")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_cases(spark):
    got = column(spark, [a for a, _ in CASES], R.redact("s"))
    assert got == [b for _, b in CASES]


def test_preview_redacts_then_caps(spark):
    """A secret that the cap would cut in two is gone before the cap is applied."""
    (out,) = column(spark, ["w" * 40 + " pk-" + "Q" * 60], R.preview("s", 50))
    assert out == ("w" * 40 + " [REDACTED:secret]")[:50]
    (out,) = column(spark, ["pk-" + "Q" * 90 + " stays"], R.preview("s", 50))
    assert out == "[REDACTED:secret] stays"


def test_caps_count_characters(spark):
    text = "ŝĝ\U0001f427x"
    assert column(spark, [text * 300], R.preview("s", 500)) == [(text * 300)[:500]]
    assert column(spark, [text], R.truncate("s", 3)) == [text[:3]]


#: Fixed: the rules as they stand, as a yardstick.
PLAIN = [
    (r"\b(?:\d[ -]?){13,19}\b", "[REDACTED:card]"),
    (r"\b[\w.+%-]+@[\w-]+(?:\.[\w-]+)+\b", "[REDACTED:email]"),
    (r"\b(?:sk|pk|api|key|token|xox[baprs])-[A-Za-z0-9_\-]{8,}\b", "[REDACTED:secret]"),
    (r"\bBearer\s+[A-Za-z0-9._\-]{10,}\b", "[REDACTED:secret]"),
    (r"\bAIza[0-9A-Za-z_\-]{10,}\b", "[REDACTED:secret]"),
    (r"\+\d{1,3}[\d .\-()]{8,16}\d|\b\d{10}\b", "[REDACTED:phone]"),
]


def plainly(text: str) -> str:
    for pattern, tag in PLAIN:
        text = re.sub(pattern, tag, text)
    return text


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rules_on_random_text(spark, seed):
    rng = random.Random(seed)
    atoms = list("ab1-.@+_% é,()") + ["@a.", "1234", " 56", "sk-", "Bearer ", "AIza", "key-", "xy.z", "+44 "]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 25))) for _ in range(40_000)]
    got = column(spark, texts, R.redact("s"))
    assert [t for t, g in zip(texts, got, strict=True) if g != plainly(t)] == []
    assert sum(g != t for t, g in zip(texts, got, strict=True)) > 4000


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="a1@.-+%_ é", max_size=30), min_size=50, max_size=200))
def test_email_rule_equals_plain_rule(spark, texts):
    got = column(spark, texts, F.regexp_replace("s", R.EMAIL, "$1" + R.EMAIL_TAG))
    assert got == [re.sub(PLAIN[1][0], R.EMAIL_TAG, t) for t in texts]


def test_long_texts_take_linear_time(spark):
    texts = ["a@" + "b." * 100_000 + "c", "a." * 200_000 + " x@y.zz", "a@" * 200_000, "1 " * 200_000, "sk-" + "-" * 200_000]
    start = time.time()
    out = column(spark, texts, R.redact("s"))
    assert out[0] == "[REDACTED:email]" and out[1].endswith(" [REDACTED:email]")
    assert time.time() - start < 20
