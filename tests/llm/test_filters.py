"""Quality rules, licences and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import pickle
import re
from collections import Counter

import pytest
from llm import cases

from callgauge.llm import cascade, licenses, suffixes

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lettered(text: str | None) -> list[str]:
    return LETTERED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def measured(text: str | None) -> tuple:
    text = text or ""
    words = SPACED.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


JUNK = [
    (20, " ".join(f"{w}###" for w in cases.prose(40, seed=8).split())),
    (21, cases.prose(40, seed=9).upper() + "!!"),
    (22, "\n".join([cases.prose(6, seed=10)] * 3 + [cases.prose(60, seed=11)])),
    (23, "\n".join(["one line"] * 12)),
    (24, "lado " * 50),
    (25, cases.prose(30, seed=12).replace(" ", " | ")),
]


def test_measures_and_verdicts(spark):
    docs = cases.clashing(spark).select("doc_id", "text").unionByName(spark.createDataFrame(JUNK, cases.SCHEMA))
    order = cascade.plan(docs, sample_rows=5)
    assert sorted(order) == sorted(cascade.RULES)
    found = cascade.measure(docs, order)
    texts = cases.ROWS + JUNK
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert cases.rows_of(found, *columns) == sorted([(d, *measured(t)) for d, t in texts], key=str)
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert kept == {1, 5, 7, None, 9}
    assert found.where("kept and (base_failed or rejected_by is not null)").count() == 0


def test_any_order_keeps_the_same(spark):
    docs = cases.clashing(spark)
    kept = cascade.keep(docs, list(cascade.RULES))
    assert kept.columns == docs.columns
    assert cases.rows_of(kept, "doc_id", "text") == cases.rows_of(cascade.keep(docs, list(cascade.RULES)[::-1]), "doc_id", "text")
    assert cascade.plan(cases.empty(spark)) == list(cascade.RULES)
    assert cascade.keep(cases.empty(spark), list(cascade.RULES)).count() == 0


def test_cheap_rejecting_rule_comes_first(spark):
    bad = spark.createDataFrame([(k, "x") for k in range(50)], cases.SCHEMA)
    assert cascade.plan(bad)[0] == "few_words"


def test_windows_of_many_different_words():
    words = [str(k) for k in range(9000)] + [str(k) for k in range(7)]
    assert cascade.Text(" ".join(words)).n_repeat_words == 14


LICENSED = [
    (30, "Released UNDER the MIT-License, under the mit license"),
    (31, "/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Foo-1.0 */"),
    (32, "cc by nc cc by nc by\nApache License, Version 2.0. undertheMIT license"),
    (33, "SPDX-License-Identifier: GPL-3.0-or-later WITH Classpath-exception-2.0\nx spdx-license-identifier: or"),
    (34, "All rights reserved. Licensed under the MIT license."),
    (35, "under the mit licensé under the mit"),
]


def test_base_phrases(spark):
    docs = cases.clashing(spark).select("doc_id", "text").unionByName(spark.createDataFrame(LICENSED, cases.SCHEMA))
    expected = []
    for doc_id, text in cases.ROWS + LICENSED:
        words = lettered(text)
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            own = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += at
            labels |= {label} if at else set()
        expected.append((doc_id, len(words), sorted(places), sorted(labels)))
    found = licenses.find(docs)
    assert cases.rows_of(found, "doc_id", "n_words", "places", "base_labels") == sorted(expected, key=str)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in found.collect()}
    assert labels[31] == (["foo-1.0", "gpl-2", "mit"], licenses.UNKNOWN)
    assert labels[33] == (["gpl-3"], pytest.approx(0.6))
    assert labels[34] == (["mit", "reserved"], 0.0)
    assert labels[2] == ([], 0.0)
    assert licenses.find(cases.empty(spark)).count() == 0


@pytest.mark.parametrize(
    ("expression", "labels", "score"),
    [
        ("MIT", {"mit"}, 1.0),
        ("mit or gpl-3.0 and cc-by-nc-4.0", {"mit", "gpl-3", "cc-by-nc"}, 1.0),
        ("(mit or gpl-3.0) and cc-by-nc-4.0", {"mit", "gpl-3", "cc-by-nc"}, 0.2),
        ("gpl-2.0 with x and mit", {"gpl-2", "mit"}, 0.6),
        ("mit and", {"mit"}, 1.0),
        ("((mit", {"mit"}, 1.0),
        ("mit) or gpl-2.0", {"mit"}, 1.0),
        ("mit gpl-2.0", {"mit"}, 1.0),
        ("mit or (", {"mit"}, 1.0),
    ],
)
def test_expressions(expression, labels, score):
    found = licenses.evaluate(expression)
    assert found[0] == labels and found[1] == pytest.approx(score)


@pytest.mark.parametrize("expression", ["", "and", ")", "(", "or mit"])
def test_no_licence_in_an_expression(expression):
    assert licenses.evaluate(expression) is None


def marked(docs, items, size=13):
    windows = {}
    for item, text in items:
        words = lettered(text)
        w = min(size, len(words))
        for i in range(len(words) - w + 1 if w else 0):
            windows.setdefault(tuple(words[i : i + w]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        words, hit, names = lettered(text), set(), set()
        for w in {len(k) for k in windows}:
            for i in range(len(words) - w + 1):
                if own := windows.get(tuple(words[i : i + w])):
                    hit.update(range(i, i + w))
                    names |= own
        out.append((doc_id, len(words), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def contaminated_rows():
    draw = random.Random(3)
    item = cases.prose(40, seed=50)
    rows = list(cases.ROWS)
    rows += [(40, item.upper()), (41, cases.prose(900, seed=51) + " " + " ".join(item.split()[3:17])), (42, " ".join(item.split()[:12]) + " x " + " ".join(item.split()[13:])), (43, "Kurz, satz!")]
    rows += [(100 + k, " ".join(draw.choice(["a", "b"]) for _ in range(draw.randint(0, 80)))) for k in range(40)]
    items = [(1, item), (2, "kurz satz"), (10, "a b a b a b a b a b a b a b a b"), (10, "b b b b b b b b b b b b b b"), (3, None), (4, "..."), (5, item), (6, "b a b")]
    return rows, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_windows_of_the_benchmark(spark, block_bytes):
    rows, items = contaminated_rows()
    docs, bench = spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = suffixes.find(docs, bench, block_bytes=block_bytes)
    got = found.select("doc_id", "n_words", suffixes.hits().alias("n_hit"), "items", suffixes.contaminated().alias("bad"))
    assert cases.rows_of(got, "doc_id", "n_words", "n_hit", "items", "bad") == marked(rows, items)
    wide = cases.clashing(spark)
    good = suffixes.remove(wide, bench, block_bytes=block_bytes)
    assert good.columns == wide.columns
    keep = Counter((d, n) for d, n, _, _, bad in marked(cases.ROWS, items) if not bad)
    assert Counter((r["doc_id"], len(lettered(r["text"]))) for r in good.collect()) == keep


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert suffixes.find(cases.empty(spark), bench).count() == 0
    assert {r["n_words"] for r in suffixes.find(cases.frame(spark), bench).where("size(spans) = 0").collect()} == {len(lettered(t)) for _, t in cases.ROWS}
    assert suffixes.remove(cases.frame(spark), bench).count() == len(cases.ROWS)


def test_longest_matches(spark):
    rows, items = contaminated_rows()
    docs, bench = spark.createDataFrame(rows, cases.SCHEMA), spark.createDataFrame(items[:1], "item_id long, text string")
    best = {r["item_word"]: (r["n_words"], r["doc_id"], r["doc_word"]) for r in suffixes.longest_matches(docs, bench).collect()}
    assert best[0] == (40, 40, 0) and best[5] == (35, 40, 5)


def test_query_digest(spark, tmp_path):
    from callgauge.llm.queries import QUERIES

    rows, items = contaminated_rows()
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = QUERIES["op3_suffix_arrays"](spark, str(tmp_path))
    expected = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bad) for d, n, h, i, bad in marked(rows, items)]
    assert cases.rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(expected, key=str)


def test_blocks_grow_with_the_items_words():
    """A suffix is not stored for each word, so a block's size is linear in its longest item."""
    sizes = [len(pickle.dumps(suffixes.Block([("long", cases.prose(n, seed=8).encode())], suffixes=True))) for n in (1000, 4000)]
    assert sizes[1] < 6 * sizes[0]
    block = suffixes.Block([("a", b"x y z " * 5), ("b", b"lado mira")], suffixes=True)
    assert [(item, start, len(key)) for item, start, key in block.suffixes(14)] == [("a", 0, 56), ("a", 1, 56), ("a", 2, 52), ("b", 0, 8)]


def test_repeated_benchmark_rows_are_loaded_once(spark):
    rows = [("same", cases.prose(30, seed=3))] * 50 + [("other", cases.prose(30, seed=5)), (None, None)]
    loaded = [r for load in suffixes.blocks(spark.createDataFrame(rows, "item_id string, text string"), 256) for r in load()]
    assert sorted(loaded, key=str) == sorted({(i or "", t and t.encode()) for i, t in rows}, key=str)
