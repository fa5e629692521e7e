"""Licence scan: notices and identifier tags by Aho-Corasick, tag expressions by shunting-yard.

One automaton runs over a text's words, joined by single spaces, and finds notice phrases at
word borders. It also finds the words of an identifier tag; in texts that have one, a second
automaton finds the tags themselves, and the expression after each is parsed: identifiers
with `and`, `or`, `with` and parentheses, where `with` binds closest and `or` least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from callgauge.llm import rows, words

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices.
NOTICE_PHRASES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd 2 clause": "bsd-2",
    "bsd 3 clause": "bsd-3",
    "cc by sa": "cc-by-sa",
    "cc0 1 0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG_PHRASE = "spdx license identifier"
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How identifiers in tags begin, and the label that stands for them.
IDENTIFIERS = {
    "mit": "mit", "apache-2": "apache-2", "cc-by-nc": "cc-by-nc", "gpl-2": "gpl-2", "gpl-3": "gpl-3", "lgpl": "lgpl", "agpl": "agpl",
    "mpl": "mpl", "bsd-2": "bsd-2", "bsd-3": "bsd-3", "cc-by-sa": "cc-by-sa", "cc0": "cc0", "unlicense": "public-domain",
}
#: How freely a text under a label may be used; a label that isn't here has UNKNOWN.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "bsd-2": 1.0, "bsd-3": 1.0, "cc0": 1.0, "public-domain": 1.0, "mpl": 0.7, "lgpl": 0.6,
    "cc-by-sa": 0.5, "gpl-2": 0.4, "gpl-3": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "reserved": 0.0,
}
UNKNOWN, EXCEPTION_BONUS = 0.1, 0.2
BINDING = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9.+\-]+")
#: What an expression may be made of; it ends with the line or the comment.
EXPRESSION = re.compile(r"[a-z0-9.+\-() \t]*")


def label_of(identifier: str) -> str:
    return next((label for start, label in IDENTIFIERS.items() if identifier == start or identifier.startswith((start + ".", start + "-", start + "+"))), identifier)


def postfix(expression: str) -> list[str]:
    """Shunting-yard. Stops where the expression does: at a second operand in a row, an
    operator without a left side, or a parenthesis that was never opened; a dangling
    operator at the end and parentheses left open are dropped."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    for token in TOKEN.findall(expression.lower()):
        if token in BINDING:
            if not operand:
                break
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        elif token == ")":
            if not operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif operand:
            break
        elif token == "(":
            held.append(token)
        else:
            out.append(token)
            operand = True
    if not operand:
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()  # the operator that has no right side
    return out + [token for token in reversed(held) if token != "("]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels in an expression and how freely it allows use: the best side of an or, the worst
    of an and, and an exception frees a little. None if there is no licence in it."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token not in BINDING:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
            continue
        if len(stack) < 2:
            return None
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, min(1.0, a + EXCEPTION_BONUS)))
        else:
            stack.append((left | right, max(a, b) if token == "or" else min(a, b)))
    return stack[-1] if stack else None


@cache
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    notices, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in [*BASE_PHRASES, *NOTICE_PHRASES, TAG_PHRASE, *(t.rstrip(":").replace("-", " ") for t in TAGS)]:
        notices.add_word(f" {phrase} ", phrase)
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    notices.make_automaton()
    tags.make_automaton()
    return notices, tags


def scan(raw: bytes | None) -> dict:
    """Words, base places (first word of each), labels of both kinds, tag expressions, score."""
    notices, tags = automata()
    split = words.split(raw)
    line = " " + b" ".join(split).decode("latin-1") + " "
    places, base, labels, scores, expressions, tagged, at, word = [], set(), set(), [], [], False, 0, 0
    for end, phrase in sorted((end - len(phrase) - 1, phrase) for end, phrase in notices.iter(line)):
        if phrase in BASE_PHRASES:
            word, at = word + line.count(" ", at, end), end
            places.append(word)
            base.add(BASE_PHRASES[phrase])
        elif phrase in NOTICE_PHRASES:
            labels.add(NOTICE_PHRASES[phrase])
        else:
            tagged = True
    scores += [FREEDOM[label] for label in base | labels]
    if tagged:
        lower = raw.decode("latin-1").translate(LOWER)
        for end, _ in tags.iter(lower):
            expression = EXPRESSION.match(lower, end + 1).group().strip()
            if found := evaluate(expression):
                expressions.append(expression)
                labels |= found[0]
                scores.append(found[1])
    return {
        "n_words": len(split),
        "places": places,
        "base_labels": sorted(base),
        "labels": sorted(base | labels),
        "expressions": expressions,
        "score": min(scores, default=0.0),
    }


LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (start words of the base phrases), base_labels, labels,
    expressions, and score, of every whole text.

    score says how freely all notices and tags together allow use: the least of them, and 0
    where there is none. Null and empty texts have no words and no labels; repeated rows
    give a row each. Narrow: no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            found = [scan(raw) for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            kinds = {"n_words": pa.int64(), "places": pa.list_(pa.int64()), "score": pa.float64()}
            columns = {k: pa.array([x[k] for x in found], kinds.get(k, pa.list_(pa.string()))) for k in ("n_words", "places", "base_labels", "labels", "expressions", "score")}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns)

    schema = "doc_id long, n_words long, places array<long>, base_labels array<string>, labels array<string>, expressions array<string>, score double"
    return rows.texts(docs).mapInArrow(work, schema)
