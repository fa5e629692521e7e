"""Quality rules as a short-circuit cascade.

Each rule is timed on a sample and its rejections there are noted. The order is greedy:
always the rule that rejects most of what is left per second comes next, so most bad texts
meet a cheap rule first and the dear ones see little more than good texts. The order
changes what a text costs and which rule is named, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm import rows

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower() + bytes(range(0x80, 0x100))
WINDOW = 5
#: Documents that costs and selectivities are estimated on, at most.
SAMPLE_ROWS = 2_000


class Text:
    """Measures of one text, each taken when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes split at ASCII white space only

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_letters(self) -> int:
        """Bytes of letters; any byte beyond ASCII counts as one."""
        return len(self.raw) - len(self.raw.translate(None, LETTERS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of five words that the text has twice or more."""
        n = len(self.words) - WINDOW + 1
        if n < 2:
            return 0
        number = {word: k for k, word in enumerate(set(self.words))}
        one = np.array(list(map(number.__getitem__, self.words)), dtype=np.int64)
        key, most = one[:n], len(number)
        for k in range(1, WINDOW):
            if most * len(number) >= 1 << 62:
                found, key = np.unique(key, return_inverse=True)
                most = len(found)
            key, most = key * len(number) + one[k : n + k], most * len(number)
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[which] > 1
        if not again.any():
            return 0
        covered = np.zeros(len(one) + 1, dtype=np.int64)
        covered[:n] += again
        covered[WINDOW : n + WINDOW] -= again
        return int((np.cumsum(covered) > 0).sum())


Rule = Callable[[Text], bool]

#: True rejects. The first two are the base; the others look for kinds of junk.
RULES: dict[str, Rule] = {
    "few_words": lambda t: len(t.words) < 10,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 20 * len(t.words),
    "symbols": lambda t: 100 * t.n_symbols > 10 * t.word_chars,
    "shouting": lambda t: 10 * t.n_upper > 6 * t.n_letters,
    "few_letters": lambda t: 10 * t.n_letters < 4 * len(b"".join(t.words)),
    "bars": lambda t: 100 * t.words.count(b"|") > 15 * len(t.words),
    "repeated_lines": lambda t: 10 * t.n_dup_lines > 6 * len(t.lines),
    "one_word": lambda t: len(t.words) >= 20 and 20 * len(set(t.words)) < len(t.words) ** 0.75,
}
BASE = ("few_words", "repeated_windows")


def first_rejection(text: Text, order: list[str]) -> str | None:
    return next((name for name in order if RULES[name](text)), None)


def _trial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seconds and verdict of each rule on each text, every rule on a text of its own."""
    for batch in rows.slices(batches):
        for text in batch.column("text").to_pylist():
            seconds, rejects = [], []
            for rule in RULES.values():
                fresh, began = Text(text), time.perf_counter()
                rejects.append(bool(rule(fresh)))
                seconds.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_pydict({"seconds": pa.array([seconds], pa.list_(pa.float64())), "rejects": pa.array([rejects], pa.list_(pa.bool_()))})


def plan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Order of the rules, from a sample of at most sample_rows documents.

    The sample is drawn by a hash of doc_id, so that it is spread over the table. Only
    times and verdicts of the sampled texts reach the driver. Without rows the order is
    that of RULES.
    """
    names, total = list(RULES), docs.count()
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // sample_rows)))
    tried = rows.texts(docs).where(hashed == 0).limit(sample_rows).mapInArrow(_trial, "seconds array<double>, rejects array<boolean>").collect()
    if not tried:
        return names
    cost = np.array([r["seconds"] for r in tried]).mean(axis=0) + 1e-9
    rejects = np.array([r["rejects"] for r in tried])
    left, order = np.ones(len(tried), dtype=bool), []
    while len(order) < len(names):
        rate = rejects[left].mean(axis=0) if left.any() else np.zeros(len(names))
        # Ties, such as rules that reject nothing, go by cost.
        best = min((k for k in range(len(names)) if names[k] not in order), key=lambda k: (-rate[k] / cost[k], cost[k]))
        order.append(names[best])
        left &= ~rejects[:, best]
    return order


def keep(docs: DataFrame, order: list[str]) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns.

    Null and empty texts have no words and go. Equal texts get equal verdicts. A row's
    rules stop at the first rejection. Narrow: no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            good = [first_rejection(Text(text), order) is None for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def measure(docs: DataFrame, order: list[str]) -> DataFrame:
    """A row per document: doc_id, the base measures, base_failed, kept, and rejected_by.

    Null texts have no words. rejected_by is the first rule in order that rejects, else null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            found: dict[str, list] = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")}
            for value in batch.column("text").to_pylist():
                text = Text(value)
                by = first_rejection(text, order)
                found["rejected_by"].append(by)
                found["n_words"].append(len(text.words))
                for name in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                    found[name].append(getattr(text, name))
                failed = any(RULES[name](text) for name in BASE)
                found["base_failed"].append(failed)
                found["kept"].append(by is None)
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "rejected_by": pa.string()}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items()})

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return rows.texts(docs).mapInArrow(work, schema)
