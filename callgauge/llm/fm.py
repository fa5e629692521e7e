"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-case words of a text and the words' beginnings, hashed to slots. The
slots that go with the label in the sample are kept; each has a weight and a short vector,
and two slots in one text also count by the product of their vectors. So a pair of terms
can mean more, or less, than its parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame

from callgauge.llm import labels as labelling
from callgauge.llm import rows, words

SLOT_BITS = 20
#: Bytes of the beginnings of words that are terms.
BEGINNINGS = (3, 4, 5, 6)
#: Bound of the training sample, documents of a class; slots and factors of the machine.
SAMPLE_PER_CLASS, SLOTS, FACTORS = 2_500, 2_048, 8
#: A slot is kept if its chi-square statistic with the label reaches this.
LEAST_CHI = 15.0
EPOCHS, RATE, SHRINK, SEED = 200, 0.05, 1e-4, 3
#: Words whose slots a worker remembers before it starts anew.
REMEMBERED = 500_000


def slots_of(word: bytes) -> list[int]:
    terms = [b"=" + word] + [b"^" + word[:k] for k in BEGINNINGS if len(word) >= k]
    return [xxhash.xxh3_64_intdigest(term) >> (64 - SLOT_BITS) for term in terms]


@dataclass
class Machine:
    """number: slot to row of weights and vectors."""

    number: dict[int, int]
    weights: np.ndarray
    vectors: np.ndarray
    intercept: float
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def rows_of(self, word: bytes) -> tuple[int, ...]:
        found = tuple(k for slot in slots_of(word) if (k := self.number.get(slot)) is not None)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found

    def score(self, raw: bytes | None) -> float:
        present: set[int] = set()
        for word in set(words.split(raw)):
            found = self.known.get(word)
            if found is None:
                found = self.rows_of(word)
            if found:
                present.update(found)
        total = self.intercept
        if present:
            own = sorted(present)
            vectors = self.vectors[own]
            total += float(self.weights[own].sum()) + 0.5 * float((vectors.sum(axis=0) ** 2 - (vectors**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def select(texts: list[np.ndarray], y: np.ndarray, most: int = SLOTS) -> np.ndarray:
    """Slots by their chi-square statistic with the label, the highest first."""
    size = 1 << SLOT_BITS
    inside = [np.zeros(size), np.zeros(size)]
    for slots, label in zip(texts, y.astype(int).tolist()):
        inside[label][slots] += 1
    n0, n1 = float((y == 0).sum()), float((y == 1).sum())
    a, b = inside[1], inside[0]
    below = (a + b) * (n0 + n1 - a - b) * n0 * n1
    chi = np.where(below > 0, (n0 + n1) * (a * (n0 - b) - b * (n1 - a)) ** 2 / np.maximum(below, 1), 0)
    order = np.argsort(-chi, kind="stable")[:most]
    return order[chi[order] >= LEAST_CHI]


def train(texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Machine:
    """Adam over the whole sample on the logistic loss; texts are arrays of distinct slots."""
    total = max(float(weight.sum()), 1e-300)
    prior = float((weight * y).sum()) / total
    if not len(y) or prior in (0.0, 1.0):
        return Machine({}, np.zeros(0), np.zeros((0, FACTORS)), 0.0 if not len(y) else (4.0 if prior else -4.0))
    chosen = select(texts, y)
    number = {slot: k for k, slot in enumerate(chosen.tolist())}
    x = np.zeros((len(texts), len(chosen)), dtype=np.float32)
    lookup = np.full(1 << SLOT_BITS, -1)
    lookup[chosen] = np.arange(len(chosen))
    for i, slots in enumerate(texts):
        own = lookup[slots]
        x[i, own[own >= 0]] = 1
    draw = np.random.default_rng(seed)
    parts = {"w": np.zeros(len(chosen), np.float32), "v": draw.normal(0, 0.01, (len(chosen), FACTORS)).astype(np.float32), "c": np.full(1, np.log(prior / (1 - prior)), np.float32)}
    first, second = ({k: np.zeros_like(p) for k, p in parts.items()} for _ in range(2))
    share, y = (weight / total).astype(np.float32), y.astype(np.float32)
    for epoch in range(1, EPOCHS + 1):
        w, v = parts["w"], parts["v"]
        sums = x @ v
        out = parts["c"] + x @ w + 0.5 * ((sums**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        error = share * (1 / (1 + np.exp(-np.clip(out, -60, 60))) - y)
        back = x.T @ np.column_stack([error, error[:, None] * sums])
        grads = {"w": back[:, 0] + SHRINK * w, "v": back[:, 1:] - v * back[:, :1] + SHRINK * v, "c": error.sum(keepdims=True)}
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            parts[k] = (parts[k] - RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)).astype(np.float32)
    return Machine(number, parts["w"].astype(float), parts["v"].astype(float), float(parts["c"][0]))


def fit(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """A machine from a bounded sample of the labelled documents for which learn holds.

    Of each sampled text its distinct slots come to the driver. Without labelled documents
    every score is 0.5.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            found = []
            for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist():
                slots = {slot for word in set(words.split(raw)) for slot in slots_of(word)}
                found.append(np.array(sorted(slots), dtype="<u4").tobytes())
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("doc_id", "y", "weight")} | {"slots": pa.array(found, pa.binary())})

    drawn = labelling.labelled(docs, labels, target, learn, per_class).mapInArrow(work, "doc_id long, y int, weight double, slots binary")
    texts, y, weight = [], [], []
    for r in sorted(drawn.toLocalIterator(), key=lambda r: (r["doc_id"], bytes(r["slots"]))):
        texts.append(np.frombuffer(bytes(r["slots"]), dtype="<u4"))
        y.append(r["y"])
        weight.append(r["weight"])
    return train(texts, np.array(y, dtype=float), np.array(weight, dtype=float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every whole text. Null and empty texts have the intercept's score;
    repeated rows give a row each. Narrow: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            found = [sent.value.score(raw) for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(found, pa.float64())})

    return rows.texts(docs).mapInArrow(work, "doc_id long, score double")
