"""Language identification by a bidirectional gated recurrent network over bytes.

A text is lowered and cut into windows of bytes; two gated recurrent layers, one from each
side, read a window, and every byte gets a probability of each language. A document's
probabilities are the mean over its bytes of the log probabilities, normalised. The network
is small and is trained in numpy, by backpropagation through time, on a bounded sample of
windows; scoring takes every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm import rows

WINDOW, HIDDEN = 64, 8
#: Bound of the training sample: documents of a language, and characters taken of each.
SAMPLE_DOCS, SAMPLE_CHARS = 600, 320
STEPS, BATCH, RATE, SEED = 300, 128, 0.02, 11
#: Windows that a task reads side by side.
SIDE_BY_SIDE = 4096
UNKNOWN = "und"
PAD = 256


def windows(raw: bytes) -> np.ndarray:
    """Rows of WINDOW bytes; the last is filled up with PAD."""
    data = np.frombuffer(raw, np.uint8)
    out = np.full(-(-len(data) // WINDOW) * WINDOW, PAD, dtype=np.int16)
    out[: len(data)] = data
    return out.reshape(-1, WINDOW)


class Network:
    """Per direction: embedded input (257, 3H), recurrent weights (H, 3H); output (2H, L).

    Gates are z, r and the candidate n, in this order: h' = (1 - z) n + z h, with r on the
    recurrent part of n. Sigmoids are taken as tanh(x / 2).
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        small = lambda *shape: draw.normal(0, 0.3, shape).astype(np.float32)
        self.weights = {}
        for side in "fb":
            self.weights["x" + side] = small(PAD + 1, 3 * hidden)
            self.weights["h" + side] = small(hidden, 3 * hidden)
        self.weights["o"] = small(2 * hidden, len(languages))
        self.weights["c"] = np.zeros(len(languages), np.float32)

    def _run(self, inputs: np.ndarray, side: str, kept: list | None = None) -> np.ndarray:
        """States after each step, (steps, rows, H); inputs are (steps, rows)."""
        wx, wh, hidden = self.weights["x" + side], self.weights["h" + side], self.hidden
        state = np.zeros((inputs.shape[1], hidden), np.float32)
        out = np.empty((*inputs.shape, hidden), np.float32)
        for t in range(len(inputs)):
            a, b = wx[inputs[t]], state @ wh
            gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * hidden] + b[:, : 2 * hidden]))
            z, r = gates[:, :hidden], gates[:, hidden:]
            n = np.tanh(a[:, 2 * hidden :] + r * b[:, 2 * hidden :])
            if kept is not None:
                kept.append((inputs[t], state, z, r, n, b[:, 2 * hidden :]))
            state = n + z * (state - n)
            out[t] = state
        return out

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(rows, WINDOW) bytes to (WINDOW, rows, L)."""
        steps = np.ascontiguousarray(data.T)
        both = np.concatenate([self._run(steps, "f"), self._run(steps[::-1], "b")[::-1]], axis=2)
        logits = both @ self.weights["o"] + self.weights["c"]
        logits -= logits.max(axis=2, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))

    def gradients(self, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the bytes, and its gradients by backpropagation through time."""
        steps = np.ascontiguousarray(data.T)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(steps, "f", kept["f"]), self._run(steps[::-1], "b", kept["b"])[::-1]], axis=2)
        logits = both @ self.weights["o"] + self.weights["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        there = (steps != PAD).astype(np.float32)
        truth = np.eye(len(self.languages), dtype=np.float32)[labels][None]
        loss = -float((np.log((p * truth).sum(axis=2) + 1e-9) * there).sum() / there.sum())
        d = (p - truth) * (there / there.sum())[:, :, None]
        grads = {"o": np.einsum("tbh,tbl->hl", both, d, optimize=True), "c": d.sum(axis=(0, 1))}
        above = d @ self.weights["o"].T
        hidden = self.hidden
        for side, part in (("f", above[:, :, :hidden]), ("b", above[::-1, :, hidden:])):
            gx, gh = np.zeros_like(self.weights["x" + side]), np.zeros_like(self.weights["h" + side])
            carry = np.zeros_like(part[0])
            for t in range(len(part) - 1, -1, -1):
                inputs, state, z, r, n, b = kept[side][t]
                carry = carry + part[t]
                dn = carry * (1 - z) * (1 - n * n)
                dz = carry * (state - n) * z * (1 - z)
                dr = dn * b * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gx, inputs, da)
                gh += state.T @ db
                carry = carry * z + db @ self.weights["h" + side].T
            grads["x" + side], grads["h" + side] = gx, gh
        return loss, grads

    def train(self, data: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam with a falling rate; returns the losses. Each language is drawn equally often."""
        draw = np.random.default_rng(seed)
        own = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            kinds = draw.integers(0, len(own), batch)
            chosen = np.array([own[k][draw.integers(len(own[k]))] for k in kinds])
            loss, grads = self.gradients(data[chosen], labels[chosen])
            losses.append(loss)
            now = rate * (1 - (step - 1) / steps)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.weights[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return losses

    def documents(self, raws: list[bytes]) -> np.ndarray:
        """Probability of each language for each text, pooled over its bytes."""
        cut = [windows(raw) for raw in raws]
        owner = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
        data = np.concatenate([np.zeros((0, WINDOW), np.int16), *cut])
        pooled = np.zeros((len(raws), len(self.languages)))
        for k in range(0, len(data), SIDE_BY_SIDE):
            part = data[k : k + SIDE_BY_SIDE]
            logp = self.log_probabilities(part)
            logp *= (part.T != PAD)[:, :, None]
            np.add.at(pooled, owner[k : k + SIDE_BY_SIDE], logp.sum(axis=0))
        pooled /= np.array([max(1, len(raw)) for raw in raws])[:, None]
        pooled = np.exp(pooled - pooled.max(axis=1, keepdims=True))
        return pooled / pooled.sum(axis=1, keepdims=True)


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8")


def sample(docs: DataFrame, learn: Column, per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """lang and a passage of at most `chars` characters, of about per_language documents of
    each language among the rows to learn from.

    Documents are drawn by a hash of id and text, at a rate set by the language's row count,
    so no language's rows meet in one task; a repeated row counts once. Of more than twice
    per_language by chance those with the smallest hashes are taken. Every language with a
    text has its part, so the sample grows with the number of languages.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return []
    every = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(max(1, r["count"] // per_language)).cast("long"))])
    hashed = F.xxhash64("doc_id", "text")
    at = 1 + F.pmod(F.shiftright(hashed, 7), F.greatest(F.lit(1), F.length("text") - chars).cast("long"))
    drawn = known.where(F.pmod(hashed, every[F.col("lang")]) == 0)
    picked = drawn.select("lang", F.substring("text", at.cast("int"), F.lit(chars)).alias("text"), hashed.alias("h"))
    by: dict[str, list[tuple[int, str]]] = {}
    for r in picked.groupBy("lang", "h").agg(F.min("text").alias("text")).toLocalIterator():
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return [(lang, text) for lang in sorted(by) for _, text in sorted(by[lang])[: 2 * per_language]]


def fit(docs: DataFrame, learn: Column) -> Network | None:
    """A network from the rows of docs (doc_id, text, lang) where learn holds; None if there are none."""
    drawn = sample(docs, learn)
    if not drawn:
        return None
    languages = sorted({lang for lang, _ in drawn})
    number = {lang: k for k, lang in enumerate(languages)}
    cut = [(number[lang], windows(prepared(text))) for lang, text in drawn]
    network = Network(languages)
    network.train(np.concatenate([x for _, x in cut]), np.concatenate([np.full(len(x), k) for k, x in cut]))
    return network


def _predict(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """A text without a letter is unknown, with score 0."""
    raws = [prepared(text) if text and any(map(str.isalpha, text)) else b"" for text in texts]
    if network is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    p = network.documents(raws)
    best = p.argmax(axis=1)
    langs = [network.languages[k] if raw else UNKNOWN for k, raw in zip(best.tolist(), raws)]
    return langs, [float(p[i, k]) if raws[i] else 0.0 for i, k in enumerate(best.tolist())]


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text. Null texts and texts without a letter
    are `und` with score 0; without a network so is every text. Of languages with equal
    probability the first by name is told. Repeated rows give a row each, an empty table none;
    other columns are left out. Narrow: no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            langs, scores = _predict(sent.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})

    return rows.texts(docs).mapInArrow(work, "doc_id long, lang_pred string, score double")


def bar(languages: int) -> float:
    """The score at which the odds of a language are twice those of chance; 1 for a single one."""
    return 2 / (languages + 1)


def keep(docs: DataFrame, network: Network | None, wanted: list[str] | None = None, least: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, in a wanted language (by default any that the
    network knows) with a score of `least` or more (by default the `bar` of its languages).

    `und` goes: null texts and texts without a letter. Without a network no language can be
    told, so every text with a letter stays. Repeated rows are judged alike, each by itself.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)
    least = least if least is not None else bar(len(network.languages)) if network else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            texts = batch.column("text").to_pylist()
            if sent.value is None:
                good = [bool(text) and any(map(str.isalpha, text)) for text in texts]
            else:
                langs, scores = _predict(sent.value, texts)
                good = [lang != UNKNOWN and score >= least and (wanted is None or lang in wanted) for lang, score in zip(langs, scores)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def position_labels(network: Network, text: str) -> list[str]:
    """The language of every byte of one lowered text."""
    cut = windows(prepared(text))
    best = network.log_probabilities(cut).argmax(axis=2).T.reshape(-1)
    return [network.languages[k] for k in best[: len(prepared(text))].tolist()]
