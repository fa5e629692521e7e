"""Text quality by a sparse rule ensemble.

Shallow trees are grown on statistics of labelled texts; every path from a root becomes a
conjunctive rule; a logistic model with a lasso penalty weighs the rules and leaves few.
The rules that stay are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm import labels as labelling
from callgauge.llm import rows

#: Bound of the training sample, documents of a class.
SAMPLE_PER_CLASS = 3_000
TREES, DEPTH, CUTS, SEED = 40, 3, 24, 5
LASSO, ROUNDS = 0.0003, 400


def _class(chars: bytes | range) -> np.ndarray:
    mask = np.zeros(256, np.int64)
    mask[list(chars)] = 1
    return mask


UPPER, LOWER = _class(range(65, 91)), _class(range(97, 123))
CLASSES = {
    "upper": UPPER,
    "letter": UPPER + LOWER + _class(range(128, 256)),
    "digit": _class(range(48, 58)),
    "symbol": _class(b"#*$%&<>@^~_=+\\/{}[]"),
    "bar": _class(b"|"),
    "shout": _class(b"!?"),
    "stop": _class(b".,;:"),
    "space": _class(b" \t\n\x0b\x0c\r"),
}
TABLE = np.stack(list(CLASSES.values()), axis=1)
STATISTICS = (
    "log_words", "word_bytes", "upper_share", "letter_share", "digit_share", "symbol_share", "bar_share", "shout_per_word",
    "stop_per_word", "distinct_share", "repeat_share", "top_share", "dup_line_share", "log_line_words",
)


def statistics(raw: bytes | None) -> tuple[float, ...]:
    """STATISTICS of one text; all 0 without words."""
    split = raw.split() if raw else []
    if not split:
        return (0.0,) * len(STATISTICS)
    counts = dict(zip(CLASSES, (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ TABLE).tolist()))
    n, filled = len(split), len(raw) - counts["space"]
    times: dict[bytes, int] = {}
    for word in split:
        times[word] = times.get(word, 0) + 1
    repeats = sum(map(bytes.__eq__, split, split[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    share = {k: v / filled for k, v in counts.items()}
    return (
        float(np.log1p(n)), filled / n, counts["upper"] / max(1, counts["letter"]), share["letter"], share["digit"], share["symbol"], share["bar"], counts["shout"] / n,
        counts["stop"] / n, len(times) / n**0.8, repeats / n, max(times.values()) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
    )


def describe(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, a double for each of STATISTICS, and the columns to keep, of every whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            found = [statistics(raw) for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            columns = {k: pa.array([x[i] for x in found], pa.float64()) for i, k in enumerate(STATISTICS)}
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("doc_id", *keep)} | columns)

    picked = docs.select("doc_id", "text", *keep)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields if f.name != "text"]
    return picked.mapInArrow(work, ", ".join([*kept, *(f"{k} double" for k in STATISTICS)]))


#: (statistic, True for above or False for at most, threshold)
Condition = tuple[int, bool, float]


@dataclass
class Ensemble:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, above, value in rule:
                holds &= F.col(STATISTICS[k]) > value if above else F.col(STATISTICS[k]) <= value
            total += F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def text(self) -> list[str]:
        """The rules, the weightiest first."""
        said = [(w, " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {value:.4g}" for k, above, value in rule)) for rule, w in zip(self.rules, self.weights)]
        return [f"{w:+.3f} if {rule}" for w, rule in sorted(said, key=lambda x: -abs(x[0]))]


def _grow(x: np.ndarray, g: np.ndarray, own: np.ndarray, path: tuple[Condition, ...], depth: int, features: np.ndarray, least: int, out: list[tuple[Condition, ...]]) -> list[tuple[Condition, ...]]:
    """A least-squares tree on g; every path goes to out; returns the paths to its leaves."""
    best = (1e-9, 0, 0.0)
    if depth and len(own) >= 2 * least:
        for k in features:
            values = x[own, k]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1]))
            order = np.argsort(values, kind="stable")
            left = np.searchsorted(values[order], cuts, side="right")
            good = (left >= least) & (left <= len(own) - least)
            if good.any():
                sums, n = np.cumsum(g[own][order]), len(own)
                a = left[good]
                gain = sums[a - 1] ** 2 / a + (sums[-1] - sums[a - 1]) ** 2 / (n - a) - sums[-1] ** 2 / n
                top = int(gain.argmax())
                best = max(best, (float(gain[top]), int(k), float(cuts[good][top])))
    if best[0] <= 1e-9:
        return [path]
    _, k, value = best
    leaves = []
    for above in (False, True):
        side = own[(x[own, k] > value) == above]
        further = (*path, (k, above, value))
        out.append(further)
        leaves += _grow(x, g, side, further, depth - 1, features, least, out)
    return leaves


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    good = np.ones(len(x), dtype=bool)
    for k, above, value in rule:
        good &= (x[:, k] > value) == above
    return good


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = SEED) -> Ensemble:
    """Boosted trees give the rules, accelerated proximal gradient the lasso weights.

    weight is the weight of each row, so that a sample drawn by class counts as the whole.
    """
    weight = weight / max(weight.sum(), 1e-300)
    prior = float((weight * y).sum())
    if not len(y) or prior in (0.0, 1.0):
        return Ensemble([], [], 0.0 if not len(y) else (4.0 if prior else -4.0))
    draw, raised, found = np.random.default_rng(seed), np.zeros(len(y)), []
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-raised))
        own = np.sort(draw.choice(len(y), max(20, len(y) // 2), replace=len(y) < 40))
        features = draw.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        for rule in _grow(x, gradient, own, (), int(draw.integers(1, depth + 1)), features, max(2, len(own) // 100), found):
            holds = _holds(x, rule)  # over all rows, not only those the tree was grown on
            raised[holds] += 2.0 * float((gradient[holds] * weight[holds]).sum() / weight[holds].sum())
    by_rows: dict[bytes, tuple[Condition, ...]] = {}
    for rule in found:  # of rules that hold for the same rows, the shortest
        key = np.packbits(_holds(x, rule)).tobytes()
        if key not in by_rows or len(rule) < len(by_rows[key]):
            by_rows[key] = rule
    rules = list(by_rows.values())
    holds = np.stack([_holds(x, rule) for rule in rules], axis=1).astype(np.float64)
    coefficients, intercept = _lasso(holds, y, weight, lasso, np.log(prior / (1 - prior)))
    kept = np.flatnonzero(np.abs(coefficients) > 1e-6)
    return Ensemble([rules[k] for k in kept], coefficients[kept].tolist(), intercept)


def _lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, intercept: float) -> tuple[np.ndarray, float]:
    w = v = np.zeros(a.shape[1] + 1)
    w[-1] = intercept
    a = np.hstack([a, np.ones((len(a), 1))])
    step, t = 4 / np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2, 1.0
    v = w.copy()
    for _ in range(ROUNDS):
        error = weight * (1 / (1 + np.exp(-a @ v)) - y)
        new = v - step * (a.T @ error)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / later * (new - w)
        w, t = new, later
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: int = SAMPLE_PER_CLASS) -> Ensemble:
    """An ensemble from a bounded sample of the labelled documents for which learn holds.

    Only their statistics come to the driver. Without labelled documents every score is 0.5.
    """
    drawn = describe(labelling.labelled(docs, labels, target, learn, per_class), "y", "weight").orderBy("doc_id").collect()
    x = np.array([[r[k] for k in STATISTICS] for r in drawn]).reshape(len(drawn), len(STATISTICS))
    y = np.array([r["y"] for r in drawn], dtype=np.float64)
    return train(x, y, np.array([r["weight"] for r in drawn], dtype=np.float64))


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, score and the statistics of every whole text. Null and empty texts have
    statistics of 0 and are scored by them; repeated rows give a row each."""
    described = describe(rows.texts(docs))
    return described.select("doc_id", ensemble.column().alias("score"), *STATISTICS)
