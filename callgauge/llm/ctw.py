"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions in a tree of 255 nodes. For every node there is a tree
of contexts, the bytes before: a context of depth d mixes its own Krichevsky-Trofimov
estimate with what its longer contexts say, by weights that the training texts set, and so
all depths up to DEPTH take part. Every context that the training texts have is in the tree,
which grows with them: it is a table, and estimates and weights are aggregations, depth by
depth. Bytes to tell after contexts that only other texts have are in it with counts of
zero, which change no estimate. weigh() does the same in memory, for few texts.

Text is lowered in A-Z; 0xFF, which UTF-8 never has, stands before and after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm import rows
from callgauge.llm.components import stored

DEPTH = 5
#: A word of this share of the training tokens is sent to the tasks, so at most 2**20 are.
WORD_SHARE = 2.0**-20
#: What a gram of this share of all bytes is told with is sent to the tasks; at most 2**22 are, 64 MB.
GRAM_SHARE = 2.0**-22
EDGE = 0xFF
#: OTHER are the grams of texts that teach nothing.
DOCS, WORD, GRAM, OTHER = 0, 1, 2, 3
#: Distinct counts that a task holds before it hands them on, and new ones that wait to be added to them.
HELD, WAITING = 1_500_000, 500_000
#: Bytes of text that a task works on at a time, unless one text has more: its grams are arrays of 64 bits.
SLICE = 1 << 20
#: Binary nodes that are weighed together.
COLUMNS = 32


def hashed(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64).view(np.int64)


def framed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with their edges in one array, the places of the bytes to tell (a text's own
    and its end), and where in those places each text begins."""
    before = bytes([EDGE]) * DEPTH
    data = np.frombuffer(b"".join(part for raw in raws for part in (before, raw, before[:1])), np.uint8)
    sizes = np.array([len(raw) + 1 for raw in raws], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    places = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(raws) + 1) * DEPTH, sizes)
    return data, places, begins


def grams(raws: list[bytes]) -> np.ndarray:
    """The DEPTH bytes before and the byte itself, the oldest highest, of every byte to tell."""
    data, places, _ = framed(raws)
    places -= DEPTH
    key = np.zeros(len(places), dtype=np.int64)
    for _ in range(DEPTH + 1):
        key <<= 8
        key |= data[places]
        places += 1
    return key


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class _Counts:
    """Counts by key; new ones are added up many at a time."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, found: np.ndarray) -> None:
        self.waiting.append(np.unique(found, return_counts=True))
        if sum(len(keys) for keys, _ in self.waiting) >= WAITING:
            self.settle()

    def settle(self) -> None:
        parts, self.waiting = [(self.keys, self.n), *self.waiting], []
        self.keys, self.n = _sum(np.concatenate([keys for keys, _ in parts]), np.concatenate([n for _, n in parts]))


def counts(docs: DataFrame, learn: Column) -> DataFrame:
    """kind, key, n: how many texts there are for which learn holds, how often each word (by a
    64-bit hash) and each gram occurs in them, and each gram in the others. Counted in the
    tasks first, then by key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: _Counts() for kind in (WORD, GRAM, OTHER)}
        texts = 0

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(keys), kind, np.int32)), "key": pa.array(keys), "n": pa.array(n)})

        for batch in rows.slices(batches, size=SLICE):
            raws = [(raw or b"").lower() for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            own = batch.column("learn").to_pylist()
            raws, others = [raw for raw, x in zip(raws, own) if x], [raw for raw, x in zip(raws, own) if not x]
            texts += len(raws)
            held[WORD].add(hashed([word for raw in raws for word in raw.split()]))
            held[GRAM].add(grams(raws))
            held[OTHER].add(grams(others))
            for kind, some in held.items():
                if len(some.keys) >= HELD:
                    yield out(kind, some.keys, some.n)
                    some.keys, some.n = some.keys[:0].copy(), some.n[:0].copy()
        for kind, some in held.items():
            some.settle()
            yield out(kind, some.keys, some.n)
        yield out(DOCS, np.zeros(1, np.int64), np.array([texts], np.int64))

    marked = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    return marked.mapInArrow(work, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """child: (context, byte before) to context, or -1; told: log10 of each byte's probability
    after each context. Contexts go by depth, the empty one first."""

    child: np.ndarray
    told: np.ndarray

    def bytes_log10(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """log10 probability of each byte to tell, after the longest context that the model has."""
        context = np.zeros(len(places), dtype=np.int64)
        live = np.arange(len(places))
        for back in range(1, DEPTH + 1):
            further = self.child[context[live], data[places[live] - back]]
            found = further >= 0
            live = live[found]
            context[live] = further[found]
        return self.told[context, data[places]]

    def log10(self, raws: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        data, places, begins = framed(raws)
        return np.add.reduceat(self.bytes_log10(data, places).astype(np.float64), begins) if raws else np.zeros(0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _heap(count: np.ndarray) -> np.ndarray:
    """Counts of bytes to counts at all places of the binary tree: node k has 2k and 2k + 1 below."""
    heap = np.zeros((len(count), 512))
    heap[:, 256:] = count
    for k in range(255, 0, -1):
        heap[:, k] = heap[:, 2 * k] + heap[:, 2 * k + 1]
    return heap


def _estimate(heap: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the KT probability of the counts, and the KT probability that a one follows."""
    zeros, ones = heap[:, 2 * nodes], heap[:, 2 * nodes + 1]
    log_kt = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1)
    return log_kt, (ones + 0.5) / (zeros + ones + 1)


def _mixed(heap: np.ndarray, rest: np.ndarray, nodes: np.ndarray, parent: np.ndarray, inner: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Probability that a one follows, at some binary nodes, after each context."""
    log_own, one = _estimate(heap, nodes)
    log_split, one_rest = _estimate(rest, nodes)
    # Upwards: what the longer contexts make of the counts, against the context's own estimate.
    log_weighted, stop = log_own.copy(), np.ones_like(log_own)
    for own in reversed(levels):
        split = own[inner[own]]
        log_weighted[split] = np.log(0.5) + np.logaddexp(log_own[split], log_split[split])
        stop[split] = np.exp(np.log(0.5) + log_own[split] - log_weighted[split])
        if parent[own[0]] >= 0:
            np.add.at(log_split, parent[own], log_weighted[own])
    # Downwards: the mixture is linear in what the last context says.
    fixed, share = np.zeros_like(one), np.ones_like(one)
    for own in levels[1:]:
        above = parent[own]
        fixed[own] = fixed[above] + share[above] * stop[above] * one[above]
        share[own] = share[above] * (1 - stop[above])
    return fixed + share * np.where(inner[:, None], stop * one + (1 - stop) * one_rest, one)


def weigh(contexts: list[np.ndarray], cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """contexts: by depth, sorted keys of the kept contexts (the last byte before lowest);
    cells: by depth, (context key, byte, count). The parents of a kept context are kept."""
    offsets = np.cumsum([0, *map(len, contexts)])
    levels = [np.arange(a, b) for a, b in zip(offsets, offsets[1:]) if b > a]
    total = int(offsets[-1])
    count = np.zeros((total, 256))
    for depth, (keys, symbol, n) in enumerate(cells):
        np.add.at(count, (offsets[depth] + np.searchsorted(contexts[depth], keys), symbol), n)
    child = np.full((total, 256), -1, dtype=np.int32)
    parent = np.full(total, -1)
    rest = count.copy()
    for depth in range(1, len(contexts)):
        own = np.arange(offsets[depth], offsets[depth + 1])
        above = offsets[depth - 1] + np.searchsorted(contexts[depth - 1], contexts[depth] & ((1 << 8 * (depth - 1)) - 1))
        parent[own] = above
        child[above, contexts[depth] >> 8 * (depth - 1)] = own
        np.subtract.at(rest, above, count[own])
    inner = (child >= 0).any(axis=1)
    count, rest = _heap(count), _heap(rest)
    last = np.zeros((total, 256), dtype=np.float32)
    for start in range(1, 256, COLUMNS):
        nodes = np.arange(start, min(256, start + COLUMNS))
        last[:, nodes] = _mixed(count, rest, nodes, parent, inner, levels)
    del count, rest
    told = np.zeros((total, 512), dtype=np.float32)
    for k in range(1, 256):
        told[:, 2 * k] = told[:, k] + np.log10(1 - last[:, k])
        told[:, 2 * k + 1] = told[:, k] + np.log10(last[:, k])
    return Model(child, told[:, 256:].copy())


def _log_gamma_of(x: Column) -> Column:
    """_log_gamma as an expression."""
    shift = x
    for k in range(1, 8):
        shift = shift * (x + k)
    z = x + 8
    return (z - 0.5) * F.log(z) - z + float(0.5 * np.log(2 * np.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shift)


def _log_kt() -> Column:
    zeros, ones = F.col("zeros"), F.col("ones")
    return _log_gamma_of(zeros + 0.5) + _log_gamma_of(ones + 0.5) - float(np.log(np.pi)) - _log_gamma_of(zeros + ones + 1.0)


def _steps(found: DataFrame) -> DataFrame:
    """A row for each binary decision of each gram: `at` is the node, below its context's bytes; `bit` the decision."""
    byte = F.col("key").bitwiseAND(255).bitwiseOR(256)
    below = F.explode(F.array(*[F.shiftright(byte, k) for k in range(7, -1, -1)])).alias("below")
    node = F.shiftright("below", 1)
    return found.select("*", below).select("*", (F.col("key") - F.col("key").bitwiseAND(255) + node).alias("at"), F.col("below").bitwiseAND(1).alias("bit")).drop("below")


def told(counted: DataFrame) -> DataFrame:
    """key, seen, told: log10 of the probability of each gram's byte after its context, for the
    grams of all texts; seen is how often it occurs in them.

    A node that a context of depth d has is kept as (bytes of the context, node): the lowest
    8 * d bits and the node name its parent.
    """
    found = stored(
        counted.where(F.col("kind").isin(GRAM, OTHER))
        .groupBy("key")
        .agg(F.sum(F.when(F.col("kind") == GRAM, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("seen")),
        "grams",
    )
    # Upwards: what the longer contexts make of the counts, against the context's own estimate.
    n, half = F.col("n").cast("double"), float(np.log(0.5))
    last = _steps(found).groupBy("at").agg(F.sum(n * (1 - F.col("bit"))).alias("zeros"), F.sum(n * F.col("bit")).alias("ones"))
    levels = {DEPTH: stored(last.withColumn("weighted", _log_kt()).withColumn("stop", F.lit(1.0)), "up")}
    for depth in range(DEPTH - 1, -1, -1):
        above = levels[depth + 1].groupBy(F.col("at").bitwiseAND((1 << 8 * (depth + 1)) - 1).alias("at"))
        own = above.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("split")).withColumn("own", _log_kt())
        more = F.greatest("own", "split") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("split"))))
        stop = 1 / (1 + F.exp(F.col("split") - F.col("own")))
        levels[depth] = stored(own.select("at", "zeros", "ones", (half + more).alias("weighted"), stop.alias("stop")), "up")
    # Downwards: fixed is what the shorter contexts say of a one, share what is left to the longer.
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    down = None
    for depth in range(DEPTH + 1):
        level = levels[depth].select("at", (F.col("stop") * one).alias("said"), "stop")
        if down is None:
            down = level.select("at", F.col("said").alias("fixed"), (1 - F.col("stop")).alias("share"))
        else:
            parent = F.col("at").bitwiseAND((1 << 8 * depth) - 1)
            met = level.withColumn("parent", parent).join(down.withColumnRenamed("at", "parent"), "parent")
            down = met.select("at", (F.col("fixed") + F.col("share") * F.col("said")).alias("fixed"), (F.col("share") * (1 - F.col("stop"))).alias("share"))
    bit = F.log10(F.when(F.col("bit") == 1, F.col("fixed")).otherwise(1 - F.col("fixed")))
    return _steps(found).join(down.select("at", "fixed"), "at").groupBy("key").agg(F.first("seen").alias("seen"), F.sum(bit).alias("told"))


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """Scores of every whole text by what the texts for which learn holds (on doc_id) teach.

    doc_id; n_tokens (words and one end); n_known (tokens seen in training); train_tokens;
    base_score (log10 probability by add-one word counts); score (log10 probability of the
    lowered text by context-tree weighting); bits_per_byte of the latter. A null text is an
    empty one, repeated rows give a row each, and without training texts all bytes are alike.

    Frequent words and grams are looked up in the tasks; the others, of which none is in more
    than WORD_SHARE of the tokens or GRAM_SHARE of the bytes, meet their counts, or what they
    are told with, in a join.
    """
    spark = docs.sparkSession
    counted = stored(counts(docs, learn), "counts")
    tree = stored(told(counted), "told")
    words = counted.where(F.col("kind") == WORD)
    train_texts = counted.where(F.col("kind") == DOCS).agg(F.sum("n")).first()[0] or 0
    seen = words.agg(F.sum("n"), F.count("*")).first()
    n_tokens, n_words = (seen[0] or 0) + train_texts, seen[1] + (train_texts > 0)
    frequent = words.where(F.col("n") >= max(1.0, n_tokens * WORD_SHARE)).select("key", "n").toArrow()
    keys, n = frequent.column("key").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(keys)
    n_grams = tree.agg(F.sum("seen")).first()[0] or 0
    common = tree.where(F.col("seen") >= max(1.0, n_grams * GRAM_SHARE)).select("key", "told").orderBy("key").toArrow()
    near = common.column("key").to_numpy(), common.column("told").to_numpy()
    sent = spark.sparkContext.broadcast((keys[order], np.log10(n[order] + 1.0), *near, float(np.log10(train_texts + 1.0)), train_texts > 0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, common, tells, end_log, end_known = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in rows.slices(batches, size=SLICE):
            raws = [(raw or b"").lower() for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            split = [raw.split() for raw in raws]
            sizes = np.array([len(x) for x in split], dtype=np.int64)
            found = hashed([word for x in split for word in x])
            at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
            known = keys[at] == found if len(keys) else np.zeros(len(found), bool)
            owner = np.repeat(np.arange(len(raws)), sizes)
            base = np.bincount(owner[known], logs[at[known]], len(raws)) + end_log
            rare = np.bincount(owner[~known], minlength=len(raws))
            offsets = np.concatenate([[0], np.cumsum(rare)]).astype(np.int32)
            asked = grams(raws)
            place = np.minimum(np.searchsorted(common, asked), max(0, len(common) - 1))
            there = common[place] == asked if len(common) else np.zeros(len(asked), bool)
            teller = np.repeat(np.arange(len(raws)), [len(raw) + 1 for raw in raws])
            score = np.bincount(teller[there], tells[place[there]], len(raws)).astype(np.float64)
            others = np.concatenate([[0], np.cumsum(np.bincount(teller[~there], minlength=len(raws)))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(row + np.arange(len(raws))),
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(sizes + 1),
                    "known": pa.array(np.bincount(owner[known], minlength=len(raws)).astype(np.int64) + int(end_known)),
                    "base": pa.array(base),
                    "score": pa.array(score),
                    "n_bytes": pa.array([len(raw) for raw in raws], pa.int64()),
                    "rare": pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[~known])),
                    "grams": pa.ListArray.from_arrays(pa.array(others), pa.array(asked[~there])),
                }
            )
            row += len(raws)

    schema = "row long, doc_id long, n_tokens long, known long, base double, score double, n_bytes long, rare array<long>, grams array<long>"
    scored = stored(rows.texts(docs).mapInArrow(work, schema), "scored")
    met = scored.select("row", F.explode("rare").alias("key")).join(words.select("key", "n"), "key")
    summed = met.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("more_base"))
    further = scored.select("row", F.explode("grams").alias("key")).join(tree.select("key", "told"), "key").groupBy("row").agg(F.sum("told").alias("more_score"))
    space = float(np.log10(n_tokens + n_words + 1.0))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(space)
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return scored.join(summed, "row", "left").join(further, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        F.when(F.col("n_bytes") > 0, -score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
