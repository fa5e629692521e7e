"""Benchmark decontamination by suffix arrays over the training texts.

Each slice of a task's documents is a shard. Its words become numbers, those that no
benchmark item has become zero, and the places where a match can begin are sorted by the
words that follow (up to the next zero or the document's end): a suffix array over all that
can match. Every benchmark suffix is searched in it by bisection. A place where too few
benchmark words follow for the shortest window of its first word is left out of the array
before sorting; no match can begin there.

The benchmark is sent to the tasks in blocks of bounded size. With more than one block the
documents pass by once for each, and what was found goes along.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.llm import rows, words
from callgauge.sources.workspace import run_folder

WINDOW = 13
#: Bytes of benchmark text that tasks hold at a time (one item may have more), and of documents in a shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 32 << 20
NEVER = np.iinfo(np.int64).max

#: Item ids and texts.
Items = list[tuple[str, bytes | None]]


class Block:
    """Windows of some benchmark items and, if asked for, their packed words, of which
    suffixes() are cut as they are searched."""

    def __init__(self, items: Items, window: int = WINDOW, suffixes: bool = False):
        self.number: dict[bytes, int] = {}
        self.windows: dict[bytes, set[str]] = {}
        self.packed: list[tuple[str, int, bytes]] = []
        need: dict[int, int] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words.split(text)], dtype=">u4")
            size, packed = min(window, len(ids)), ids.tobytes()
            for start in range(len(ids) - size + 1 if size else 0):
                self.windows.setdefault(packed[4 * start : 4 * (start + size)], set()).add(item)
                need[int(ids[start])] = min(need.get(int(ids[start]), size), size)
            if suffixes and size:
                self.packed.append((item, len(ids) - size + 1, packed))
        #: By a word's number: words that a match beginning with it has at least.
        self.need = np.full(len(self.number) + 1, NEVER)
        for k, size in need.items():
            self.need[k] = size

    def suffixes(self, most: int) -> Iterator[tuple[str, int, bytes]]:
        """Item, place and at most `most` words of every suffix in which a window begins."""
        for item, count, packed in self.packed:
            for start in range(count):
                yield item, start, packed[4 * start : 4 * (start + most)]


class Shard:
    """Suffix array over documents; `at` are the places in suffix order."""

    def __init__(self, texts: list[bytes | None], block: Block):
        number = block.number.get
        numbers = [np.array([number(w, 0) for w in words.split(text)] + [0], dtype=np.int64) for text in texts]
        self.sizes = np.array([len(x) - 1 for x in numbers], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        ids = np.concatenate([np.zeros(0, np.int64), *numbers])
        stop = np.minimum.accumulate(np.where(ids == 0, np.arange(len(ids)), len(ids))[::-1])[::-1]
        begins = stop - np.arange(len(ids)) >= block.need[ids]
        # Only runs of known words in which a match can begin; each ends with a zero.
        runs = np.zeros(len(ids) + 1, dtype=np.int64)
        first = np.flatnonzero(begins & (np.concatenate([[True], ~begins[:-1]]) | np.concatenate([[True], ids[:-1] == 0])))
        np.add.at(runs, first, 1)
        np.add.at(runs, stop[first] + 1, -1)
        self.place = np.flatnonzero(np.cumsum(runs)[:-1] > 0)
        text = ids[self.place]
        self.packed = text.astype(">u4").tobytes()
        #: Words of the longest run; no match has more.
        self.run = int(np.diff(np.flatnonzero(text == 0), prepend=-1).max(initial=1)) - 1
        rank = _ranks(text)
        places = np.flatnonzero(begins[self.place])
        self.at = places[np.argsort(rank[places], kind="stable")].tolist()

    def find(self, key: bytes) -> np.ndarray:
        """Places in the shard where these words stand."""
        size = len(key)
        own = lambda k: self.packed[4 * k : 4 * k + size]
        low = bisect_left(self.at, key, key=own)
        return self.place[self.at[low : bisect_right(self.at, key, lo=low, key=own)]]

    def longest(self, key: bytes) -> tuple[int, int]:
        """Words and place of the longest match of the key's beginning; (0, -1) if there is none."""
        own = lambda k: self.packed[4 * k : 4 * k + len(key)]
        k, best = bisect_left(self.at, key, key=own), (0, -1)
        for near in self.at[max(0, k - 1) : k + 1]:
            a, b = np.frombuffer(own(near), ">u4"), np.frombuffer(key, ">u4")
            same = a[: len(b)] == b[: len(a)]
            size = len(same) if same.all() else int(np.argmin(same))
            best = max(best, (size, int(self.place[near])))
        return best

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _ranks(text: np.ndarray) -> np.ndarray:
    """Rank of each suffix, which a zero ends, by prefix doubling. The last word is a zero."""
    rank, k = text, 1
    longest = int(np.diff(np.flatnonzero(text == 0), prepend=-1).max(initial=0))
    while k < longest:
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:]
        ahead[rank == 0] = 0  # so zeros keep rank zero
        rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)[1].reshape(-1)
        k *= 2
    return rank


def _join(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def search(texts: list[bytes | None], block: Block) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Of each text: words, spans of hit words, items with a window in it."""
    shard = Shard(texts, block)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for key, own in block.windows.items():
        places = shard.find(key)
        if len(places):
            docs = shard.document(places)
            for doc in np.unique(docs).tolist():
                items[doc] |= own
            for doc, start in zip(docs.tolist(), (places - shard.starts[docs]).tolist()):
                spans[doc].append((start, start + len(key) // 4))
    return shard.sizes.tolist(), [_join(x) for x in spans], items


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[Callable[[], Items]]:
    """Loaders of the benchmark's blocks, dealt by a hash of item and text; one at least.
    Rows that repeat are taken once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0
    count = max(1, -(-int(total) // block_bytes))

    def load(k: int) -> Items:
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        return [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in own.collect()]

    return [partial(load, k) for k in range(count)]


def _scan(carried: DataFrame, benchmark: DataFrame, drop_text: bool, window: int, block_bytes: int) -> DataFrame:
    """carried: a struct column `row` with a field text. Adds n_words, spans and items."""
    spark = carried.sparkSession
    state = carried.select("row", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,stop:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema, loaders = state.schema, blocks(benchmark, block_bytes)
    for k, load in enumerate(loaders):
        sent, last = spark.sparkContext.broadcast(Block(load(), window)), k == len(loaders) - 1

        def work(batches: Iterator[pa.RecordBatch], sent=sent, blank=drop_text and last) -> Iterator[pa.RecordBatch]:
            for batch in _shards(batches):
                row = batch.column("row")
                field = row.type.get_field_index("text")
                texts = pc.cast(pc.struct_field(row, field), pa.binary()).to_pylist()
                sizes, spans, found = search(texts, sent.value)
                spans = [_join([*new, *((s["start"], s["stop"]) for s in old)]) for new, old in zip(spans, batch.column("spans").to_pylist())]
                found = [sorted(new | set(old)) for new, old in zip(found, batch.column("items").to_pylist())]
                if blank:
                    fields = [pa.nulls(len(row), f.type) if i == field else pc.struct_field(row, i) for i, f in enumerate(row.type)]
                    row = pa.StructArray.from_arrays(fields, fields=list(row.type))
                pairs = [[{"start": a, "stop": b} for a, b in x] for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [row, pa.array(sizes, pa.int64()), pa.array(pairs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(found, pa.list_(pa.string()))],
                    names=["row", "n_words", "spans", "items"],
                )

        state = state.mapInArrow(work, schema)
        if not last:  # one pass per job, and no chain of passes to redo if an executor is lost
            folder = run_folder(spark, "suffixes")
            state.write.parquet(folder)
            state = spark.read.parquet(folder)
    return state


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column("row")
        text = pc.struct_field(row, row.type.get_field_index("text"))
        for part in rows.slices(iter([batch.append_column("_size", text)]), "_size", SHARD_BYTES):
            yield part.select(batch.schema.names)


def hits() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated() -> Column:
    return (hits() > 0) & (20 * hits() >= F.col("n_words"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words (start, stop) and the items found, of every document.

    A window is `window` consecutive words of an item, or the whole of a shorter item that
    has words. Null and empty texts have no words and no hits. An item id may have several
    texts; repeated rows of documents give a row each. items are distinct and sorted.
    """
    carried = rows.texts(docs).select(F.struct("doc_id", "text").alias("row"))
    return _scan(carried, benchmark, True, window, block_bytes).select("row.doc_id", "n_words", "spans", "items")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not contaminated: no word is
    hit, or the hit words are under a twentieth of its words."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return _scan(carried, benchmark, False, window, block_bytes).where(~contaminated()).select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each benchmark suffix with a window in some document: item_id, item_word, the
    longest verbatim match n_words, and where it stands: doc_id, doc_word. Of equal matches
    the one with the smallest doc_id and word is named."""
    spark, found = docs.sparkSession, []
    for load in blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(Block(load(), window, suffixes=True))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in rows.slices(batches, size=SHARD_BYTES):
                ids = batch.column("doc_id").to_pylist()
                shard = Shard(pc.cast(batch.column("text"), pa.binary()).to_pylist(), sent.value)
                out = []
                for item, start, key in sent.value.suffixes(max(shard.run, window)):
                    size = shard.longest(key)[0]
                    for place in shard.find(key[: 4 * size]).tolist() if size and key[: 4 * min(size, window)] in sent.value.windows else ():
                        doc = int(shard.document(np.array([place]))[0])
                        out.append((item, start, size, ids[doc], place - int(shard.starts[doc])))
                columns = list(zip(*out)) or [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    names=["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                )

        found.append(rows.texts(docs).mapInArrow(work, "item_id string, item_word long, n_words long, doc_id long, doc_word long"))
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    best = F.max(F.struct("n_words", (-F.col("doc_id")).alias("doc"), (-F.col("doc_word")).alias("word"))).alias("best")
    return both.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "best.n_words", (-F.col("best.doc")).alias("doc_id"), (-F.col("best.word")).alias("doc_word"))
