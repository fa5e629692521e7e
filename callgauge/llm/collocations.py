"""Phrases of two to five words that stand together more often than their parts explain.

Every run of words gets a Rabin-Karp fingerprint (`rolling`). Passes over the texts count
fingerprints of one, two and three words by a shuffle; a run is counted only if both runs of
one word less in it may be frequent, for else it can't be (a Bloom filter tells, which lets
some through and loses none). A last pass goes back to the text. Every run whose fingerprint
may be frequent keeps a pointer to its first occurrence in the slice, all other occurrences
are compared with that one word by word, and the phrase is read there. These phrases are
counted by their text. So a collision of fingerprints can only cost time: frequent phrases
alone are ever written out, and their counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgauge.llm import bitfilter, rolling, rows
from callgauge.sources.workspace import run_folder

LONGEST, LEAST, TOP = 5, 100, 2000
#: Up to this length runs are counted by fingerprint; longer ones have few candidates left.
COUNTED, PAIR = 3, 2
UNKNOWN = "und"
#: Bytes of text that a task works on at a time; one text may have more.
SLICE = 4 << 20
#: Phrases that a task of the last pass adds up before it hands them on.
HELD = 400_000

INSIDE = np.ones(256, bool)
INSIDE[np.frombuffer(b" \t.,;:!?\n\x0b\x0c\r", np.uint8)] = False
BREAKS = np.zeros(256, bool)
BREAKS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = True
LOWER = rolling.lowered()
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Slice:
    """Runs of words in a slice of texts. Runs never cross pieces or texts."""

    def __init__(self, texts: pa.Array, lang: np.ndarray):
        self.words = w = rolling.words_of(texts, INSIDE, LOWER)
        breaks = np.zeros(len(w.raw) + 1, np.int32)
        np.cumsum(BREAKS[w.raw], out=breaks[1:])
        first = np.zeros(len(w), bool)  # words that begin a piece
        if len(w):
            first[0] = True
            first[1:] = (breaks[w.starts[1:]] != breaks[w.stops[:-1]]) | (w.text[1:] != w.text[:-1])
        ends = np.append(np.flatnonzero(first)[1:], len(w))
        #: Words from each one to the end of its piece.
        self.left = np.repeat(ends, np.diff(np.append(np.flatnonzero(first), len(w)))) - np.arange(len(w))
        self.sums, self.lang = rolling.prefix(w.hashes), lang[w.text]

    def fingerprints(self, size: int) -> np.ndarray:
        """By first word, for the words with `size - 1` more after them in the slice."""
        found = rolling.windows(self.sums, size)
        return rolling.mix(found + self.lang[: len(found)])

    def candidates(self, size: int, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First words of runs of this size that may be frequent, and their fingerprints.

        filters[k - 1] is of the frequent runs of k words. All runs of the longest size
        there that lie in a run have to pass.
        """
        at = np.flatnonzero(self.left >= size)
        part = min(size - 1, len(filters))
        if part:
            passed = bitfilter.holds(filters[part - 1], self.fingerprints(part))
            for ahead in range(size - part + 1):
                at = at[passed[at + ahead]]
        return at, self.fingerprints(size)[at] if len(at) else np.zeros(0, np.uint64)

    def phrases(self, size: int, at: np.ndarray, found: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First occurrence and count of every distinct run, told apart by its words."""
        _, rep, group, count = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
        mine, theirs = at, at[rep][group]
        if not all(np.array_equal(ids[mine + k], ids[theirs + k]) and np.array_equal(self.lang[mine], self.lang[theirs]) for k in range(size)):
            table = np.stack([*(ids[at + k] for k in range(size)), self.lang[at].view(np.int64)], axis=1)
            _, rep, count = np.unique(table, axis=0, return_index=True, return_counts=True)
        return at[rep], count

    def read(self, size: int, at: np.ndarray) -> list[bytes]:
        """Lower-case phrases, one space between words."""
        w = self.words
        data = w.raw.tobytes().translate(LOWER_BYTES)
        cut = [data[a:b] for a, b in zip(w.starts[at].tolist(), w.stops[at + size - 1].tolist())]
        return cut if size == 1 else [b" ".join(x.split()) for x in cut]


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)) if "lang" in docs.columns else F.lit(UNKNOWN)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).withColumn("code", F.xxhash64("lang"))


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("code").to_numpy().astype(np.int64).view(np.uint64)


def _counted(texts: DataFrame, size: int, filters: list, slice_bytes: int) -> DataFrame:
    """Counts by fingerprint of the runs of this size that may be frequent; collisions only add
    to them. The pass over three words also tells single words that stand in a pair that may
    be frequent, as fp with no n: no other single word is a part of a phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [f.value for f in filters]
        for batch in rows.slices(batches, size=slice_bytes):
            part = Slice(batch.column("text"), _codes(batch))
            _, found = part.candidates(size, tables)
            fp, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rolling.signed(fp)), pa.array(n, pa.int64())], names=["fp", "n"])
            if size == PAIR + 1:
                pairs, found = part.candidates(PAIR, tables)
                pairs, single = pairs[bitfilter.holds(tables[PAIR - 1], found)], part.fingerprints(1)
                fp = np.unique(np.concatenate([single[pairs], single[pairs + 1]]))
                yield pa.RecordBatch.from_arrays([pa.array(rolling.signed(fp)), pa.nulls(len(fp), pa.int64())], names=["fp", "n"])

    return texts.select("text", "code").mapInArrow(count, "fp long, n long").groupBy("fp", F.col("n").isNull().alias("single")).agg(F.sum("n").alias("n"))


def _materialise(texts: DataFrame, filters: list, longest: int, slice_bytes: int) -> DataFrame:
    """Phrases that may be frequent, with their counts in a task and a pointer to the first
    occurrence; k = 0 counts all words. A task hands on most of the phrases, so there is one
    a core: the rows grow with the phrases then, not with phrases times input."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = [f.value for f in filters], _Held()
        for batch in rows.slices(batches, size=slice_bytes):
            part = Slice(batch.column("text"), _codes(batch))
            w, ids = part.words, part.words.identities(LOWER_BYTES)
            langs, doc_ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
            for text, n in enumerate(np.diff(w.first).tolist()):
                held.add(langs[text], 0, b"", n, doc_ids[text], 0)
            for size in range(1, longest + 1):
                at, found = part.candidates(size, tables)
                if size <= len(tables):
                    passed = bitfilter.holds(tables[size - 1], found)
                    at, found = at[passed], found[passed]
                if len(at):
                    rep, count = part.phrases(size, at, found, ids)
                    texts, words = w.text[rep], rep - w.first[w.text[rep]]
                    for phrase, n, text, word in zip(part.read(size, rep), count.tolist(), texts.tolist(), words.tolist()):
                        held.add(langs[text], size, phrase, n, doc_ids[text], word)
            if len(held.counts) >= HELD:
                yield held.hand_on()
        yield held.hand_on()

    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(cores).mapInArrow(read, "lang string, k int, phrase binary, n long, doc_id long, word long")


class _Held:
    """Counts and first places of phrases that a task has met since it last handed on."""

    def __init__(self):
        self.counts: dict[tuple[str, int, bytes], int] = {}
        self.places: dict[tuple[str, int, bytes], tuple[bool, int, int]] = {}

    def add(self, lang: str, size: int, phrase: bytes, n: int, doc_id: int | None, word: int) -> None:
        key, place = (lang, size, phrase), (doc_id is None, doc_id or 0, word)
        self.counts[key] = self.counts.get(key, 0) + n
        self.places[key] = min(place, self.places.get(key, place))

    def hand_on(self) -> pa.RecordBatch:
        langs, sizes, phrase = zip(*self.counts) if self.counts else ((), (), ())
        doc_ids = [None if none else doc_id for none, doc_id, _ in self.places.values()]
        words = [word for _, _, word in self.places.values()]
        columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrase, pa.binary()), pa.array(self.counts.values(), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(words, pa.int64())]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "k", "phrase", "n", "doc_id", "word"])


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, slice_bytes: int = SLICE, bits: int = bitfilter.BITS) -> DataFrame:
    """lang, k, phrase, f of all phrases of 2 to `longest` words with f >= least and of all words
    in them (k = 1), and where the first one stands (doc_id, word; of several the smallest, no
    id last). A row with k = 0 and an empty phrase has the number of all words of a language."""
    spark, texts, filters = docs.sparkSession, _texts(docs), []
    for size in range(1, COUNTED + 1):
        folder = run_folder(spark, f"phrases{size}")
        counts = _counted(texts, size, filters, slice_bytes)
        counts.where(F.col("single") | (F.col("n") >= least)).write.parquet(folder)
        frequent = spark.read.parquet(folder)
        filters.append(spark.sparkContext.broadcast(bitfilter.build(frequent.where("not single"), bits=bits)))
    words = spark.sparkContext.broadcast(bitfilter.build(frequent.where("single"), bits=bits))
    filters[0] = words  # from here on words outside all frequent pairs don't count
    found = _materialise(texts, filters, longest, slice_bytes)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "word")
    counted = found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f"), F.min(place).alias("place"))
    counted = counted.where((F.col("k") == 0) | (F.col("f") >= least))
    return counted.select("lang", "k", F.col("phrase").cast("string").alias("phrase"), "f", "place.doc_id", "place.word")


def _part(first: Column | int, size: Column) -> Column:
    """Words from `first` (from 1) of the array `words`, as a phrase."""
    return F.array_join(F.slice("words", first, size), " ")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), in 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(22,0)") * wide(n), wide(l) * wide(r))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of two words and more of each language, from what phrases() gives.

    All parts of a frequent phrase are frequent, so they are in `found` too.
    """
    total = found.where("k = 0").select("lang", F.col("f").alias("n"))
    counts = found.where("k >= 1").select("lang", "phrase", "f")
    several = found.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), "doc_id", "word", F.split("phrase", " ").alias("words"))
    cut = several.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    sided = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    sided = sided.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = sided.join(F.broadcast(total), "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))  # a row for each language
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "n", "a")).alias("best")).select("lang", "phrase", "best.*")
    inner = several.where("k >= 3").select("lang", "a", "k", "words", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    longer = inner.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    place = several.select("lang", "phrase", F.col("doc_id").alias("first_doc_id"), F.col("word").alias("first_word"))
    return kept.join(place, ["lang", "phrase"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc_id", "first_word")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, slice_bytes: int = SLICE) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score, and where the
    phrase stands first (first_doc_id, first_word; the smallest place, rows without id last).

    A null text is empty, a null language is `und`, also where there is no column lang.
    Repeated rows count again. Ties in the score go by count and phrase, so ranks are
    settled. No rows or no frequent phrase give no rows. Other columns are not looked at.
    """
    folder = run_folder(docs.sparkSession, "phrases")
    phrases(docs, longest, least, slice_bytes).write.parquet(folder)
    return ranked(docs.sparkSession.read.parquet(folder), top)
