"""Passages that stand in the corpus more than once, word for word.

A window is `window` consecutive words. Its anchor is the run of ANCHOR words in it with the
smallest fingerprint (the leftmost of equal ones), so equal windows have equal anchors.

1. Anchors are counted; a window can recur only if its anchor does (a Bloom filter of bounded
   size tells, which lets some through and loses none).
2. Recurring windows are confirmed: the windows of such anchors are counted by anchor and
   fingerprint, 128 bits together, with partial sums before the shuffle.
3. Documents go by once more. The words around each anchor that may recur, at most
   2 * window - ANCHOR - 1 words, travel to the shard of that anchor, together with the
   confirmed windows of it. A shard that holds far more anchors than others is split, and its
   windows go to every part. Words without such an anchor can't be in a passage and stay.
4. Each shard joins its confirmed windows to passages, compiles them into an Aho-Corasick
   automaton over word numbers (equal numbers are equal bytes) and streams all its text
   through it, which locates every occurrence.
5. Located spans meet their documents again by a 128-bit hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm import bitfilter, rolling, rows
from callgauge.sources.workspace import run_folder

WINDOW, ANCHOR = 35, 6
#: Bytes of text that a task works on at a time; one text may have more.
SLICE = 2 << 20
#: Anchors of a shard on average; a shard of four times as many is split.
SHARD = 4096
#: Words that go through an automaton at a time; words around one anchor may be more.
STREAM = 1 << 16
#: Split shards are told to all tasks up to this number, some 2 MB; beyond it they are joined.
TOLD = 100_000

INSIDE = np.ones(256, bool)
INSIDE[np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)] = False
ODD = np.uint64(0xD6E8FEB86659FD93)


class Slice:
    """Windows of a slice of texts, and the anchor of each."""

    def __init__(self, texts: pa.Array, window: int, anchor: int):
        self.words = w = rolling.words_of(texts, INSIDE)
        count = len(w)
        left = w.first[1:][w.text] - np.arange(count)
        sums = rolling.prefix(w.hashes)
        #: First words of windows.
        self.at = np.flatnonzero(left >= window)
        fp = rolling.mix(rolling.windows(sums, anchor))
        self.anchor = _leftmost_least(fp, window - anchor + 1)[self.at] if len(self.at) else self.at
        self.anchor_fp = fp[self.anchor] if len(self.at) else np.zeros(0, np.uint64)
        self.fp = rolling.mix(rolling.windows(sums, window)[self.at] * ODD) if len(self.at) else np.zeros(0, np.uint64)

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows in a row with one anchor: number of the first, and of the one after the last."""
        if not len(self.at):
            return self.at, self.at
        new = np.append(True, self.anchor[1:] != self.anchor[:-1])
        first = np.flatnonzero(new)
        return first, np.append(first[1:], len(self.at))


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """By place: where the least of the next `width` values stands, by doubling."""
    count = len(values) - width + 1
    place, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[:-step], place[step:]
        place, reach = np.where(values[b] < values[a], b, a), reach + step
    return place[:count]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def _anchors(texts: DataFrame, window: int, anchor: int, size: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches, size=size):
            part = Slice(batch.column("text"), window, anchor)
            fp, n = np.unique(part.anchor_fp[part.segments()[0]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rolling.signed(fp)), pa.array(n, pa.int64())], names=["fp", "n"])

    return texts.select("text").mapInArrow(count, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n")).where("n >= 2")


def _windows(texts: DataFrame, may_recur, window: int, anchor: int, size: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches, size=size):
            part = Slice(batch.column("text"), window, anchor)
            passed = bitfilter.holds(may_recur.value, part.anchor_fp)
            a, fp = part.anchor_fp[passed], part.fp[passed]
            found, rep, group, n = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
            own = a[rep]
            if not np.array_equal(own[group], a):  # one fingerprint, two anchors
                pairs, n = np.unique(np.stack([a, fp], axis=1), axis=0, return_counts=True)
                own, found = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(rolling.signed(own)), pa.array(rolling.signed(found)), pa.array(n, pa.int64())], names=["a", "fp", "n"])

    return texts.select("text").mapInArrow(count, "a long, fp long, n long").groupBy("a", "fp").agg(F.sum("n").alias("n")).where("n >= 2").select("a", "fp")


SEGMENT = "a long, k1 long, k2 long, start long, text binary"


def _segments(texts: DataFrame, may_recur, window: int, anchor: int, size: int) -> DataFrame:
    """The words around each anchor that may recur; of equal texts in a slice only those of one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches, size=size):
            part = Slice(batch.column("text"), window, anchor)
            w, (first, stop) = part.words, part.segments()
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            one = np.zeros(batch.num_rows, bool)
            one[np.unique(np.stack([k1, k2], axis=1), axis=0, return_index=True)[1]] = True
            own = w.text[part.at[first]]
            kept = one[own] & bitfilter.holds(may_recur.value, part.anchor_fp[first])
            first, stop, own = first[kept], stop[kept], own[kept]
            begin, end = part.at[first], part.at[stop - 1] + window
            data = w.raw.tobytes()
            text = [data[x:y] for x, y in zip(w.starts[begin].tolist(), w.stops[end - 1].tolist())]
            columns = [rolling.signed(part.anchor_fp[first]), k1[own], k2[own], begin - w.first[own]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(text, pa.binary())], names=["a", "k1", "k2", "start", "text"])

    return texts.select("text", "k1", "k2").mapInArrow(cut, SEGMENT)


def _hits(automaton: ahocorasick.Automaton, stream: np.ndarray, first: int) -> np.ndarray:
    """Places of all occurrences in a part of a stream that begins at `first`, and after them."""
    return np.array([(stop - size + 1, stop + 1) for stop, size in automaton.iter(tuple(stream.tolist()))], np.int64).reshape(-1, 2) + first


def _locate(segments: pa.Table, confirmed: pa.Table, window: int) -> pa.Table:
    """Spans of one shard, by word of the document."""
    k1, k2, start = (segments.column(c).to_numpy() for c in ("k1", "k2", "start"))
    empty = pa.table({"k1": pa.array([], pa.int64()), "k2": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "stop": pa.array([], pa.int64())})
    if not segments.num_rows or not confirmed.num_rows:
        return empty
    one = np.sort(np.unique(np.stack([k1, k2, start], axis=1), axis=0, return_index=True)[1])  # equal texts of other slices say the same
    segments, k1, k2, start = segments.take(pa.array(one)), k1[one], k2[one], start[one]
    w = rolling.words_of(segments.column("text").combine_chunks(), INSIDE)
    a = segments.column("a").to_numpy().view(np.uint64)
    at = np.flatnonzero(w.first[1:][w.text] - np.arange(len(w)) >= window)
    fp = rolling.mix(rolling.windows(rolling.prefix(w.hashes), window)[at] * ODD)
    known_fp, known_a = (np.ascontiguousarray(confirmed.column(c).to_numpy()).view(np.uint64) for c in ("fp", "a"))
    order = np.argsort(known_fp, kind="stable")
    known_fp, known_a = known_fp[order], known_a[order]
    recurs, low, high = np.zeros(len(at), bool), np.searchsorted(known_fp, fp), np.searchsorted(known_fp, fp, side="right")
    for step in range(int((high - low).max(initial=0))):  # more than one only where fingerprints collide
        here = np.minimum(low + step, len(known_fp) - 1)
        recurs |= (low + step < high) & (known_a[here] == a[w.text[at]])
    at = at[recurs]
    if not len(at):
        return empty
    new = np.append(True, (np.diff(at) != 1) | (w.text[at[1:]] != w.text[at[:-1]]))
    first = np.flatnonzero(new)
    begin, end = at[first], at[np.append(first[1:], len(at)) - 1] + window
    ids = w.identities() + 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for x, y in zip(begin.tolist(), end.tolist()):
        automaton.add_word(tuple(ids[x:y].tolist()), y - x)
    automaton.make_automaton()
    stream = np.zeros(len(w) + len(k1), np.int64)  # all texts of the shard, with a zero after each
    stream[np.arange(len(w)) + w.text] = ids
    stops = w.first[1:] + np.arange(1, len(k1) + 1)
    cuts = stops[np.unique(np.searchsorted(stops, np.arange(STREAM, len(stream) + STREAM, STREAM)).clip(max=len(k1) - 1))].tolist()
    hits = np.concatenate([_hits(automaton, stream[x:y], x) for x, y in zip([0, *cuts], cuts)])
    begins = w.first[:-1] + np.arange(len(k1))
    own = np.searchsorted(begins, hits[:, 0], side="right") - 1
    spans = hits - begins[own, None] + start[own, None]
    return pa.table({"k1": k1[own], "k2": k2[own], "start": spans[:, 0], "stop": spans[:, 1]})


def spans(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, slice_bytes: int = SLICE, shard: int = SHARD) -> DataFrame:
    """k1, k2 (hash of a text), start and stop of every recurring passage, in words; passages
    of one text may overlap. texts has the columns text, k1 and k2."""
    spark = texts.sparkSession
    folder = run_folder(spark, "repeats")
    _anchors(texts, window, anchor, slice_bytes).write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    may_recur = spark.sparkContext.broadcast(bitfilter.build(anchors))
    _windows(texts, may_recur, window, anchor, slice_bytes).write.parquet(f"{folder}/windows")
    total = anchors.agg(F.sum("n")).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism * 4, -(-int(total) // shard))
    bucket = F.pmod("a", F.lit(shards)).alias("bucket")
    parts = F.ceil(F.col("n") / F.lit(4 * shard)).cast("int").alias("parts")
    large = anchors.groupBy(F.pmod("fp", F.lit(shards)).alias("bucket")).agg(F.sum("n").alias("n")).where(F.col("n") > 4 * shard).select("bucket", parts)
    large = F.broadcast(large) if large.count() <= TOLD else large
    share = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("k1", "start"), "parts")).cast("int").alias("part")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part")
    segments = _segments(texts, may_recur, window, anchor, slice_bytes).select("*", bucket).join(large, "bucket", "left").select("a", "k1", "k2", "start", "text", "bucket", share)
    confirmed = spark.read.parquet(f"{folder}/windows").select("*", bucket).join(large, "bucket", "left").select("a", "fp", "bucket", every)

    def locate(left: pa.Table, right: pa.Table) -> pa.Table:
        return _locate(left, right, window)

    keys = ["bucket", "part"]
    return segments.groupBy(*keys).cogroup(confirmed.groupBy(*keys)).applyInArrow(locate, "k1 long, k2 long, start long, stop long")


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = True, slice_bytes: int = SLICE, shard: int = SHARD) -> DataFrame:
    """Every row of docs without the words of recurring passages: doc_id, n_words, spans of
    removed words (start, stop; joined, in order), n_removed, kept (the words left, one space
    between; null unless keep_text) and kept_sha256.

    A passage is a run of windows whose words also start anywhere else, in this text or
    another, rows that repeat included. All of its occurrences go, the first one too; what
    recurs is settled before anything goes. A null text has no words, as an empty or a blank
    one. A text of fewer than `window` words loses nothing. Rows with a null or a repeated id
    are rows like others; an empty table gives no rows; other columns are not looked at.
    """
    texts = _keyed(docs)
    found = spans(texts, window, anchor, slice_bytes, shard).distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    met = texts.join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches, size=slice_bytes):
            out: dict[str, list] = {name: [] for name in ("n_words", "spans", "n_removed", "kept", "kept_sha256")}
            for text, own in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                words, joined, kept, last = (text or b"").split(), [], [], 0
                for begin, end in sorted((s["start"], s["stop"]) for s in own or ()):
                    if joined and begin <= joined[-1]["stop"]:
                        joined[-1]["stop"] = max(joined[-1]["stop"], end)
                    else:
                        joined.append({"start": begin, "stop": end})
                for s in joined:
                    kept += words[last : s["start"]]
                    last = s["stop"]
                rest = b" ".join(kept + words[last:])
                removed = sum(s["stop"] - s["start"] for s in joined)
                for name, value in zip(out, (len(words), joined, removed, rest if keep_text else None, hashlib.sha256(rest).hexdigest())):
                    out[name].append(value)
            types = (pa.int64(), span, pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), types))], names=["doc_id", *out])

    schema = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, n_removed long, kept binary, kept_sha256 string"
    return met.mapInArrow(drop, schema).withColumn("kept", F.col("kept").cast("string"))
