"""Token ids in patched frame-of-reference blocks.

A shard is one byte string, all integers little-endian:

    magic "PFR1", block length (uint32), documents, ids, blocks (uint64 each)
    doc_id (int64) and whether it is there (uint8) of each document
    ids of each document (uint64)
    start of each block in the body (uint64)
    body: blocks of block-length ids, the last one shorter

A block subtracts its minimum and packs the rest at the width that holds a given share of
them; a value that needs more bits leaves its low bits in place and goes whole into the
exception list:

    minimum (uint32), width in bits (uint8), exceptions (uint16)
    packed values, lowest bit first, up to a whole byte
    places of the exceptions in the block (uint16 each), their values (uint32 each)

The block starts give any run of ids without decoding the rest (`read_ids`).
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callgauge.llm import rows, units

MAGIC = b"PFR1"
HEADER = struct.Struct("<4sIQQQ")
BLOCK = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
BLOCK_IDS = 128
#: Share of a block's values that the packed width holds.
SHARE = 0.98
#: A shard is closed at so many ids; a document stays in one shard.
SHARD_IDS = 262_144
END_ID = 0
#: Units unseen so far that are encoded as one text.
TOGETHER = 2000
#: Bits of the values that two bytes hold.
SMALL_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; exact, as float64 holds all 32-bit integers."""
    if values.max(initial=0) < len(SMALL_BITS):
        return SMALL_BITS[values]
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _item(width: int) -> int:
    """Bytes of the least integer that holds so many bits."""
    return 1 if width <= 8 else 2 if width <= 16 else 4


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values to rows of bytes, lowest bit first; higher bits are cut off."""
    size = _item(width)
    bits = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(*values.shape, size), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, count=count * width, bitorder="little").reshape(len(packed), count, width)
    values = np.zeros((len(packed), count), dtype=np.uint32)
    for k in range(width):
        values |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return values


def _body(ids: np.ndarray, length: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of blocks of one length, and the size of each."""
    blocks = ids.reshape(-1, length)
    low = blocks.min(axis=1)
    above = blocks - low[:, None]
    needed = _bits(above)
    rank = min(length - 1, int(np.ceil(share * length)) - 1)
    width = np.partition(needed, rank, axis=1)[:, rank].astype(np.int64)
    over = needed > width[:, None]
    exceptions = over.sum(axis=1)
    packed_size = (width * length + 7) // 8
    sizes = BLOCK.itemsize + packed_size + 6 * exceptions
    starts = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), dtype=np.uint8)
    heads = np.zeros(len(blocks), dtype=BLOCK)
    heads["low"], heads["width"], heads["exceptions"] = low, width, exceptions
    body[starts[:, None] + np.arange(BLOCK.itemsize)] = heads.view(np.uint8).reshape(-1, BLOCK.itemsize)
    for w in np.unique(width[width > 0]):
        these = np.flatnonzero(width == w)
        packed = _pack(above[these], int(w))
        body[(starts[these] + BLOCK.itemsize)[:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = starts[block] + BLOCK.itemsize + packed_size[block]
    body[(at + 2 * rank)[:, None] + np.arange(2)] = place.astype("<u2").view(np.uint8).reshape(-1, 2)
    body[(at + 2 * exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = above[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return body, sizes


def write_shard(doc_ids: list[int | None], parts: list[np.ndarray], length: int = BLOCK_IDS, share: float = SHARE) -> bytes:
    """parts: the ids of each document."""
    ids = np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.uint32)
    whole = len(ids) // length * length
    body, sizes = _body(ids[:whole], length, share) if whole else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    if whole < len(ids):
        rest, rest_size = _body(ids[whole:], len(ids) - whole, share)
        body, sizes = np.concatenate([body, rest]), np.concatenate([sizes, rest_size])
    return b"".join(
        [
            HEADER.pack(MAGIC, length, len(doc_ids), len(ids), len(sizes)),
            np.array([0 if x is None else x for x in doc_ids], dtype="<i8").tobytes(),
            np.array([x is not None for x in doc_ids], dtype=np.uint8).tobytes(),
            np.array([len(x) for x in parts], dtype="<u8").tobytes(),
            (np.cumsum(sizes) - sizes).astype("<u8").tobytes(),
            body.tobytes(),
        ]
    )


@dataclass
class Shard:
    """What stands before the body, and the body."""

    length: int
    n_ids: int
    doc_ids: list[int | None]
    sizes: np.ndarray
    starts: np.ndarray
    body: np.ndarray


def open_shard(data: bytes) -> Shard:
    magic, length, docs, n_ids, blocks = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = HEADER.size
    ids = np.frombuffer(data, "<i8", docs, at).tolist()
    there = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", blocks, at + 17 * docs).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=at + 17 * docs + 8 * blocks)
    return Shard(length, n_ids, [x if ok else None for x, ok in zip(ids, there)], sizes, starts, body)


def _blocks(shard: Shard, these: np.ndarray, length: int) -> np.ndarray:
    """Values of some blocks that have so many ids."""
    starts = shard.starts[these]
    heads = shard.body[starts[:, None] + np.arange(BLOCK.itemsize)].reshape(-1).view(BLOCK)
    width, exceptions = heads["width"].astype(np.int64), heads["exceptions"].astype(np.int64)
    values = np.zeros((len(these), length), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        at = (starts[own] + BLOCK.itemsize)[:, None] + np.arange((int(w) * length + 7) // 8)
        values[own] = _unpack(shard.body[at], length, int(w))
    block = np.repeat(np.arange(len(these)), exceptions)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = starts[block] + BLOCK.itemsize + (width[block] * length + 7) // 8
    place = shard.body[(at + 2 * rank)[:, None] + np.arange(2)].reshape(-1).view("<u2")
    values[block, place] = shard.body[(at + 2 * exceptions[block] + 4 * rank)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    return values + heads["low"].astype(np.uint32)[:, None]


def read_ids(shard: Shard, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a shard; only their blocks are decoded."""
    stop = shard.n_ids if stop is None else min(stop, shard.n_ids)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // shard.length, (stop - 1) // shard.length
    full = shard.n_ids // shard.length
    found = []
    if first < full:
        found.append(_blocks(shard, np.arange(first, min(last + 1, full)), shard.length).reshape(-1))
    if last >= full:
        found.append(_blocks(shard, np.array([full]), shard.n_ids - full * shard.length).reshape(-1))
    return np.concatenate(found)[start - first * shard.length : stop - first * shard.length]


@cache
def library(path: str) -> units.UnitEncoder:
    """The tokenizers library, one per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
    tokenizer = Tokenizer.from_file(path)

    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    added = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
    widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    for token, number in vocabulary.items():  # a byte is a character of a token, but for added ones
        widths[number] = len(token.encode()) if token in added else len(token)

    def ids_of(texts: list[str]) -> Iterator[np.ndarray]:
        for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(found.ids, dtype="<u4")

    def encode_many(texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            yield from together(some) or map(np.ndarray.tobytes, ids_of(some))

    def together(texts: list[str]) -> list[bytes] | None:
        """Units, each with the space or line end before it, encoded as one text and cut by the
        bytes of the tokens; None if they are no such units."""
        text = "".join(texts)
        if len(texts) < 2 or not all(map(str.startswith, texts, repeat((" ", "\n")))) or units.UNSAFE.search(text):
            return None
        (ids,) = ids_of([text])
        ends, wanted = np.cumsum(widths[ids]), np.cumsum(list(map(len, texts if text.isascii() else map(str.encode, texts))))
        stops = np.searchsorted(ends, wanted) + 1
        if not len(ends) or ends[-1] != wanted[-1] or not np.array_equal(ends[stops - 1], wanted):
            return None
        data = ids.tobytes()
        return [data[4 * x : 4 * y] for x, y in zip([0, *stops.tolist()], stops.tolist())]

    def pieces(text: str) -> int:
        return len(tokenizer.pre_tokenizer.pre_tokenize_str(text)) if tokenizer.pre_tokenizer else 1

    return units.UnitEncoder(encode_many, line_ends=all(pieces(f"{x}\n{y}") == 3 for x in "a1." for y in "a1."))


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> None:
    """Encode all texts and write their ids, each text ended by end_id, as shards below folder.

    The rows go out in ascending order of doc_id (nulls first; equal ids by text, nulls
    first): texts are dealt by ranges of doc_id and sorted in each range. Spark's Parquet
    writer commits the shards, one to a row, so a lost executor leaves no half shard, and
    any file system will do. A null or empty text is its end_id alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library(tokenizer), TaskContext.get().partitionId()
        first, doc_ids, parts, held = 0, [], [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "first": pa.array([first], pa.int64()),
                    "n_ids": pa.array([held], pa.int64()),
                    "shard": pa.array([write_shard(doc_ids, parts)], pa.binary()),
                }
            )

        for batch in rows.slices(batches):
            ids, sizes = encoder.encode_all(pc.fill_null(batch.column("text"), ""))
            ends = np.cumsum(sizes + 1)
            ended = np.full(len(ids) + len(sizes), end_id, dtype="<u4")
            own = np.ones(len(ended), bool)
            own[ends - 1] = False
            ended[own] = ids
            for doc_id, stop, size in zip(batch.column("doc_id").to_pylist(), ends.tolist(), sizes.tolist()):
                doc_ids.append(doc_id)
                parts.append(ended[stop - size - 1 : stop])
                held += size + 1
                if held >= SHARD_IDS:
                    yield shard()
                    first, doc_ids, parts, held = first + held, [], [], 0
        if doc_ids:
            yield shard()

    dealt = rows.texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(work, "part int, first long, n_ids long, shard binary").write.option("compression", "none").parquet(folder)


def part_starts(shards: DataFrame) -> Column:
    """Ids in all parts before a shard's own; parts are as many as Spark's partitions were."""
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts, done = [F.lit(-1), F.lit(0).cast("long")], 0
    for part, n in totals:
        starts += [F.lit(part), F.lit(done).cast("long")]
        done += n
    return F.create_map(*starts)[F.col("part")]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document of the shards below folder: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    shards = spark.read.parquet(folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, first in zip(batch.column("shard"), batch.column("first").to_pylist()):
                shard = open_shard(data.as_py())
                ends = np.cumsum(shard.sizes)
                packed = read_ids(shard).astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.doc_ids, pa.int64()),
                        "start": pa.array(first + ends - shard.sizes, pa.int64()),
                        "n_tokens": pa.array(shard.sizes, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(packed[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), shard.sizes.tolist())], pa.int64()),
                    }
                )

    placed = shards.select((part_starts(shards) + F.col("first")).alias("first"), "shard")
    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
