"""Near-duplicates by BagMinHash signatures, bands, and exact multiset overlap.

A text is the multiset of its five-word shingles. For each shingle and each dyadic stretch
of weights [0,1), [1,2), [2,4), [4,8) ... there is a Poisson process of points, fixed by a
hash: a time, a register and a place in the stretch. A text meets the points that lie below
the shingle's count, and each register keeps the first of them. Two texts agree on a
register with the probability of their weighted Jaccard similarity. Times are followed only
up to a limit by which all registers have a point, so a signature costs little more than
one draw for each shingle.

Texts that agree on all registers of a band are candidates. Within a bucket, every text is
compared with the bucket's centre first, the one whose own buckets are the fullest; copies
of one text are settled by that in linear work. What a bucket still holds of different
classes is compared pair by pair, in blocks. Every comparison takes the exact overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgauge.llm import components, rows
from callgauge.llm.components import stored

WORDS, LEAST = 5, 0.8
#: Agreement in one of 20 bands of 4 registers misses a pair of similarity 0.8 once in 38,000 times.
BANDS, BAND = 20, 4
REGISTERS = BANDS * BAND
#: Members of a bucket that are compared in one task with as many others.
BLOCK = 256
#: Pairs whose signatures agree on less than this share are no candidates: at similarity 0.8 that
#: is over five standard deviations away.
LEAST_AGREEMENT = 0.55

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def shingles(words: list[bytes]) -> np.ndarray:
    """A hash for each run of five words; texts of fewer words are one shingle."""
    own = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    width = min(WORDS, len(own))
    count = len(own) - width + 1 if len(own) else 0
    out = np.full(count, np.uint64(width))
    for k in range(width):
        out = mix((out + GOLDEN) ^ own[k : k + count])
    return out


def signature(hashes: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """uint32 marks of the first point in each register; at least one hash is needed."""
    # One process for each shingle and each dyadic stretch that begins below its count.
    stretches = np.ceil(np.log2(counts)).astype(np.int64) + 1
    which = np.repeat(np.arange(len(hashes)), stretches)
    level = np.arange(len(which)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    begin = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length = np.maximum(begin, 1.0)
    key = mix(hashes[which] + (level.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    below, rate = counts[which].astype(np.float64), registers * length
    limit = (np.log(registers) + 4) / counts.sum()
    while True:
        times, places, marks = _points(key, begin, length, below, rate, limit, registers)
        order = np.argsort(times, kind="stable")
        found, first = np.unique(places[order], return_index=True)
        if len(found) == registers:
            return marks[order][first]
        limit *= 2


def _points(key: np.ndarray, begin: np.ndarray, length: np.ndarray, below: np.ndarray, rate: np.ndarray, limit: float, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Time, register and mark of all points up to the limit that lie below the counts."""
    now, done, kept = np.zeros(len(key)), 0, []
    active = np.arange(len(key))
    expected = limit * float(rate.max())
    draws = max(1, int(expected + 3 * expected**0.5)) if len(key) < 4096 else 1
    while len(active):
        steps = np.arange(done + 1, done + draws + 1, dtype=np.uint64) * GOLDEN
        drawn = mix(key[active][:, None] + steps)
        times = now[active][:, None] + np.cumsum(-np.log(_unit(drawn)) / rate[active][:, None], axis=1)
        row, column = np.nonzero(times <= limit)
        own, more = active[row], mix(drawn[row, column] ^ GOLDEN)
        place = begin[own] + length[own] * _unit(more)
        met = place <= below[own]
        kept.append((times[row, column][met], (more[met] & np.uint64(0xFFFFF)) % np.uint64(registers), (drawn[row, column][met] >> np.uint64(32)).astype(np.uint32)))
        now[active] = times[:, -1]
        active = active[times[:, -1] <= limit]
        done += draws
    return tuple(np.concatenate(x) for x in zip(*kept))


def describe(raw: bytes | None) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Hash of the text's words, its multiset as sorted distinct hashes of (shingle, how
    often before), and its signature. None without words."""
    words = raw.lower().split() if raw else []
    if not words:
        return None
    node = xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
    hashes, counts = np.unique(shingles(words), return_counts=True)
    again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    elements = mix(np.repeat(hashes, counts) + again.astype(np.uint64) * GOLDEN)
    return node, np.unique(elements), signature(hashes, counts)


def band_keys(signed: np.ndarray) -> np.ndarray:
    bands = signed.reshape(BANDS, BAND).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND):
        out = mix((out + GOLDEN) ^ bands[:, k])
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets as `describe` gives them."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, node (the same for equal words; null without words), a mark of the text as it
    stands and band keys of every row.

    node is a 64-bit hash: among n texts about n * n / 2**65 pairs share one by accident.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            nodes, keys = [], []
            for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist():
                found = describe(raw)
                nodes.append(found and found[0])
                keys.append(found and band_keys(found[2]).tolist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "node": pa.array(nodes, pa.int64()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return _marked(docs).mapInArrow(work, "doc_id long, mark long, node long, bands array<long>")


def _marked(docs: DataFrame) -> DataFrame:
    return rows.texts(docs).withColumn("mark", F.xxhash64("text"))


def _vectors(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, its multiset and signature for the wanted nodes; wanted has doc_id and mark of a
    text for each. So a row meets one node at most, whatever ids and copies there are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            out = []
            for node, raw in zip(batch.column("node").to_pylist(), pc.cast(batch.column("text"), pa.binary()).to_pylist()):
                found = describe(raw)
                if found and found[0] == node:  # another text may have the mark
                    out.append((node, found[1].tobytes(), found[2].tobytes()))
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["node", "multiset", "signature"])

    same = (F.col("d.mark") == F.col("w.mark")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    there = _marked(docs).alias("d").join(wanted.alias("w"), same).select("w.node", "d.text")
    return there.mapInArrow(work, "node long, multiset binary, signature binary").dropDuplicates(["node"])


def _verify(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b with their multisets x and y) that are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= LEAST for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(work, "a long, b long")


def _compare_block(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between members of one or two blocks of a bucket that are not in one class yet."""
    frame = frame.drop_duplicates("node").sort_values("node").reset_index(drop=True)
    nodes, blocks = frame["node"].to_numpy(), frame["block"].to_numpy()
    signed = np.stack([np.frombuffer(x, np.uint32) for x in frame["signature"]])
    sets = [np.frombuffer(x, np.uint64) for x in frame["multiset"]]
    sizes, roots = np.array([len(x) for x in sets]), frame["root"].to_numpy().copy()
    across = frame["i"].iloc[0] != frame["j"].iloc[0]
    links = []
    for k in range(len(frame) - 1):
        rest = slice(k + 1, None)
        near = (signed[rest] == signed[k]).mean(axis=1) >= LEAST_AGREEMENT
        near &= np.minimum(sizes[rest], sizes[k]) >= LEAST * np.maximum(sizes[rest], sizes[k])
        if across:
            near &= blocks[rest] != blocks[k]
        for other in (k + 1 + np.flatnonzero(near)).tolist():
            if roots[other] != roots[k] and similarity(sets[k], sets[other]) >= LEAST:
                links.append((nodes[k], nodes[other]))
                roots[roots == roots[other]] = roots[k]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _within_buckets(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Links inside buckets that hold several classes. members: key, node, root.

    A large bucket is dealt into blocks and every two blocks meet in a task.
    """
    open_keys = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = members.join(open_keys, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("key", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return paired.join(vectors, "node").groupBy("key", "i", "j").applyInPandas(_compare_block, "a long, b long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): doc_id and node of every row of docs; node and root of every node that
    has a link and is not the smallest of its class."""
    signed = stored(sign(docs), "signed")
    texts = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.first("bands").alias("bands"))
    keyed = texts.select("node", "at", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keyed.join(full, "key"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("central"), F.first("at").alias("at"))
    ranked = members.join(central.select("node", "central"), "node")
    centres = ranked.groupBy("key").agg(F.max(F.struct("central", "node")).getField("node").alias("centre"))
    vectors = stored(_vectors(docs, central.select("node", "at.doc_id", "at.mark")), "vectors")
    pairs = members.join(centres, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    first = vectors.select(F.col("node").alias("a"), F.col("multiset").alias("x"))
    second = vectors.select(F.col("node").alias("b"), F.col("multiset").alias("y"))
    links = stored(_verify(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")), "links")
    settled = components.roots(links)
    rooted = members.select("key", "node").join(settled, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    more = stored(_within_buckets(rooted, vectors.select("node", "multiset", "signature")), "links")
    if more.isEmpty():
        return signed.select("doc_id", "node"), settled
    return signed.select("doc_id", "node"), components.roots(settled.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _rooted(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with words and their root; rows without words are left out."""
    return signed.where("node is not null").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size of every row.

    A class holds what is linked, directly or by way of others, by a similarity of 0.8 or
    more; texts with equal words (case of A-Z and white space aside) are one. A row without
    words (null, empty, blank) is a class of its own. Nulls in doc_id come last: a class of
    nulls only has a null class_id.
    """
    signed, roots = classes(docs)
    rooted = _rooted(signed, roots)
    sized = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return rooted.join(sized, "root").select("doc_id", "class_id", "class_size").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns of docs: that with the smallest doc_id (nulls
    last), then the smallest hash of its words. Rows without words all stay."""
    signed, roots = classes(docs)
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    best = _rooted(signed, roots).groupBy("root").agg(F.min(ranked).alias("best")).select("best.doc_id", "best.node")
    times = signed.where("node is not null").groupBy("doc_id", "node").agg(F.count("*").alias("times"))
    best = best.alias("b").join(times.alias("t"), (F.col("b.node") == F.col("t.node")) & F.col("b.doc_id").eqNullSafe(F.col("t.doc_id"))).select("b.doc_id", "b.node", "times")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            raws = pc.cast(pc.struct_field(row, row.type.get_field_index("text")), pa.binary()).to_pylist()
            split = [raw.lower().split() if raw else [] for raw in raws]
            nodes = [xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None for words in split]
            yield pa.RecordBatch.from_arrays([row, pa.array(nodes, pa.int64())], names=["row", "node"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    hashed = whole.withColumn("node", F.lit(None).cast("long"))
    hashed = whole.mapInArrow(work, hashed.schema)
    found = hashed.alias("h").join(best.alias("b"), (F.col("h.node") == F.col("b.node")) & F.col("h.row.doc_id").eqNullSafe(F.col("b.doc_id"))).select("h.row", "h.node", "times")
    repeated = found.where("times > 1").withColumn("doc", F.col("row.doc_id")).dropDuplicates(["doc", "node"])
    return found.where("times = 1").select("row").unionByName(repeated.select("row")).unionByName(hashed.where("node is null").select("row")).select("row.*")
