"""Trie of conversations that begin alike.

A turn is a 128-bit hash of its role and text. A conversation is the row of its turns; equal
ones are one row with a weight, counted before anything is shuffled by order. Rows are dealt
to shards by ranges, so a shard holds neighbours in the order of their turns. In a shard the
rows make a matrix of turn numbers, padded with zeros and cut into blocks of columns, which a
lexsort puts in order block by block. Marks say where a row differs from the one before it;
or-ed along the row they mark the rows in which a node begins, and reduceat sums up every
depth between those marks. All figures of a node are sums over its rows:

* words saved: words of all members below a depth, less the words in which each row differs
  from the one before it (those of every node once),
* leaves: rows that the next row does not go on,
* children: rows in which a node begins one turn deeper.

Only nodes that reach over the border of two shards have rows in both; their parts meet by a
hash of their turns. How much the rows on both sides of a border share is told to the shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgauge.sources.workspace import run_folder

WORD = r"[^\x20\x09-\x0D]+"
HASH_BYTES = 16
#: Turns by which rows are dealt to shards, bytes of rows in a shard, columns of a matrix.
DEALT_TURNS, SHARD_BYTES, BLOCK = 32, 16 << 20, 32
#: Ids of one ending that are put together before they meet the others.
CHUNK_BYTES = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: (hash, words) in order of the turn, no turn number first, equal
    numbers in order of their hashes. A null role or text is empty; rows without conv_id
    belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("told"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary")).alias("hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["hash"].alias("hash"), t["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Conversations whose first `heads` turns (at most `most`) are those of conversation `base`,
    none if there is none of that id."""
    first = own.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_first"))
    kept = own.withColumns({"_base": base, "_heads": heads}).join(first, "_base", "left")
    none = F.array().cast(own.schema["turns"].dataType)
    whole = F.concat(F.slice(F.coalesce("_first", none), F.lit(1), F.col("_heads")), F.slice("turns", F.col("_heads") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return kept.select("conv_id", whole.alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two rows have in common from the start."""
    most = min(len(a), len(b))
    same = np.frombuffer(a[:most], np.uint8) == np.frombuffer(b[:most], np.uint8)
    return (most if same.all() else int(same.argmin())) // HASH_BYTES


def _matrix(numbers: np.ndarray, first: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    """Turns begin to begin + BLOCK of some rows; zero where a row has ended."""
    column = begin + np.arange(min(BLOCK, int(sizes.max()) - begin))
    there = column < sizes[:, None]
    return np.where(there, numbers[np.where(there, first[:, None] + column, 0)], 0)


def ordered(numbers: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distinct rows in order. A row's turns are numbers from first[row], sizes[row] of them,
    1 or more. A block of columns is looked at for those rows alone that are equal so far."""
    order, group = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    active, begin = order, 0
    while len(active) and int(sizes[order[active]].max()) > begin:
        rows = order[active]
        matrix = _matrix(numbers, first[rows], sizes[rows], begin)
        inside = np.lexsort((*matrix.T[::-1], group[active]))
        order[active], matrix, own = rows[inside], matrix[inside], group[active]
        new = np.append(True, (matrix[1:] != matrix[:-1]).any(axis=1) | (own[1:] != own[:-1]))
        group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        active, begin = active[~(new & np.append(new[1:], True))], begin + BLOCK
    return order


def shared_turns(numbers: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By row, all in order: turns that it has in common with the row before it."""
    shared = np.zeros(len(sizes), np.int64)
    alive, begin = np.arange(1, len(sizes)), 0
    while len(alive) and int(sizes[alive].max()) > begin:
        longest = np.maximum(sizes[alive], sizes[alive - 1])
        alive = alive[longest > begin]
        both = np.stack([alive - 1, alive])
        matrix = _matrix(numbers, first[both].ravel(), sizes[both].ravel(), begin).reshape(2, len(alive), -1)
        changed = np.logical_or.accumulate(matrix[0] != matrix[1], axis=1)
        shared[alive] += (~changed).sum(axis=1)
        alive, begin = alive[~changed[:, -1]], begin + BLOCK
    return shared


NODE = "node string, depth long, conv_id long, parent_node string, parent_conv_id long, n_convs long, n_children long, n_leaves long, member_words long, new_words long, ends string"
NODE_SCHEMA = pa.schema(
    [(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (column.split() for column in NODE.split(", "))]
)


def shard_nodes(shard: pa.Table, before: int, after: int) -> Iterator[pa.Table]:
    """Nodes of the rows of a shard, a table for each depth.

    before and after: turns that the first row shares with the last one of the shard before,
    and the last one with the first one of the shard after; -1 where there is none. Nodes that
    reach over a border have their name in `node`, children of such nodes in `parent_node`.
    """
    keys = shard.column("key").to_pylist()
    sizes = np.array([len(k) // HASH_BYTES for k in keys])
    turn = np.frombuffer(b"".join(keys), f"S{HASH_BYTES}")
    numbers = np.unique(turn, return_inverse=True)[1] + 1 if len(turn) else np.zeros(1, np.int64)
    order = ordered(numbers, np.cumsum(sizes) - sizes, sizes)
    first, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    weight, conv = (shard.column(c).to_numpy()[order] for c in ("n", "conv_id"))
    shared = shared_turns(numbers, first, sizes)
    shared[0] = max(before, 0)
    leaf = (np.append(shared[1:], after) < sizes).astype(np.int64)
    words = np.append(np.concatenate([np.zeros(0, np.int64), *shard.column("words").to_pylist()]).astype(np.int64), 0)
    so_far = np.append(0, np.cumsum(words))
    last = len(keys) - 1
    rest = lambda rows, depth: so_far[first[rows] + sizes[rows]] - so_far[first[rows] + depth]  # noqa: E731  words after `depth` turns
    own = rest(np.arange(last + 1), shared)
    name = lambda row, depth: hashlib.md5(keys[order[row]][: HASH_BYTES * depth]).hexdigest()
    rows, above = np.arange(last + 1), None
    for depth in range(int(sizes.max()) + 1):
        rows = rows[sizes[rows] >= depth]
        new = shared[rows] < depth
        begins = new.copy()
        begins[0] = True
        at = np.flatnonzero(begins)
        deeper = (sizes[rows] > depth) & (shared[rows] <= depth)  # a child begins here
        start, count = rows[at], len(at)
        totals = [np.add.reduceat(x, at) for x in (weight[rows], deeper.astype(np.int64), leaf[rows])]
        totals.append(np.add.reduceat(weight[rows] * rest(rows, max(depth - 1, 0)), at))
        totals.append(np.add.reduceat(np.where(new & (depth > 0), rest(rows, max(depth - 1, 0)), own[rows]), at))
        smallest = np.minimum.reduceat(conv[rows], at)
        node: list[str | None] = [None] * count
        if rows[0] == 0 and (before >= depth or depth == 0):
            node[0] = name(0, depth)
        if rows[-1] == last and (after >= depth or depth == 0):
            node[-1] = name(last, depth)
        parent_node, parent = [None] * count, np.zeros(count, np.int64)
        if above is not None:
            up = np.searchsorted(above[0], start, side="right") - 1
            parent, parent_node = above[1][up], [above[2][k] for k in up.tolist()]
        ends = [hashlib.md5(keys[order[row]]).hexdigest() if whole else None for row, whole in zip(start.tolist(), (sizes[start] == depth).tolist())]
        parents = pa.array(parent, pa.int64(), mask=np.array([depth == 0 or k is not None for k in parent_node], bool))
        yield pa.table([pa.array(node, pa.string()), pa.array(np.full(count, depth)), pa.array(smallest), pa.array(parent_node, pa.string()), parents, *map(pa.array, totals), pa.array(ends, pa.string())], schema=NODE_SCHEMA)
        above = (start, smallest, node)


def _borders(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """By shard: turns shared over its two borders, -1 where there is no shard."""
    edges = [(r["shard"], bytes(r["low"]), bytes(r["high"])) for r in rows.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("shard").collect()]
    over = [-1, *(_shared(a[2], b[1]) for a, b in zip(edges, edges[1:])), -1]
    return {edge[0]: (over[k], over[k + 1]) for k, edge in enumerate(edges)}


def _endings(sequences: DataFrame) -> DataFrame:
    """ends and ends_sha256: of the conversations that end in one node, the hash of their ids
    in order. Ids are joined to pieces by ranges of (node, id), so that one task reads no more
    than finished pieces of a node."""
    ids = sequences.select(F.md5("key").alias("ends"), "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, conv = batch.column("ends").to_pylist(), batch.column("conv_id").to_pylist()
            out: list[tuple[str, int, str]] = []
            start = 0
            for k in range(1, len(ends) + 1):
                if k == len(ends) or ends[k] != ends[start] or (k - start) * 20 >= CHUNK_BYTES:
                    out.append((ends[start], conv[start], ",".join(map(str, conv[start:k]))))
                    start = k
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))], names=["ends", "low", "ids"]) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], names=["ends", "low", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[str, str]] = []
            for ends, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist()):
                if ends != current:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = ends, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["ends", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], names=["ends", "ends_sha256"])

    pieces = ids.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(join, "ends string, low long, ids string")
    return pieces.repartition("ends").sortWithinPartitions("ends", "low").mapInArrow(digest, "ends string, ends_sha256 string")


def trie(sequences: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Nodes of the trie over sequences(conv_id, turns: array of (hash, words)).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 (the SHA-256 of the ids, in order, of the members without a
    further turn). The root has depth 0 and no parent. Each conv_id stands once; a sequence
    without turns belongs to the root alone. No sequences give no nodes. A conversation is one
    row, 24 bytes a turn.
    """
    spark, folder = sequences.sparkSession, run_folder(sequences.sparkSession, "trie")
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), "")).alias("key")
    sequences.select("conv_id", key, F.transform("turns", lambda t: t["words"]).alias("words")).write.parquet(f"{folder}/sequences")
    stored = spark.read.parquet(f"{folder}/sequences")
    distinct = stored.groupBy("key").agg(F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    size = stored.agg(F.sum(F.length("key") * 2 + 64)).first()[0] or 0
    shards = max(1, spark.sparkContext.defaultParallelism, -(-int(size) // shard_bytes))
    dealt = distinct.repartitionByRange(shards, F.substring("key", 1, DEALT_TURNS * HASH_BYTES))
    dealt.withColumn("shard", F.spark_partition_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    borders = _borders(rows)

    def nodes_of(shard: pa.Table) -> pa.Table:
        before, after = borders[shard.column("shard")[0].as_py()]
        return pa.concat_tables(shard_nodes(shard, before, after))

    rows.groupBy("shard").applyInArrow(nodes_of, NODE).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "member_words", "new_words")]
    over = nodes.where("node is not null").groupBy("node", "depth")
    over = over.agg(F.min("conv_id").alias("conv_id"), F.min("parent_node").alias("parent_node"), F.min("parent_conv_id").alias("parent_conv_id"), *sums, F.min("ends").alias("ends"))
    whole = nodes.where("node is null").unionByName(over)
    parents = over.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_parent"))
    met = whole.where("parent_node is not null").join(parents, "parent_node", "left").withColumn("parent_conv_id", F.col("_parent")).drop("_parent")
    whole = whole.where("parent_node is null").unionByName(met)
    ended = whole.where("ends is not null").join(_endings(stored), "ends", "left")
    whole = whole.where("ends is null").withColumn("ends_sha256", F.lit(NOTHING)).unionByName(ended)
    saved = (F.col("member_words") - F.col("new_words")).alias("saved_tokens")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, "ends_sha256")
