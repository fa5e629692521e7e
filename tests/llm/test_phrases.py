"""Prefix trie, collocations and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import check, twin
from pyspark.sql import functions as F

from callgauge.llm import bitfilter, collocations, prefixtrie, queries, repeats, rolling
from conftest import SMALL
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_collocations", "op13_repeated_passages"])
def test_query_equals_sql(spark, name):
    assert check(spark, twin(SMALL), name, queries.QUERIES[name], queries.SQL[name], SMALL) == []


# Fingerprints


def test_fingerprints_do_not_depend_on_the_place():
    texts = pa.array(["a bb  ccc a bb", None, "", "bb\tccc", "é\nbb"])
    w = rolling.words_of(texts, repeats.INSIDE)
    words = [texts[int(t)].as_py().encode()[a - b : c - b] for t, a, c, b in zip(w.text, w.starts, w.stops, np.cumsum([0, 14, 0, 0, 6])[w.text])]
    assert words == [b"a", b"bb", b"ccc", b"a", b"bb", b"bb", b"ccc", "é".encode(), b"bb"]
    assert (w.identities()[:, None] == w.identities()).tolist() == [[x == y for y in words] for x in words]
    two = rolling.windows(rolling.prefix(w.hashes), 2)
    assert two[0] == two[3] and two[1] == two[5] and len(set(two.tolist())) == 6
    sliced = rolling.words_of(pa.array(["x", "y z", "a bb"])[2:], repeats.INSIDE)
    assert sliced.hashes.tolist() == w.hashes[:2].tolist() and len(rolling.words_of(pa.array([], pa.string()), repeats.INSIDE)) == 0


def test_bloom_filters_lose_nothing(spark):
    keys = rolling.mix(np.arange(20_000, dtype=np.uint64))
    table = bitfilter.build(spark.createDataFrame([(int(k),) for k in rolling.signed(keys[:10_000])], "fp long"), bits=18)
    assert bitfilter.holds(table, keys[:10_000]).all() and bitfilter.holds(table, keys[10_000:]).mean() < 0.1


# Prefix trie


def trie_by_hand(rows):
    """Nodes of all prefixes, each counted by looking at every other."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest(), role, text))
    own = {conv: [(t[3], t[4]) for t in sorted(turns)] for conv, turns in own.items()}
    members = defaultdict(list)
    whole = {}
    for conv, turns in own.items():
        heads = zlib.crc32(str(conv).encode()) % 4
        whole[conv] = tuple(own.get(conv - conv % 20, [])[:heads] + turns[heads:])
        for depth in range(len(whole[conv]) + 1):
            members[whole[conv][:depth]].append(conv)
    out = []
    for node, convs in members.items():
        subtree = [p for p in members if p[: len(node)] == node]
        children = [p for p in subtree if len(p) == len(node) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in subtree) for p in subtree)
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in subtree if p)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string"


def trie_of(spark, rows, shard_bytes=prefixtrie.SHARD_BYTES, schema=TURNS, **more):
    table = spark.createDataFrame(rows, schema).withColumns(more)
    heads = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    found = prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns(table), F.col("conv_id") - F.col("conv_id") % 20, heads, 3), shard_bytes)
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("shard_bytes, block", [(prefixtrie.SHARD_BYTES, 32), (200, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, shard_bytes, block):
    """Also with shards that nearly every node reaches over."""
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    draw = random.Random(shard_bytes)
    rows = [(conv, turn, draw.choice("ua"), draw.choice(["so", "so it", "", None])) for conv in range(0, 120) for turn in range(draw.randint(1, 7))]
    rows += [(200 + k, turn, "u", "always the same") for k in range(40) for turn in range(9)]  # a large group of copies
    rows += [(300, turn, "u", f"turn {turn}") for turn in range(300)]  # a long one
    assert trie_of(spark, rows, shard_bytes) == trie_by_hand(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "u", "none"), (1, None, "u", "first"), (1, 0, None, None), (1, 0, None, None), (1, 5, "u", "b"), (1, 5, "u", "a"), (21, 0, "u", "x"), (40, 3, "", "x" * 100_000)]
    rows += [(c, 0, "u", "only") for c in (2, 3, 22, 41, 61)]  # some have no turn left
    assert trie_of(spark, rows, node=F.lit("x"), key=F.lit(1), words=F.lit(2), hash=F.lit(3)) == trie_by_hand(rows)
    assert trie_of(spark, []) == Counter()
    assert trie_of(spark, [(2, 0, "u", "only")]) == trie_by_hand([(2, 0, "u", "only")])


# Collocations


def phrases_by_hand(rows, least, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        longer = [b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if all(100 * b < 100 * a for b in longer):
            score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return {(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for k, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


TEXTS = "doc_id long, text string, lang string"


def phrase_rows():
    draw = random.Random(3)
    words = ["Of", "the", "corn", "é", "日本", "a\x1cb", "x"]
    rows = [(k, "".join(draw.choice(words) + draw.choice([" ", " ", "\t ", ". ", "\n"]) for _ in range(60)), draw.choice(["aa", "bb", None])) for k in range(40)]
    rows += [(None, "no id here of the", "aa"), (3, None, "aa"), (4, "", "bb"), (5, " \t,. ", None), (6, "the corn " * 2000, "und"), (6, "the corn " * 2000, "und")]
    return rows


@pytest.mark.parametrize("slice_bytes, weak", [(collocations.SLICE, False), (300, False), (2000, True)])
def test_collocations_equal_brute_force(spark, monkeypatch, slice_bytes, weak):
    """Also with texts over many slices, and with fingerprints that collide all the time."""
    rows = phrase_rows()
    found = [tuple(r)[:8] for r in collocations.mine(spark.createDataFrame(rows, TEXTS), least=12, slice_bytes=slice_bytes).collect()] if not weak else []
    if weak:
        mixed = rolling.mix
        monkeypatch.setattr(rolling, "mix", lambda x: mixed(x) % np.uint64(5))
        lang = np.array([hash(r[2]) for r in rows], np.int64).view(np.uint64)
        part = collocations.Slice(pa.array([r[1] for r in rows]), lang)
        ids, counted = part.words.identities(collocations.LOWER_BYTES), Counter()
        for size in (1, 2, 3):
            at, fp = part.candidates(size, [])
            rep, n = part.phrases(size, at, fp, ids)
            counted.update({(int(part.lang[r]), p): int(c) for r, p, c in zip(rep, part.read(size, rep), n)})
        monkeypatch.setattr(rolling, "mix", mixed)
        part = collocations.Slice(pa.array([r[1] for r in rows]), lang)
        exact = Counter()
        for size in (1, 2, 3):
            at = np.flatnonzero(part.left >= size)
            exact.update((int(part.lang[r]), p) for r, p in zip(at, part.read(size, at)))
        assert counted == exact
    else:
        assert len(found) == len(set(found)) and set(found) == phrases_by_hand(rows, 12)


def test_collocations_of_odd_tables(spark):
    assert collocations.mine(spark.createDataFrame([], TEXTS)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "of the", "aa")], TEXTS)).count() == 0
    rows = [(k, "of the corn", "aa") for k in range(5)]
    clash = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("x") for c in ("code", "phrase", "n", "k", "f", "word", "rank", "score", "a", "l", "r")})
    assert [tuple(r) for r in collocations.mine(clash, least=5).collect()] == [("aa", 1, "of the corn", 5, 5, 5, 15, 3000, 0, 0)]
    without = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert [r.lang for r in collocations.mine(without, least=5).collect()] == ["und"]


def test_scores_are_exact_beyond_64_bits(spark):
    numbers = [(10**15 + 7, 10**16 + 9, 10**15 + 8, 10**15 + 9), (3, 7, 2, 5), (100, 10**16, 100, 100)]
    table = spark.createDataFrame(numbers, "a long, n long, l long, r long")
    found = table.select("*", collocations.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in found)


def test_only_the_best_phrases_are_kept(spark):
    rows = [(k, f"w{k % 7} v{k % 7}", "aa") for k in range(70)]
    found = collocations.mine(spark.createDataFrame(rows, TEXTS), least=2, top=3).orderBy("rank").collect()
    assert [(r.rank, r.phrase) for r in found] == [(1, "w0 v0"), (2, "w1 v1"), (3, "w2 v2")]


# Repeated passages


def kept_by_hand(rows, window):
    starts = Counter()
    split = [(doc, WORD.findall(text or "")) for doc, text in rows]
    for _, words in split:
        starts.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    out = []
    for doc, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if starts[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def deduplicated(spark, docs, **options):
    found = repeats.deduplicate(docs, **options).collect()
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in found)
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in found)


def test_passages_of_odd_rows(spark):
    rows = cases.ROWS + [(20, "so " * 100), (21, cases.prose(34, seed=9)), (22, cases.prose(34, seed=9)), (23, cases.prose(80, seed=9)), (24, "x " + cases.prose(70, seed=9))]
    assert deduplicated(spark, spark.createDataFrame(rows, cases.SCHEMA)) == kept_by_hand(rows, 35)
    assert deduplicated(spark, cases.clashing(spark)) == kept_by_hand(cases.ROWS, 35)
    assert deduplicated(spark, cases.empty(spark)) == Counter()


@pytest.mark.parametrize("window, anchor, words, shard", [(7, 3, 4, 50), (5, 5, 3, 20), (9, 1, 30, repeats.SHARD)])
def test_passages_equal_brute_force(spark, window, anchor, words, shard):
    """Few different words, so that passages overlap and repeat within texts; split shards."""
    draw = random.Random(window)
    shared = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(3, 25))) for _ in range(8)]
    rows = []
    for k in range(150):
        parts = [draw.choice(shared) if draw.random() < 0.4 else " ".join(str(draw.randrange(words)) for _ in range(9)) for _ in range(draw.randint(1, 6))]
        rows.append((k, draw.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(200 + k, shared[0] + " " + shared[0] + f" {k}") for k in range(100)]  # a passage in a third of the texts
    for slice_bytes in (400, repeats.SLICE):
        docs = spark.createDataFrame(rows, cases.SCHEMA)
        assert deduplicated(spark, docs, window=window, anchor=anchor, shard=shard, slice_bytes=slice_bytes) == kept_by_hand(rows, window)


def test_a_shard_holds_little_at_a_time(spark, monkeypatch):
    """Copies and one text that goes on and on: shards are split, and texts go by a few at a time."""
    monkeypatch.setattr(repeats, "STREAM", 40)
    monkeypatch.setattr(rolling, "TOGETHER", 7)
    seen = []
    hits = repeats._hits
    monkeypatch.setattr(repeats, "_hits", lambda automaton, stream, first: seen.append(len(stream)) or hits(automaton, stream, first))
    texts = ["a b c d e f g h i j " * 30] + ["k l m n o p q r s t u"] * 40 + [f"{n} k l m n o p q r s t" for n in range(40)]
    keyed = repeats._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    table = pa.concat_tables([keyed.drop("doc_id").withColumn("a", F.lit(1).cast("long")).withColumn("start", F.lit(0).cast("long")).toArrow()] * 3)
    slices = repeats.Slice(table.column("text").combine_chunks(), 7, 3)
    fp, n = np.unique(slices.fp, return_counts=True)
    confirmed = pa.table({"a": np.ones(len(fp), np.int64), "fp": rolling.signed(fp)}).filter(pa.array(n > 1))
    found = repeats._locate(table, confirmed, 7)
    assert max(seen) < 40 + 301 and sum(seen) == 301 + 12 + 40 * 12  # each distinct text once
    per_text = Counter(found.column("k1").to_pylist())
    assert len(per_text) == 42


def test_split_shards_deal_one_text_to_several_parts(spark):
    rows = [(1, "a b c d e f g h i j " * 300), (2, "x a b c d e f g h i j y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduplicated(spark, docs, window=7, anchor=3, shard=10) == kept_by_hand(rows, 7)


def test_phrases_are_handed_on_once_a_core(spark):
    """However many parts the texts come in, a frequent phrase makes a row a core at most."""
    docs = spark.createDataFrame([(n, "one two three.", "aa") for n in range(200)], "doc_id long, text string, lang string").repartition(40)
    every = np.full(1, -1, np.int64).view(np.uint64).repeat(1 << 10)
    filters = [spark.sparkContext.broadcast(every) for _ in range(collocations.COUNTED)]
    found = collocations._materialise(collocations._texts(docs), filters, 2, collocations.SLICE)
    rows = {(r.k, bytes(r.phrase)): (r.rows, r.f) for r in found.groupBy("k", "phrase").agg(F.count("*").alias("rows"), F.sum("n").alias("f")).collect()}
    assert rows[2, b"one two"][1] == 200 and rows[0, b""][1] == 600
    assert max(n for n, _ in rows.values()) <= spark.sparkContext.defaultParallelism
