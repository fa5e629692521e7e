"""Near-duplicates, language-model scores and classifiers against brute force."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm import cases
from pyspark.sql import functions as F

from callgauge.llm import bagminhash, components, ctw, fm, langid, ruleensemble
from callgauge.llm import labels as labelling
from callgauge.llm.rows import remainder


def multiset(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else None


def classes(rows):
    """Numbers of the class of each row, by comparing all pairs."""
    sets, own = [multiset(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and own[i] != own[j]:
                both = sum((a & b).values())
                if both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                    old, new = own[i], own[j]
                    own = [new if x == old else x for x in own]
    return own


def crowd(n=160, seed=4):
    """Copies of one text with up to eight of 120 words changed: many pairs are near, many aren't."""
    draw, base = random.Random(seed), cases.prose(120, seed=60).split()
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(draw.randint(0, 8)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        out.append((1000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("block", [16, 256])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    rows = [r for r in cases.ROWS if r[0] is not None] + crowd() + [(50, "WORT"), (51, "wort  wort"), (52, "lado " * 40), (53, "lado " * 41), (54, "lado " * 90)]
    found = bagminhash.duplicates(spark.createDataFrame(rows, cases.SCHEMA))
    members = defaultdict(list)
    for (doc_id, _), own in zip(rows, classes(rows)):
        members[own].append(doc_id)
    expected = [(d, min(m), len(m)) for m in members.values() for d in m]
    assert cases.rows_of(found, "doc_id", "class_id", "class_size") == sorted(expected, key=str)


def test_one_row_of_each_class(spark):
    docs = cases.clashing(spark)
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert cases.rows_of(kept, "doc_id", "text") == sorted(set(cases.ROWS) - {(9, cases.ROWS[-1][1])}, key=str)
    assert bagminhash.duplicates(docs).count() == len(cases.ROWS)
    assert bagminhash.keep_one(cases.empty(spark)).count() == 0
    assert bagminhash.duplicates(cases.empty(spark)).count() == 0


def test_agreement_is_weighted_jaccard():
    draw, errors = np.random.default_rng(1), []
    for n in [1, 3, 10, 60, 300] * 30:
        hashes, a = draw.integers(0, 2**63, n).astype(np.uint64), draw.integers(1, 12, n)
        b = np.where(draw.random(n) < 0.6, a, draw.integers(1, 12, n))
        truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((bagminhash.signature(hashes, a) == bagminhash.signature(hashes, b)).mean() - truth)
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}


def test_base_scores(spark):
    rows = cases.ROWS + [(200 + k, f"Mira lado {k % 3}\nvel") for k in range(40)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    out = lambda d: zlib.crc32((str(d) if d is not None else "").encode()) % 7 == 2
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, (_, t) in enumerate(rows)}
    count = Counter(w for i, (d, _) in enumerate(rows) if not out(d) for w in tokens[i])
    total, kinds, expected = sum(count.values()), len(count), []
    for i, (d, _) in enumerate(rows):
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens[i])
        expected.append((d, len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), total, round(base, 6)))
    found = ctw.score(docs, remainder("doc_id", 7) != 2).withColumn("base", F.round("base_score", 6))
    assert cases.rows_of(found, "doc_id", "n_tokens", "n_known", "train_tokens", "base") == sorted(expected, key=str)
    nothing = ctw.score(cases.frame(spark), F.lit(False)).where("doc_id = 3").first()
    assert (nothing["train_tokens"], nothing["n_known"], nothing["base_score"]) == (0, 0, 0) and nothing["score"] == pytest.approx(-math.log10(256))
    assert ctw.score(cases.empty(spark), F.lit(True)).count() == 0


def weighted(texts, depth, order):
    """Context-tree weighting by its recursion, in logs, for every binary node of every context;
    returns a function from (context, byte) to its probability. All seen contexts are kept."""
    seen = defaultdict(Counter)
    for raw in texts:
        data = b"\xff" * depth + raw + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                seen[data[i - d : i]][data[i]] += 1

    def pair(context, node):
        level = node.bit_length() - 1
        zeros = ones = 0
        for byte, n in seen[context].items():
            if (byte | 256) >> (8 - level) == node:
                if byte >> (7 - level) & 1:
                    ones += n
                else:
                    zeros += n
        return zeros, ones

    def log_kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)

    def below(context):
        return [c for c in seen if len(c) == len(context) + 1 and c[1:] == context] if len(context) < depth else []

    def log_weighted(context, node):
        own = log_kt(*pair(context, node))
        children = below(context)
        return np.logaddexp(own, sum(log_weighted(c, node) for c in children)) + math.log(0.5) if children else own

    def one(context, node, d=0):
        own = context[len(context) - d :]
        zeros, ones = pair(own, node)
        mine = (ones + 0.5) / (zeros + ones + 1)
        if not below(own):
            return mine
        stop = math.exp(math.log(0.5) + log_kt(zeros, ones) - log_weighted(own, node))
        longer = context[len(context) - d - 1 :]
        return stop * mine + (1 - stop) * (one(context, node, d + 1) if longer in seen else 0.5)

    def told(context, byte):
        p, node = 1.0, 1
        for k in range(7, -1, -1):
            q = one(context, node)
            bit = byte >> k & 1
            p *= q if bit else 1 - q
            node = 2 * node + bit
        return p

    return told


def test_weights_are_those_of_the_recursion(monkeypatch):
    monkeypatch.setattr(ctw, "DEPTH", 2)
    texts = [b"abracadabra", b"abab", b"", b"cab dab"]
    keys, n = np.unique(ctw.grams(texts), return_counts=True)
    contexts, cells = [], []
    for depth in range(3):
        own = (keys >> 8) & ((1 << 8 * depth) - 1)
        contexts.append(np.unique(own))
        cells.append((own, keys & 255, n))
    model, told = ctw.weigh(contexts, cells), weighted(texts, 2, 0)
    for raw in (b"abra", b"dcz", b""):
        data = b"\xff\xff" + raw + b"\xff"
        expected = sum(math.log10(told(data[i - 2 : i], data[i])) for i in range(2, len(data)))
        assert model.log10([raw])[0] == pytest.approx(expected, rel=1e-4)
    assert (10.0 ** model.told.astype(float)).sum(axis=1) == pytest.approx(np.ones(len(model.told)), abs=1e-4)


@pytest.mark.parametrize("share", [2.0**-20, 1.0])
def test_rare_contexts_teach(spark, monkeypatch, share):
    """Every training context is in the tree, however small its share of the bytes."""
    monkeypatch.setattr(ctw, "GRAM_SHARE", share)
    rows = [(k, cases.prose(150, seed=k)) for k in range(70)] + [(k, "Zyx#9 qqW~ zyx#9") for k in (70, 71, 72, 73)] + [(80, "zyx#9 wzz"), (81, None), (81, "")]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    texts = [(t or "").encode().lower() for d, t in rows if d < 72]
    assert 2 / sum(len(t) + 1 for t in texts) < 2.0**-16 and len(texts) == 72
    keys, n = np.unique(ctw.grams(texts), return_counts=True)
    contexts, cells = [], []
    for depth in range(ctw.DEPTH + 1):
        own = (keys >> 8) & ((1 << 8 * depth) - 1)
        contexts.append(np.unique(own))
        cells.append((own, keys & 255, n))
    model = ctw.weigh(contexts, cells)
    expected = [(d, s) for (d, _), s in zip(rows, model.log10([(t or "").encode().lower() for _, t in rows]).tolist())]
    found = [(r["doc_id"], r["score"]) for r in ctw.score(docs, F.col("doc_id") < 72).orderBy("doc_id").collect()]
    assert [d for d, _ in found] == [d for d, _ in expected]
    assert [s for _, s in found] == pytest.approx([s for _, s in expected], rel=1e-4)


def test_gradients_are_the_slopes():
    network = langid.Network(["aa", "bb"], hidden=3)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    data = np.concatenate([langid.windows(b"abcde fgh"), langid.windows(b"xyz")])[:, :12]
    labels = np.array([0, 1])
    _, grads = network.gradients(data, labels)
    draw = np.random.default_rng(0)
    for name, w in network.weights.items():
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in w.shape) if name[0] != "x" else (int(draw.choice([97, 98, 120, 32])), int(draw.integers(w.shape[1])))
            old = w[at]
            w[at] = old + 1e-2
            up = network.gradients(data, labels)[0]
            w[at] = old - 1e-2
            down = network.gradients(data, labels)[0]
            w[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


@pytest.fixture(scope="module")
def two_languages(spark):
    rows = [(k, cases.prose(3 + k % 60, ("aa", "bb")[k % 2], seed=k), ("aa", "bb")[k % 2]) for k in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_held_out_documents(spark, two_languages):
    network = langid.fit(two_languages, remainder("doc_id", 3) != 1)
    found = langid.predict(two_languages, network).join(two_languages.select("doc_id", "lang"), "doc_id").where(remainder("doc_id", 3) == 1)
    assert found.where("lang_pred = lang").count() > 0.97 * found.count()
    edge = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(cases.frame(spark), network).collect()}
    assert edge[2] == edge[3] == edge[4] == ("und", 0.0) and edge[5][0] == "aa" and 0 < edge[5][1] <= 1
    wide = cases.clashing(spark)
    kept = langid.keep(wide, network)
    assert kept.columns == wide.columns and {1, 5, 7, 9} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (2, 3, 4)").count() == 0
    said = langid.position_labels(network, cases.prose(8, "bb", seed=77))
    assert Counter(said).most_common(1)[0][0] == "bb" and len(said) == len(cases.prose(8, "bb", seed=77).lower().encode())
    assert langid.predict(cases.empty(spark), network).count() == 0


def test_no_language_to_learn(spark):
    docs = cases.frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(docs, F.lit(True)) is None
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, None).collect()} == {("und", 0.0)}


def labelled(spark, make, n=500):
    rows = [(k, *make(k)) for k in range(n)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], cases.SCHEMA)
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows] + [(10**6, None)], "doc_id long, y int")


def test_pairs_of_terms_count(spark):
    """Neither word alone is bad, only both together: an additive model can't tell."""

    def make(k):
        words = cases.prose(20, seed=k).split()
        if k % 4 in (1, 3):
            words.insert(k % 20, "grob")
        if k % 4 in (2, 3):
            words.insert(k % 7, "leute")
        return " ".join(words), int(k % 4 == 3)

    docs, labels = labelled(spark, make, 900)
    machine = fm.fit(docs, labels, "y", remainder("doc_id", 3) != 1)
    found = fm.score(docs, machine).join(labels, "doc_id").where(remainder("doc_id", 3) == 1)
    assert found.where("(score >= 0.5) = (y = 1)").count() > 0.97 * found.count()
    assert fm.score(cases.clashing(spark), machine).where("score between 0 and 1").count() == len(cases.ROWS)
    assert fm.score(cases.empty(spark), machine).count() == 0


def test_rules_of_held_out_documents(spark):
    def make(k):
        text = cases.prose(5 + k % 40, seed=k)
        return (text.upper(), 0) if k % 5 == 0 else (text.replace(" ", " ### "), 0) if k % 5 == 1 else (text, 1)

    docs, labels = labelled(spark, make)
    ensemble = ruleensemble.fit(docs, labels, "y", remainder("doc_id", 5) != 0)
    scored = ruleensemble.score(docs, ensemble)
    assert "PythonUDF" not in scored._jdf.queryExecution().toString()
    found = scored.join(labels, "doc_id").where(remainder("doc_id", 5) == 0)
    assert found.where("(score >= 0.3) = (y = 1)").count() > 0.97 * found.count()
    assert 0 < len(ensemble.rules) < 200 and len(ensemble.text()) == len(ensemble.rules)
    assert ruleensemble.score(cases.clashing(spark), ensemble).where("score between 0 and 1").count() == len(cases.ROWS)
    assert ruleensemble.score(cases.empty(spark), ensemble).count() == 0


@pytest.mark.parametrize("module", [fm, ruleensemble])
def test_no_labels_or_one_class(spark, module):
    docs = cases.frame(spark)
    none = spark.createDataFrame([], "doc_id long, y int")
    assert {round(r["score"], 3) for r in module.score(docs, module.fit(docs, none, "y", F.lit(True))).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (5, 1), (7, 0), (7, 1), (9, None)], "doc_id long, y int")
    assert {r["score"] > 0.9 for r in module.score(docs, module.fit(docs, ones, "y", F.lit(True))).collect()} == {True}


def test_one_row_of_a_drawn_document(spark):
    """However many rows a drawn doc_id has, the sample is bounded by doc_ids."""
    docs = spark.createDataFrame([(1, f"text {k % 3}") for k in range(300)] + [(2, "other"), (3, None)], cases.SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, y int")
    found = labelling.labelled(docs, labels, "y", F.lit(True), 10)
    assert found.columns == ["doc_id", "text", "y", "weight"]
    got = cases.rows_of(found, "doc_id", "y", "weight")
    assert got == [(1, 1, 1.0), (2, 0, 1.0), (3, 0, 1.0)]
    assert found.where("doc_id = 1 and text like 'text _' or doc_id = 2 and text = 'other' or doc_id = 3 and text is null").count() == 3


def test_any_number_of_languages(spark):
    """300 languages are all learned from; a row on very many rows is drawn once."""
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 12, f"l{k:03}") for k in range(300)] + [(1000, "same text", "l000")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = langid.sample(docs, F.lit(True))
    assert {lang for lang, _ in drawn} == {f"l{k:03}" for k in range(300)}
    assert sum(text == "same text" for _, text in drawn) == 1
    assert [round(langid.bar(n), 3) for n in (1, 2, 4, 300)] == [1.0, 0.667, 0.4, 0.007]


def test_without_a_network_texts_with_a_letter_stay(spark):
    docs = cases.clashing(spark)
    kept = langid.keep(docs, None)
    assert kept.columns == docs.columns
    assert cases.rows_of(kept, "doc_id", "text") == sorted((r for r in cases.ROWS if r[1] and any(map(str.isalpha, r[1]))), key=str)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_very_many_texts_of_one_id(spark, doc_id):
    """A row meets the node of its own text alone, so the join keeps the size of the table."""
    texts = [cases.prose(30, seed=k) for k in range(150)]
    docs = spark.createDataFrame([(doc_id, t) for t in texts for _ in range(2)] + [(doc_id, t + " more") for t in texts], cases.SCHEMA)
    signed = bagminhash.sign(docs)
    wanted = signed.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("at")).select("node", "at.doc_id", "at.mark")
    same = (F.col("d.mark") == F.col("w.mark")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    assert bagminhash._marked(docs).alias("d").join(wanted.alias("w"), same).count() == 450
    assert bagminhash._vectors(docs, wanted).count() == 300
    assert bagminhash.duplicates(docs).where("class_size = 3").count() == 450
    assert bagminhash.keep_one(docs).count() == 150


def test_counts_take_little_memory(spark):
    """4 MB of text at once: counts right, and arrays of a slice alone, not of the whole batch."""
    raw = np.random.default_rng(3).integers(97, 123, 1 << 22, dtype=np.uint8)
    raw[::7] = 32
    texts = [raw[at : at + (1 << 18)].tobytes().decode() for at in range(0, len(raw), 1 << 18)]

    class Docs:
        def mapInArrow(self, work, schema):
            self.work = work
            return self

        select = groupBy = agg = lambda self, *columns: self

    docs, batch = Docs(), pa.RecordBatch.from_pydict({"text": texts, "learn": [n % 4 > 0 for n in range(len(texts))]})
    ctw.counts(docs, F.lit(True))
    tracemalloc.start()
    parts = list(docs.work(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = {}
    for part in parts:
        for kind, n in zip(part.column("kind").to_pylist(), part.column("n").to_pylist()):
            found[kind] = found.get(kind, 0) + n
    assert found[ctw.GRAM] == sum(len(text) + 1 for n, text in enumerate(texts) if n % 4)
    assert found[ctw.OTHER] == sum(len(text) + 1 for n, text in enumerate(texts) if n % 4 == 0)
    assert found[ctw.WORD] == sum(len(text.split()) for n, text in enumerate(texts) if n % 4)
    print("peak", peak >> 20)
    assert peak < 200 << 20
