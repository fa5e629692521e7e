"""The corpus pipeline, stage by stage, against brute force on each stage's own input."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from llm import cases
from llm.test_bpe_pfor import THEIRS
from llm.test_filters import JUNK, contaminated_rows, marked, measured
from llm.test_models import classes, crowd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, with_langs=True):
    _, items = contaminated_rows()
    known = [(400 + k, cases.prose(30 + k % 40, ("aa", "bb")[k % 2], seed=400 + k)) for k in range(120)]
    stained = [(600 + k, cases.prose(10, seed=600 + k) + " " + items[0][1] + " " + cases.prose(20, seed=700 + k)) for k in range(3)]
    texts = [r for r in cases.ROWS if r[0] is not None] + JUNK + crowd(40) + known + stained + [(900, "1 2 3 4 5 6 7 8 9 10 11 12 13")]
    rows = [(d, t, ("bb" if t and "krüg" in t else "aa") if with_langs else None, "web", len(t or "")) for d, t in texts]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def pairs(frame) -> list[tuple]:
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("with_langs", [True, False])
def test_stages(spark, tmp_path, with_langs):
    path = str(tmp_path)
    items = tables(spark, path, with_langs)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = pairs(docs)
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{stage.__name__}")
        if stage is not corpus_pipeline.tokenize:
            assert out.columns == docs.columns, name
        docs = spark.read.parquet(f"{path}/{stage.__name__}")
    after = list(given.values())[1:]

    # Quality: what the base rule fails goes, the planted junk and the bare numbers; all prose stays.
    junk = {d for d, _ in JUNK} | {900}
    assert after[0] == [(d, t) for d, t in given["quality rules"] if not measured(t)[-1] and d not in junk]
    # Language: only texts without a letter go.
    assert after[1] == [(d, t) for d, t in given["language ID"] if any(map(str.isalpha, t))]
    # Near-dedup: of all classes by all pairs one row with the smallest id.
    own = classes(given["MinHash near-dedup"])
    best: dict[int, int] = {}
    for (d, _), k in zip(given["MinHash near-dedup"], own):
        best[k] = min(d, best.get(k, d))
    assert sorted(d for d, _ in after[2]) == sorted(best.values()) and set(after[2]) <= set(given["MinHash near-dedup"])
    assert len(after[2]) < len(after[1])
    # Decontamination.
    bad = [row[-1] for _, t in given["benchmark decontamination"] for row in marked([(0, t)], items)]
    assert after[3] == [row for row, is_bad in zip(given["benchmark decontamination"], bad) if not is_bad] and any(bad)
    # BPE.
    want = [(d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in given["byte-level BPE"] for ids in [THEIRS.encode_ordinary(t)]]
    assert cases.rows_of(docs, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    # The whole run.
    assert pairs_of_run(spark, path) == pairs_of(docs)


def pairs_of(frame):
    return cases.rows_of(frame, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def pairs_of_run(spark, path):
    return pairs_of(corpus_pipeline.run(spark, path))


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
