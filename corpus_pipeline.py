"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next one. All but the last return the columns of docs.

Documents without a word, or with fewer than ten, go in the first stage, and with them null
and empty texts; without known languages the second keeps every text with a letter. A null
id is an id like others, the last of a class to be kept. Equal rows are one class, of which
one stays. Empty tables give an empty result, further columns of documents are carried on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callgauge.llm import bagminhash, bpe, cascade, langid, suffixes
from callgauge.llm.rows import remainder, table
from callgauge.sources.workspace import run_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return cascade.keep(docs, cascade.plan(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; two thirds of those with a known one teach."""
    return langid.keep(docs, langid.fit(docs, remainder("doc_id", 3) != 1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return bagminhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages make up less than a twentieth of."""
    return suffixes.remove(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded bytes."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]

#: Language ID and BPE can't be told in SQL; tests/llm/test_pipeline.py holds each stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what the last one wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = run_folder(spark, stage.__name__)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
