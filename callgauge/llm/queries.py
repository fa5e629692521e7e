"""The operators of this package as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import bagminhash, bpe, cascade, collocations, ctw, fm, langid, licenses, pfor, prefixtrie, repeats, ruleensemble, sql, suffixes
from callgauge.llm.rows import remainder, table
from callgauge.sources.workspace import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op11_prefix_trie": sql.OP11, "op12_collocations": sql.OP12, "op13_repeated_passages": sql.OP13}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return bagminhash.duplicates(table(spark, sf_dir, "documents"))


@query
def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; a seventh of the documents teaches nothing."""
    scored = ctw.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    held_out = (remainder("doc_id", 7) == 2).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = suffixes.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        suffixes.hits().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        suffixes.contaminated().alias("contaminated"),
    )


@query
def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a third of the documents are never seen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = fm.fit(docs, labels, "toxic", remainder("doc_id", 3) != 1)
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    return fm.score(docs, machine).select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of a fifth of the documents are never seen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ensemble = ruleensemble.fit(docs, labels, "quality", remainder("doc_id", 5) != 0)
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return ruleensemble.score(docs, ensemble).select("doc_id", held_out, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_pfor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as shards and read back."""
    folder = run_folder(spark, "op6")
    pfor.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return pfor.read(spark, folder)


@query
def op7_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return cascade.measure(docs, cascade.plan(docs)).drop("rejected_by")  # which of two rules is named depends on times


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and tags of every document."""
    found = licenses.find(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op9_bigru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is held out."""
    docs = table(spark, sf_dir, "documents")
    network = langid.fit(docs, remainder("doc_id", 3) != 1)
    found = langid.predict(docs, network)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


#: Conversations that share an opening, and most turns of it.
FAMILY, HEADS = 20, 4


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each begun as the first of its family of twenty."""
    conv_id = F.col("conv_id")
    heads = (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")
    own = prefixtrie.turns(table(spark, sf_dir, "conversations"))
    return prefixtrie.trie(prefixtrie.rebuilt(own, conv_id - conv_id % FAMILY, heads, HEADS - 1))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


@query
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages that recur."""
    found = repeats.deduplicate(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
