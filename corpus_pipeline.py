"""Corpus pipeline: quality, cross-site lines, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents`` and
work on all that the stage before kept. Every stage takes null, empty and very long texts, repeated rows, empty tables
and extra columns as its operator does; extra columns are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from foliospark.llm.common import load, materialize


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on a bounded sample of these documents and their labels."""
    return quality.keep_good(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def single_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated cross-site lines; a line's first occurrence stays. No document is dropped."""
    cut = line_dedup.dedup_lines(docs)
    return with_size(cut.drop("__removed"), docs)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly benchmark text are dropped."""
    return with_size(decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the hashes of ids and decoded bytes, of each document."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def with_size(changed: DataFrame, like: DataFrame) -> DataFrame:
    """n_chars follows the text; columns are those of ``like``, in order."""
    from pyspark.sql import functions as F

    if "n_chars" in like.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return changed.select(*[f"`{c}`" for c in like.columns])


STAGES = [
    ("quality classifier", good_text),
    ("line dedup", single_lines),
    ("n-gram Jaccard join", one_of_a_kind),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]

#: The classifier and the merges have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each returns is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
