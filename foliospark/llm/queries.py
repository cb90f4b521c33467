"""The queries of this subpackage with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, decontaminate, exact_dedup, licences, line_dedup, ngram_join, quality, sharding, substring_dedup, toxicity
from .common import fold, load, text_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scorer = quality.train(docs, load(spark, sf_dir, "labels"))
    return judged(quality.score(docs, scorer), quality.FOLDS, quality.HELD_OUT, 0.5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return judged(toxicity.score(docs, model), toxicity.FOLDS, toxicity.HELD_OUT, 0.3)


def judged(scored: DataFrame, folds: int, held_out: int, least: float) -> DataFrame:
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(load(spark, sf_dir, "documents").withColumn("__lines", F.size(F.split(text_of(), "\n"))))
    return cut.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.cut_repeats(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(load(spark, sf_dir, "documents"))


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["last"] - h["first"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_quality": op1_quality,
        "op2_toxicity": op2_toxicity,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_line_dedup": op4_line_dedup,
        "op6_licence_scan": op6_licence_scan,
        "op5_exact_dedup": op5_exact_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_jump_sharding": op9_jump_sharding,
        "op10_decontaminate": op10_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op10_decontaminate": OP10_SQL}


OP4_SQL = r"""
WITH line AS (
  SELECT doc_id, source, k - 1 AS pos, l[k] AS line
  FROM (SELECT doc_id, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(k)),
spread AS (SELECT line, min((doc_id, pos)) AS first FROM line WHERE trim(line) != '' GROUP BY line HAVING count(DISTINCT source) >= 8),
marked AS (SELECT line.*, spread.first IS NOT NULL AND (doc_id, pos) != spread.first AS gone FROM line LEFT JOIN spread USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP10_SQL = r"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(k) WHERE len(w) > 0),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS (
  SELECT doc_id, k, s.size, windows.item_id
  FROM (SELECT DISTINCT size FROM windows) s, doc, unnest(range(1, len(w) - s.size + 2)) AS r(k)
  JOIN windows ON windows.size = s.size AND windows.g = array_to_string(w[k : k + s.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(k, k + size)) AS r(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
