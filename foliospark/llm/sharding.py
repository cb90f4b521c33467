"""Sharding by jump consistent hashing: key and shard count decide, no ring table is kept.

When the count grows from n to n + 1, a row either stays or moves into the new shard, with probability 1 / (n + 1).
The slot of a row is its place in its shard, gapless from 0. It is found without one task ever holding a shard: rows
are numbered inside (shard, block) groups of bounded size, and a small table of block counts gives each block's offset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

ROWS_PER_BLOCK = 50_000
FIXED_ROW_BYTES = 16


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard in [0, n_shards) of each 64-bit key; about ln(n_shards) vectorised rounds."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            shard[live] = jump[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[live] = ((shard[live] + 1) * step).astype(np.int64)
            live = live[jump[live] < n_shards]
    return shard.astype(np.int32)


def shard_of(key, n_shards: int):
    """Column of shard numbers for a column of 64-bit keys."""

    @F.pandas_udf(T.IntegerType())
    def shards(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), n_shards))

    return shards(key)


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    A null id has a key of its own (the hash seed) and so one shard; a null text has no bytes. Repeated rows share a
    shard and get slots of their own. Other columns are ignored. An empty table gives an empty result.
    """
    n_blocks = max(8, -(-docs.count() // (n_shards * rows_per_block)))
    text = text_of(text_col).cast("binary")
    key = F.xxhash64(F.col(id_col))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.length(text).cast("long") + FIXED_ROW_BYTES).alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, n_shards).alias("shard"),
        shard_of(key, n_shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(n_blocks)).cast("int").alias("block"),
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "block").orderBy("id", "size", "text_crc32")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(offsets, ["shard", "block"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("offset") + F.col("nth") - 1).alias("slot"),
            "grown_shard",
        )
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, id_col: str = "doc_id") -> None:
    """Write whole rows as Parquet below ``path``/shard=N; each shard is spread over several files."""
    docs.withColumn("shard", shard_of(F.xxhash64(F.col(id_col)), n_shards)).repartition(F.col("shard"), F.pmod(F.xxhash64(F.lit(1), F.col(id_col)), F.lit(8))).write.partitionBy("shard").parquet(path)
