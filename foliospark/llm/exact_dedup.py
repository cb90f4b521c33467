"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. Each text becomes its SHA-256; (id, row number, digest) is written once, so the texts are read a single time.
2. A Misra-Gries pass (``freqItems``: mergeable counters, at most 1 / ``support`` of them) names every digest that can
   hold more than ``support`` of the rows. Partial counters merge in a shuffle of a few kilobytes per task.
3. Candidates are verified: exact count and surviving row, by a map-side join and a combined aggregation.
   Those over the threshold are the winners, at most 1 / ``support`` rows, hence broadcast.
4. Rows of winners are answered on the map side. The others are counted by a combined aggregation, whose result is
   joined back by digest: no group is gathered anywhere, and no remaining digest has more than ``support`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, text_of

SUPPORT = 1 / 500


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; null counts as empty, so null and empty texts form one group. The row with the
    largest id stays. A null id is smaller than any other. Of rows that repeat id and text exactly one stays, the
    others have kept = false and the same keep_id. Other columns are ignored, whatever their names. An empty table
    gives an empty result. Texts of any length become one digest.
    """
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),  # fixed by the write below; tells repeated rows apart
        F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("digest"),
    )
    keyed = materialize(keyed, "exact-digests")
    total = keyed.count()

    group = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("keep")]
    candidates = (
        keyed.select(F.base64("digest").alias("d"))
        .stat.freqItems(["d"], support)
        .select(F.explode("d_freqItems").alias("d"))
        .select(F.unbase64("d").alias("digest"))
    )
    winners = keyed.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*group).where(F.col("group_size") > total * support)
    winners = F.broadcast(materialize(winners, "exact-winners"))

    others = keyed.join(winners.select("digest"), "digest", "left_anti")
    rest = others.join(others.groupBy("digest").agg(*group), "digest").select("id", "row", "digest", "group_size", "keep")
    both = keyed.join(winners, "digest").select("id", "row", "digest", "group_size", "keep").unionByName(rest)
    return both.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("keep.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row of each text, with all its columns: a row of the largest id.

    Of rows that repeat id and text one stays, whichever; only such rows are shuffled whole. Null and empty texts are one text,
    null ids are smaller than any other. Columns named like the helpers are not touched. An empty table stays empty.
    """
    own, digest, many = fresh(docs.columns, "__id", "__digest", "__many")
    found = exact_dedup(docs, id_col, text_col, support)
    stay = found.groupBy(F.col(id_col).alias(own), F.col("text_sha256").alias(digest)).agg(F.max("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias(many)).where("kept").drop("kept")
    stay = materialize(stay, "exact-stay")
    hashed = F.sha2(text_of(text_col).cast("binary"), 256)
    joined = docs.join(stay, F.col(id_col).eqNullSafe(F.col(own)) & (hashed == F.col(digest)))
    once = joined.where(F.col(many)).dropDuplicates([own, digest])
    return joined.where(~F.col(many)).unionByName(once).select(*docs.columns)
