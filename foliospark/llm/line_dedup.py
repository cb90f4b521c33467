"""Cross-site line deduplication by distinct-site spread, in DataFrame operations only.

Each line is known by two 64-bit hashes. A HyperLogLog sketch of the sites of each line is built map-side and merged by
aggregation, so a line that holds a third of all rows travels as one small sketch per task. Estimates far below the
threshold are settled, and so are those far above; lines within ``BAND`` standard errors of it get an exact
count of distinct sites. A line that spreads over ``min_sites`` sites or more is boilerplate: its first occurrence stays
(smallest document id, then position), all others go.

The boilerplate is cut where the lines are read: while its table stays within ``MOST_TABLE`` bytes it is a hash table of
buckets that every task gets once, and no text is shuffled. A larger table is joined with the lines, salted as one line
may be a third of them, and the positions found are joined with the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, text_of, union_all

MIN_SITES = 8
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)
BAND = 4
#: Bytes of the table of boilerplate lines that goes to every task, and those of a line in it besides its document's id.
MOST_TABLE, ROW_BYTES = 16_000_000, 80
#: Lines of a bucket of that table, on average.
BUCKET = 4
SALTS = 8


def line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def exploded_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc, t1 (hash of the whole text), pos, h1, h2, site of each line that is not blank; a null site is a site of its own."""
    text = text_of(text_col)
    return (
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t1"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .where(F.trim("line") != "")
        .select("doc", "t1", "pos", "site", *line_hashes(F.col("line")))
    )


def fits(table: DataFrame, id_col: str) -> bool:
    """Whether lines with the id of their first document stay within MOST_TABLE bytes."""
    size = F.sum(F.coalesce(F.octet_length(F.col(id_col).cast("string")), F.lit(0)) + ROW_BYTES)
    return table.agg(F.coalesce(size, F.lit(0))).first()[0] <= MOST_TABLE


def met(lines: DataFrame, table: DataFrame) -> DataFrame:
    """Lines joined with the rows of ``table`` (h1, h2, first); a line may be in very many rows of ``lines``."""
    if fits(table, "first.doc"):
        return lines.join(F.broadcast(table), ["h1", "h2"])
    salted = table.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"]).drop("salt")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2, first of the lines on at least ``min_sites`` distinct sites; first is the occurrence that stays."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc", "pos", "t1")).alias("first"))
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sketch")).drop("sketch").where(F.col("sites") >= min_sites * (1 - BAND * ERROR) - 1)
    spread = materialize(spread, "line-spread")
    sure = F.col("sites") > min_sites * (1 + BAND * ERROR) + 1
    near = spread.where(~sure).select("h1", "h2", "first")
    exact = (
        met(lines, near)
        .groupBy("h1", "h2", "site")
        .agg(F.lit(1).alias("one"))  # distinct sites, combined before the shuffle
        .groupBy("h1", "h2")
        .agg(F.count("one").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    found = materialize(union_all([spread.where(sure).select("h1", "h2", "first"), near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")]), "line-boilerplate")
    discard(spread)
    return found


def buckets(table: DataFrame, n: int) -> DataFrame:
    """One row with ``n`` arrays, the lines of each hash value, as a scalar subquery takes it."""
    own = table.groupBy(F.pmod("h1", F.lit(n)).alias("b")).agg(F.collect_list(F.struct("h1", "h2", "first")).alias("held"))
    every = table.sparkSession.range(n).withColumnRenamed("id", "b").join(own, "b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", F.coalesce("held", F.array().cast(own.schema["held"].dataType)).alias("held")))), lambda x: x["held"]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """All rows and columns of ``docs`` with repeated cross-site lines cut from the text, and __removed array<int>, the positions, last.

    Lines end at a newline; blank lines stay and count nowhere. A null text stays null, an empty one empty; very long
    texts are cut whole, a line of any length is known by its hashes. A null site is a site of its own, so is none. A null id
    sorts before all others. Ties of the least id go by position, then by the hash of the text; rows that repeat id and text
    are treated alike. An empty table gives an empty result. Columns named like the helper columns here are not touched,
    as helpers get names of their own.
    """
    lines = exploded_lines(docs, id_col, text_col, site_col)
    found = boilerplate(lines, min_sites)
    text, table, flat, removed = fresh(docs.columns, "__text", "__table", "__lines", "__removed")
    if fits(found, "first.doc"):
        n = max(16, found.count() // BUCKET)
        with_table = docs.select("*", text_of(text_col).alias(text), buckets(found, n).scalar().alias(table))
        own, t1 = F.col(id_col), F.xxhash64(F.col(text))

        def gone(x: Column) -> Column:
            held = F.get(F.col(table), F.pmod(x["h1"], F.lit(n)).cast("int"))
            stays = lambda e: e["first"]["doc"].eqNullSafe(own) & (e["first"]["pos"] == x["i"]) & (e["first"]["t1"] == t1)
            return (F.trim(x["l"]) != "") & F.exists(held, lambda e: (e["h1"] == x["h1"]) & (e["h2"] == x["h2"]) & ~stays(e))

        hashed = F.transform(F.split(text, "\n"), lambda l, i: F.struct(l.alias("l"), i.alias("i"), *line_hashes(l)))
        marked = with_table.select(*docs.columns, F.transform(F.filter(hashed, gone), lambda x: x["i"]).alias(removed))
    else:
        doc, t1 = fresh(docs.columns, "__doc", "__t1")
        cut = met(lines, found).where(~F.struct("doc", "pos", "t1").eqNullSafe(F.col("first")))
        cut = cut.groupBy(F.col("doc").alias(doc), F.col("t1").alias(t1)).agg(F.sort_array(F.collect_set("pos")).alias(removed))
        joined = docs.join(cut, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_of(text_col)) == F.col(t1)), "left")
        marked = joined.select(*docs.columns, F.coalesce(F.col(removed), F.array().cast("array<int>")).alias(removed))
    listed = marked.withColumn(flat, F.when(F.size(removed) > 0, F.split(F.col(text_col), "\n")))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(flat) - 1), F.col(removed)), lambda i: F.get(F.col(flat), i)), "\n")
    return listed.select(*[(F.when(F.size(removed) > 0, kept).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)) for c in docs.columns], removed)
