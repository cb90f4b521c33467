"""Checks over finished tables: each gives a table of violations, empty where all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col
FOUND = ["doc_id", "check", "subject", "detail"]


class InvariantError(ValueError):
    """Tables that contradict each other."""


def _found(rows: DataFrame, check: str, subject, detail) -> DataFrame:
    return rows.select("doc_id", F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def order_contiguous(elements: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return _found(elements.withColumn("nth", nth).where("nth != ord"), "order", c("obj_id"), c("ord"))


def parents_exist(elements: DataFrame) -> DataFrame:
    ids = elements.select("doc_id", c("obj_id").alias("parent_id"), c("ord").alias("at"))
    lost = elements.where("parent_id IS NOT NULL").join(ids, ["doc_id", "parent_id"], "left").where("at IS NULL OR at >= ord")
    return _found(lost, "parents", c("obj_id"), c("parent_id"))


def pages_contiguous(pages: DataFrame) -> DataFrame:
    w = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("page").alias("last"), F.count_distinct("page").alias("d"))
    return _found(w.where("n != last OR n != d"), "pages", c("n"), c("last"))


def boxes_on_page(objects: DataFrame, pages: DataFrame, slack: float = 1.0) -> DataFrame:
    out = objects.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).where((c("x0") < -slack) | (c("y0") < -slack) | (c("x1") > c("width") + slack) | (c("y1") > c("height") + slack))
    return _found(out, "boxes", c("obj_id"), c("page"))


def ids_unique(objects: DataFrame) -> DataFrame:
    return _found(objects.groupBy("doc_id", "obj_id").count().where("count > 1"), "ids", c("obj_id"), c("count"))


def conserved(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """Every object has one ledger entry, and every entry an object."""
    n = entries.groupBy("doc_id", "obj_id").agg(F.count(F.lit(1)).alias("entries"))
    both = objects.select("doc_id", "obj_id", F.lit(1).alias("own")).join(n, ["doc_id", "obj_id"], "full").where("own IS NULL OR entries IS NULL OR entries != 1")
    return _found(both, "ledger", c("obj_id"), F.coalesce("entries", F.lit(0)))


def heading_levels_named(elements: DataFrame) -> DataFrame:
    return _found(elements.where("(type = 'heading') != (level IS NOT NULL)"), "levels", c("obj_id"), c("type"))


def run_all(objects: DataFrame, pages: DataFrame, elements: DataFrame, entries: DataFrame) -> DataFrame:
    """All violations; ``elements`` has parents and order."""
    checks = [order_contiguous(elements), parents_exist(elements), pages_contiguous(pages), boxes_on_page(objects, pages), ids_unique(objects), conserved(objects, entries), heading_levels_named(elements)]
    every = checks[0]
    for check in checks[1:]:
        every = every.unionByName(check)
    return every


def require_none(violations: DataFrame) -> None:
    first = violations.first()
    if first is not None:
        raise InvariantError(f"{first.check}: {first.subject} ({first.detail}) in document {first.doc_id}")


def missing_fields(rows: DataFrame, required: list[str], id_col: str = "doc_id") -> DataFrame:
    """id, field of each required field that is null."""
    return rows.select(c(id_col), F.explode(F.filter(F.array(*[F.when(c(f).isNull(), F.lit(f)) for f in required]), lambda f: f.isNotNull())).alias("field"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two runs do not share, with the side they are on: empty if the runs agree."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
