"""Running headers, footers and page numbers across pages, and what continues over a page break."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as X

c = F.col


def observations(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Texts in the edge bands with their type, position bins and content key."""
    n = X.visible_length(c("text"))
    y = (c("y0") + c("y1")) / 2
    header = y <= c("height") * P.EDGE_BAND
    digits = X.matches(X.visible(c("text")), r"\p{N}")
    kind = F.when(digits / n >= P.PAGE_NUMBER_DIGITS, "page_number").when(header, "header").otherwise("footer")
    folded = F.lower(F.regexp_replace(X.trimmed(c("text")), f"{P.WHITE}+", " "))
    px, py = (c("x0") + c("x1")) / 2 / c("width"), y / c("height")
    near = objects.where("kind = 'text'").join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).where((n >= 1) & (n <= P.MAX_CHARS) & (header | (y >= c("height") * (1 - P.EDGE_BAND))))
    return near.select(
        "doc_id", "page", "obj_id", "seq", kind.alias("type"), F.when(kind == "page_number", F.regexp_replace(folded, r"\p{N}+", "#")).otherwise(folded).alias("key"),
        px.alias("px"), py.alias("py"), F.floor(px / P.POSITION_BIN + 0.5).cast("int").alias("xbin"), F.floor(py / P.POSITION_BIN + 0.5).cast("int").alias("ybin"),
    )


CLUSTER = ["doc_id", "type", "xbin", "ybin", "key"]


def members(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Members of the clusters that repeat on enough pages; the first object a page counts."""
    seen = observations(objects, pages)
    first = seen.groupBy(*CLUSTER, "page").agg(F.min(F.struct("seq", "obj_id", "px", "py")).alias("m")).select(*CLUSTER, "page", "m.obj_id", "m.px", "m.py")
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    group = Window.partitionBy(*CLUSTER)
    sized = first.join(n, "doc_id").withColumn("n", F.count(F.lit(1)).over(group)).where((c("n") >= P.REPEAT_PAGES) & (c("n") >= F.ceil(c("n_pages") * P.REPEAT_SHARE)))
    return sized.withColumn("mx", F.avg("px").over(group)).withColumn("my", F.avg("py").over(group))


def clusters(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a cluster with its confidence: how often it repeats and how still it stands."""
    drift = F.avg(F.hypot(c("px") - c("mx"), c("py") - c("my")))
    whole = members(objects, pages).groupBy(*CLUSTER, "n", "n_pages").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), drift.alias("drift"))
    confidence = c("n") / c("n_pages") * P.CONTENT_WEIGHT + X.clamp(1 - c("drift") / P.POSITION_BIN) * P.POSITION_WEIGHT
    return whole.select(*CLUSTER, c("n").alias("pages"), "first_page", "last_page", X.score(confidence).alias("confidence"))


def modes(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """What each furniture mode does with the members: body flag and whether they stay in the element list."""
    mode = F.explode(F.array(*map(F.lit, ("off", "drop", "extract"))))
    return members(objects, pages).select("doc_id", "page", "obj_id", "type", mode.alias("mode")).select("*", (c("mode") == "off").alias("is_body"), (c("mode") != "extract").alias("in_elements"))


def body_objects(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Objects that no furniture claims."""
    return objects.join(members(objects, pages).select("doc_id", "obj_id"), ["doc_id", "obj_id"], "left_anti")


def continuations(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Page pairs whose tail and head text belong together: from_page, to_page, kind, confidence, objects."""
    size = pages.select("doc_id", "page", "height")
    texts = body_objects(objects, pages).where("kind = 'text'").where(X.visible_length(c("text")) >= P.CONTINUATION_CHARS).join(size, ["doc_id", "page"])
    gathered = lambda rows, name: rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "obj_id", "text"))).alias(name))
    tail = gathered(texts.where(c("y1") >= c("height") * (1 - P.CONTINUATION_BAND)), "tail")
    head = gathered(texts.where(c("y0") <= c("height") * P.CONTINUATION_BAND), "head").select("doc_id", (c("page") - 1).alias("page"), "head")
    both = tail.join(head, ["doc_id", "page"]).select("*", F.array_join("tail.text", "").alias("t"), F.array_join("head.text", "").alias("h"))
    listed = c("t").rlike(P.LIST_PREFIX) | c("h").rlike(P.LIST_PREFIX)
    kept = both.where(listed | ~F.regexp_replace("t", f"{P.WHITE}+$", "").rlike(P.TERMINAL))
    kind = F.when(listed, "list").otherwise("paragraph")
    return kept.select("doc_id", c("page").alias("from_page"), (c("page") + 1).alias("to_page"), kind.alias("kind"), F.when(listed, P.CONTINUATION["list"]).otherwise(P.CONTINUATION["paragraph"]).alias("confidence"), F.array_join(F.concat("tail.obj_id", "head.obj_id"), ",").alias("objects"))
