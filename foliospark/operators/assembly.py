"""Elements from runs, their order, hierarchy, lists and ids; the conservation ledger; verdicts; rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as X
from . import furniture, probes

c = F.col


def lanes(objects: DataFrame, pages: DataFrame, n_columns: int) -> DataFrame:
    """Column of each visible run; -1 where it spans the page across a divider."""
    w = c("width")
    dividers = [w * d / n_columns for d in range(1, n_columns)]
    crosses = F.lit(False)
    for x in dividers:
        crosses = crosses | ((c("x0") < x) & (c("x1") > x))
    lane = F.least(F.lit(n_columns - 1), F.greatest(F.lit(0), F.floor((c("x0") + c("x1")) / 2 / w * n_columns))).cast("int")
    spans = (c("x1") - c("x0") >= P.SPANNING_SHARE * w) & crosses
    return objects.where(X.has_ink()).join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).select("doc_id", "page", "obj_id", F.when(spans, -1).otherwise(lane).alias("lane"))


def classified(objects: DataFrame, pages: DataFrame, keep_furniture: bool = False) -> DataFrame:
    """Type, level and engine of each body run taken as a block of one line, in the order of the cascade."""
    text = X.trimmed(c("text"))
    rank = probes.text_profile(objects).where("level IS NOT NULL").select("doc_id", c("bucket"), c("level").alias("ranked"))
    body = objects if keep_furniture else furniture.body_objects(objects, pages)
    runs = body.where("kind = 'text'").where(X.visible_length(c("text")) > 0)
    runs = runs.withColumn("bucket", X.font_bucket(c("size"))).join(rank, ["doc_id", "bucket"], "left").join(pages.select("doc_id", "page", "width"), ["doc_id", "page"])
    latin = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{IsLatin}+)"), F.lit(1)), lambda r: F.length(r))), F.lit(0))
    by_rank = c("ranked").isNotNull() & (X.visible_length(text) <= P.HEADING_MAX) & ~text.rlike(P.HEADING_TAIL)
    formula = text.contains("=") & (latin <= P.FORMULA_LATIN) & (F.abs((c("x0") + c("x1")) / 2 - c("width") / 2) <= P.FORMULA_CENTER * c("width"))
    kind = (
        F.when(X.is_list_marker(c("text"), c("font")), "list_marker").when(X.is_heading_text(text) | X.is_numeric_heading(text), "heading").when(text.rlike(P.FIGURE_CAPTION), "figure")
        .when(c("font").rlike(P.MONOSPACE), "code").when(by_rank, "heading").when(formula, "formula").otherwise("unknown")
    )
    level = F.when(kind == "heading", X.heading_level(text, c("ranked")))
    return runs.select("doc_id", "page", "seq", "obj_id", "text", "font", "size", "x0", "y0", "x1", "y1", kind.alias("type"), level.alias("level"))


def ordered(elements: DataFrame) -> DataFrame:
    """Place of each element in its document: page, top, left, object order."""
    return elements.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "y0", "x0", "seq")))


def heading_parents(elements: DataFrame) -> DataFrame:
    """The nearest heading of a lower level before an element; any heading for what is none."""
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.last(F.when((c("type") == "heading") & (c("level") <= k), c("obj_id")), ignorenulls=True).over(before)
    parent = last(99)
    for k in range(5, 1, -1):
        parent = F.when((c("type") == "heading") & (c("level") == k), last(k - 1)).otherwise(parent)
    parent = F.when((c("type") == "heading") & (c("level") == 1), F.lit(None).cast("string")).otherwise(parent)
    return elements.select("doc_id", "obj_id", "ord", "type", "level", parent.alias("parent_id"))


def heading_jumps(elements: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before them."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    return elements.where("type = 'heading'").withColumn("previous", F.lag("level").over(w)).where("level > previous + 1").select("doc_id", "obj_id", "previous", "level")


def list_containers(items: DataFrame) -> DataFrame:
    """Container of each list item: runs of items of one kind, successive numbers and small gaps.

    ``items``: doc_id, item_id, page, ord, parent_id, marker, y0, y1, size.
    """
    number = F.regexp_extract("marker", r"^\s*([0-9]+)[.)、．]", 1)
    n = F.when(number != "", number.cast("int"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = lambda x: F.lag(x).over(w)
    numbered = items.withColumn("n", n)
    same = (
        (before("ord") == c("ord") - 1) & before("parent_id").eqNullSafe(c("parent_id")) & (before("n").isNull() == c("n").isNull())
        & (c("n").isNull() | (c("n") == before("n") + 1)) & (before("page") == c("page")) & (c("y0") - before("y1") <= P.LIST_GAP * F.greatest(c("size"), before("size")))
    )
    flagged = numbered.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(w))
    first = F.first("item_id").over(Window.partitionBy("doc_id", "g").orderBy("ord"))
    return flagged.select("doc_id", "item_id", F.concat(first, F.lit("_list")).alias("container_id"), F.row_number().over(Window.partitionBy("doc_id", "g").orderBy("ord")).alias("nth"))


def stable_ids(drafts: DataFrame, prefix: str = "e") -> DataFrame:
    """Ids from pages and anchors; of equal ones, numbered by their boxes. ``drafts``: doc_id, page, ids array, x0, y0, x1, y1."""
    based = drafts.withColumn("base", F.concat(F.lit(f"{prefix}_p"), c("page").cast("string"), F.lit("_"), X.anchor_hash(c("ids"))))
    same = Window.partitionBy("doc_id", "base")
    many = F.count(F.lit(1)).over(same) > 1
    nth = F.row_number().over(same.orderBy("x0", "y0", "x1", "y1"))
    return based.select("doc_id", "page", F.when(many, F.concat("base", F.lit("_"), nth.cast("string"))).otherwise(c("base")).alias("element_id"), F.array_join("ids", ",").alias("ids"))


def region_ids(members: DataFrame) -> DataFrame:
    """region_first or region_first_last, in member order: ``members`` has doc_id, page, region, pos, obj_id."""
    first, last = F.min_by("obj_id", "pos"), F.max_by("obj_id", "pos")
    named = F.when(F.count(F.lit(1)) == 1, F.concat(F.lit("region_"), first)).otherwise(F.concat(F.lit("region_"), first, F.lit("_"), last))
    return members.groupBy("doc_id", "page", "region").agg(named.alias("region_id"), F.count(F.lit(1)).alias("n"))


def furniture_regions(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """One region for each furniture member: clusters first, then page numbers that a page shows by itself."""
    across = furniture.members(objects, pages)
    local = probes.local_page_numbers(objects, pages).join(across.select("doc_id", "obj_id"), ["doc_id", "obj_id"], "left_anti")
    region = F.concat(F.lit("region_"), c("obj_id")).alias("region_id")
    one = across.select("doc_id", "page", region, "type", F.lit("l2-cross-page-furniture-v1").alias("engine"))
    return one.unionByName(local.select("doc_id", "page", region, F.lit("page_number").alias("type"), F.lit("local-page-number-v1").alias("engine")))


def accepted_pages(sizes: DataFrame, most: int) -> DataFrame:
    """Pages in order whose objects fit the total so far; a page over the limit is refused and not counted.

    ``sizes``: doc_id, page, n. The state is a running total, so pages of a document are folded in order.
    """
    step = lambda s, p: F.struct(
        (s["total"] + F.when(s["total"] + p["n"] <= most, p["n"]).otherwise(0)).alias("total"),
        F.concat(s["out"], F.array(F.struct(p["page"].alias("page"), (s["total"] + p["n"] <= most).alias("accepted")))).alias("out"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<struct<page:int,accepted:boolean>>").alias("out"))
    folded = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", c("n").cast("bigint").alias("n")))).alias("ps")).select("doc_id", F.aggregate("ps", start, step, lambda s: s["out"]).alias("out"))
    return folded.select("doc_id", F.explode("out").alias("o")).select("doc_id", "o.page", "o.accepted")


def caption_targets(captions: DataFrame, figures: DataFrame) -> DataFrame:
    """Nearest figure above each caption that overlaps it enough sideways: smallest gap, then the later figure."""
    f = figures.select("doc_id", "page", c("obj_id").alias("figure_id"), *[c(k).alias(f"f{k}") for k in ("x0", "y0", "x1", "y1")])
    width = c("x1") - c("x0")
    overlap = F.greatest(F.lit(0.0), F.least("x1", "fx1") - F.greatest("x0", "fx0")) / width
    gap = F.greatest(F.lit(0.0), c("y0") - c("fy1"))
    near = captions.join(f, ["doc_id", "page"]).where((c("fy0") <= c("y0")) & (overlap >= P.CAPTION_OVERLAP) & (gap <= P.CAPTION_GAP * c("size")))
    return near.groupBy("doc_id", "page", "obj_id").agg(F.min(F.struct(gap.alias("gap"), "figure_id")).alias("t")).select("doc_id", "page", "obj_id", c("t.figure_id").alias("figure_id"), c("t.gap").alias("gap"))


# Ledger and verdict


def ledger(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each object went: represented, recorded (annotations), suppressed (furniture) or ignored_empty."""
    gone = furniture.members(objects, pages).select("doc_id", "obj_id", F.lit(True).alias("furniture"))
    where = F.when(c("kind") == "annotation", "recorded").when((c("kind") == "text") & (c("text") == ""), "ignored_empty").when(c("furniture"), "suppressed").otherwise("represented")
    return objects.join(gone, ["doc_id", "obj_id"], "left").select("doc_id", "page", "obj_id", "kind", where.alias("disposition"))


def ledger_pages(entries: DataFrame) -> DataFrame:
    covered = F.count_if(c("disposition") != "unrepresentable")
    kinds = [F.count_if(c("kind").isin(*ks)).alias(n) for n, ks in (("text", ["text"]), ("path", ["graphic", "rule"]), ("image", ["image"]), ("annotation", ["annotation"]))]
    return entries.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("objects"), covered.alias("covered"), (covered / F.count(F.lit(1))).alias("coverage"), *kinds)


def lost_kinds(census: DataFrame, emitted: DataFrame) -> DataFrame:
    """Kinds of which a page's count of operators is not met; text counts only as there or not."""
    both = census.join(emitted, ["doc_id", "page"], "left")
    checks = [F.when((c("census_text") > 0) & (F.coalesce("text", F.lit(0)) == 0), F.lit("text"))]
    checks += [F.when(F.coalesce(k, F.lit(0)) < c(f"census_{k}"), F.lit(k)) for k in ("path", "image", "annotation")]
    return both.select("doc_id", "page", F.explode(F.filter(F.array(*checks), lambda k: k.isNotNull())).alias("lost"))


def object_coverage(objects: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of visible texts of a page that regions (doc_id, page, obj_id) do not name exactly once."""
    named = regions.groupBy("doc_id", "page", "obj_id").agg(F.count(F.lit(1)).alias("n"))
    texts = objects.where("kind = 'text'").where(X.visible_length(c("text")) > 0).join(named, ["doc_id", "page", "obj_id"], "left")
    return texts.groupBy("doc_id", "page").agg(X.score(F.avg(F.when(c("n") == 1, 0.0).otherwise(1.0))).alias("residual"))


def kendall_distance(left: DataFrame, right: DataFrame, key: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Inversions between two orders (key, obj_id, pos), as a share of the pairs they have in common."""
    both = left.select(*key, "obj_id", c("pos").alias("a")).join(right.select(*key, "obj_id", c("pos").alias("b")), [*key, "obj_id"])
    pairs = both.join(both.select(*key, c("a").alias("a2"), c("b").alias("b2")), list(key)).where("a < a2")
    return pairs.groupBy(*key).agg(X.score(F.avg(F.when(c("b") > c("b2"), 1.0).otherwise(0.0))).alias("distance"))


def page_verdict(signals: DataFrame) -> DataFrame:
    """Status of a page from its residuals and text layer: doc_id, page, verdict, coverage, reading, grid."""
    a, b, g = P.VERDICT_WEIGHTS
    total = a + b + g
    doubt = X.score(X.clamp((a * c("coverage") + b * c("reading") + g * c("grid")) / total))
    judged = signals.withColumn("uncertainty", doubt)
    status = F.when((c("verdict") != "trusted") | (c("uncertainty") > P.VERDICT_MAX), "degraded").otherwise("ok")
    step = F.when(c("verdict").isin("broken", "absent"), "full_parser").when((c("verdict") == "partial") | (c("uncertainty") > P.VERDICT_MAX), "layout_oracle").otherwise("")
    code = F.when(c("verdict") == "absent", "NO_TEXT_LAYER").when(c("verdict") == "broken", "BROKEN_TEXT_LAYER").when(c("verdict") == "partial", "TEXT_LAYER_SUSPECT")
    warnings = F.array_join(F.filter(F.array(code, F.when(c("uncertainty") > P.VERDICT_MAX, F.lit("LAYOUT_UNCERTAIN"))), lambda w: w.isNotNull()), ",")
    return judged.select("doc_id", "page", "uncertainty", status.alias("status"), step.alias("escalation"), warnings.alias("warnings"))


def page_status(warnings: DataFrame) -> DataFrame:
    """failed on an error, degraded on a warning, else ok: doc_id, page, severity."""
    rank = F.max(F.when(c("severity") == "error", 2).when(c("severity") == "warn", 1).otherwise(0))
    return warnings.groupBy("doc_id", "page").agg(rank.alias("r")).select("doc_id", "page", F.when(c("r") == 2, "failed").when(c("r") == 1, "degraded").otherwise("ok").alias("status"))


def dangling_parents(elements: DataFrame) -> DataFrame:
    """Elements whose parent is missing or stands behind them (so that a parent chain could not end)."""
    own = elements.select("doc_id", c("obj_id").alias("parent_id"), c("ord").alias("parent_ord"))
    return elements.where("parent_id IS NOT NULL").join(own, ["doc_id", "parent_id"], "left").where("parent_ord IS NULL OR parent_ord >= ord").select("doc_id", "obj_id", "parent_id")


def missing_anchors(anchors: DataFrame, objects: DataFrame) -> DataFrame:
    """Anchors (doc_id, page, obj_id) of elements that name no object of their page."""
    return anchors.join(objects.select("doc_id", "page", "obj_id"), ["doc_id", "page", "obj_id"], "left_anti")


def rendered(elements: DataFrame) -> DataFrame:
    """Markdown of each element by type."""
    text = X.trimmed(c("text"))
    return elements.withColumn("markdown", F.when(c("type") == "heading", F.concat(F.repeat(F.lit("#"), c("level")), F.lit(" "), text)).when(c("type") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(c("type") == "formula", F.concat(F.lit("$$"), text, F.lit("$$"))).when(c("type") == "list_marker", F.lit("-")).otherwise(text))


def markdown_documents(elements: DataFrame) -> DataFrame:
    """Markdown of each document: elements in order, a blank line between them."""
    parts = rendered(elements).where("markdown != ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "markdown"))).alias("p"))
    return parts.select("doc_id", F.concat(F.array_join("p.markdown", "\n\n"), F.lit("\n")).alias("markdown"))
