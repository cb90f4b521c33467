"""Page and document probes: text layer, signals, columns, tables, all by aggregation on (doc_id, page)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as X

c = F.col


def local_page_numbers(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Short numbers near the foot of a page, at either side or in the middle."""
    t = X.trimmed(c("text"))
    share = (c("x0") + c("x1")) / 2 / c("width")
    zone = (share <= P.LOCAL_ZONE) | (share >= 1 - P.LOCAL_ZONE) | (F.abs(share - 0.5) <= P.LOCAL_ZONE / 2)
    found = objects.where("kind = 'text'").join(pages, ["doc_id", "page"]).where(t.rlike(r"^[0-9]{1,4}$") & (c("y0") >= c("height") * (1 - P.LOCAL_BAND)) & zone)
    return found.select("doc_id", "page", "obj_id", t.alias("text"), F.lit(P.LOCAL_CONFIDENCE).alias("confidence"))


def thin_rules(objects: DataFrame) -> DataFrame:
    """Drawings that are thin enough to be rules."""
    w, h = F.greatest(F.lit(0.0), c("x1") - c("x0")), F.greatest(F.lit(0.0), c("y1") - c("y0"))
    long, short = F.greatest(w, h), F.least(w, h)
    thin = (long >= P.RULE_MIN_LENGTH) & (short <= P.RULE_MAX_THICKNESS) & ((short <= 0) | (long / short >= P.RULE_MIN_ASPECT))
    flat = w >= h
    return objects.where("kind = 'graphic'").where(thin).select(
        "doc_id", "page", "obj_id", F.when(flat, "h").otherwise("v").alias("orientation"),
        F.when(flat, c("y0") + c("y1")).otherwise(c("x0") + c("x1")).alias("axis2"), F.when(flat, c("x0")).otherwise(c("y0")).alias("lo"), F.when(flat, c("x1")).otherwise(c("y1")).alias("hi"),
    ).withColumn("axis", c("axis2") / 2).drop("axis2")


def text_profile(objects: DataFrame) -> DataFrame:
    """doc_id, bucket, chars, body_size, level: visible characters by font size, the body size and the heading sizes."""
    sizes = objects.where("kind = 'text'").select("doc_id", X.font_bucket(c("size")).alias("bucket"), X.visible_length(c("text")).alias("n")).where("n > 0 AND bucket > 0").groupBy("doc_id", "bucket").agg(F.sum("n").alias("chars"))
    doc = Window.partitionBy("doc_id")
    ranked = sizes.withColumn("total", F.sum("chars").over(doc)).withColumn("body", F.max(F.struct("chars", (-c("bucket")).alias("size"))).over(doc))
    body = F.when(c("body.chars") / c("total") >= P.BODY_SHARE, -c("body.size"))
    heading = (c("bucket") >= body * P.HEADING_RATIO) & (c("chars") >= P.HEADING_CHARS) & (c("chars") / c("total") <= P.HEADING_SHARE)
    level = F.when(heading, F.sum(heading.cast("int")).over(doc.orderBy(c("bucket").desc())))
    return ranked.select("doc_id", "bucket", "chars", body.alias("body_size"), F.when(level <= P.HEADING_LEVELS, level).cast("int").alias("level"))


def dominant_style(objects: DataFrame, by: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Font and size that cover most characters; of equals, the one seen first."""
    cover = objects.where("kind = 'text'").groupBy(*by, "font", "size").agg(F.sum(F.length("text") + F.regexp_count("text", F.lit(r"[\x{10000}-\x{10FFFF}]"))).alias("chars"), F.min("seq").alias("first"))
    top = cover.groupBy(*by).agg(F.max(F.struct("chars", (-c("first")).alias("f"), "font", "size")).alias("t"))
    return top.select(*by, c("t.font").alias("font"), c("t.size").alias("size"), c("t.chars").alias("chars"))


def language_profile(objects: DataFrame) -> DataFrame:
    """Chinese from a tenth of Han characters on, else English; unknown without characters."""
    seen = objects.where("kind = 'text'").groupBy("doc_id").agg(F.sum(X.visible_length(c("text"))).alias("chars"), F.sum(X.matches(c("text"), r"\p{IsHan}")).alias("han"))
    return seen.select("doc_id", "chars", "han", F.when(c("chars") == 0, "unknown").when(c("han") / c("chars") >= P.HAN_DOCUMENT_SHARE, "zh").otherwise("en").alias("language"))


def text_layer(objects: DataFrame) -> DataFrame:
    """Counts and verdict of each page's text layer (statistical evidence; fonts are judged where they are known)."""
    text = c("text")
    words = F.regexp_extract_all(text, F.lit("([A-Za-z]{4,})"), F.lit(1))
    odd = F.filter(words, lambda w: F.lower(w).rlike(r"[bcdfghjklmnpqrstvwxz]{5,}"))
    cid = F.aggregate(F.regexp_extract_all(text, F.lit(r"(\(cid:[0-9]+\)|/[0-9]+)"), F.lit(1)), F.lit(0), lambda s, w: s + F.length(w))
    page = objects.where("kind = 'text'").groupBy("doc_id", "page").agg(
        F.sum(X.visible_length(text)).alias("chars"),
        F.sum(X.matches(text, r"\x{FFFD}")).alias("replacement"),
        F.sum(cid).cast("bigint").alias("cid"),
        F.sum(X.matches(text, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F8FF}]")).alias("suspicious"),
        F.sum(F.size(words)).cast("bigint").alias("words"),
        F.sum(F.size(odd)).cast("bigint").alias("odd_words"),
    )
    page = page.join(language_profile(objects).select("doc_id", "language"), "doc_id")
    over = lambda n, rate: ((c(n) >= P.LEAST_SUSPICIOUS) & (c(n) / c("chars") >= rate)).cast("int")
    gibberish = ((c("language") == "en") & (c("chars") >= P.LANGUAGE_MIN_CHARS) & (c("words") >= P.LANGUAGE_MIN_WORDS) & (c("odd_words") / c("words") >= P.GIBBERISH_SHARE)).cast("int")
    statistical = F.when(c("chars") == 0, 0).otherwise(over("replacement", P.REPLACEMENT_RATE) + over("cid", P.CID_RATE) + over("suspicious", P.SUSPICIOUS_RATE) + gibberish)
    return page.withColumn("statistical", statistical).withColumn("gibberish", F.coalesce(gibberish, F.lit(0))).withColumn(
        "verdict", F.when(c("chars") == 0, "absent").when(c("statistical") >= 2, "broken").when(c("statistical") == 1, "partial").otherwise("trusted")
    )


def union_area(boxes: DataFrame, key: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Area covered by the boxes of a key, counted once: slabs between x edges, with merged y intervals in each."""
    boxes = boxes.where("x1 > x0 AND y1 > y0").select(*key, "x0", "y0", "x1", "y1")
    edges = boxes.select(*key, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = edges.withColumn("to", F.lead("x").over(Window.partitionBy(*key).orderBy("x"))).where("to IS NOT NULL")
    met = boxes.join(slabs, list(key)).where("x0 < to AND x1 > x")
    slab = Window.partitionBy(*key, "x", "to")
    before = F.max("y1").over(slab.orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    grown = met.withColumn("before", before).withColumn("gain", F.greatest(F.lit(0.0), c("y1") - F.greatest(c("y0"), F.coalesce("before", c("y0")))))
    return grown.groupBy(*key).agg(F.sum((c("to") - c("x")) * c("gain")).alias("area"))


def overlaid_text(objects: DataFrame) -> DataFrame:
    """Text of which a fifth or more lies on images."""
    images = objects.where("kind = 'image'").select("doc_id", "page", *[c(k).alias(f"i{k}") for k in ("x0", "y0", "x1", "y1")])
    on = objects.where(X.has_ink()).join(images, ["doc_id", "page"]).where("x0 < ix1 AND x1 > ix0 AND y0 < iy1 AND y1 > iy0")
    cut = on.select("doc_id", "page", "obj_id", X.area(c("x0"), c("y0"), c("x1"), c("y1")).alias("whole"), *[f(c(k), c(f"i{k}")).alias(k) for k, f in (("x0", F.greatest), ("y0", F.greatest), ("x1", F.least), ("y1", F.least))])
    covered = union_area(cut, ("doc_id", "page", "obj_id"))
    return cut.select("doc_id", "page", "obj_id", "whole").distinct().join(covered, ["doc_id", "page", "obj_id"]).where(c("area") / c("whole") >= P.IMAGE_TEXT_OVERLAP).select("doc_id", "page", "obj_id", X.score(c("area") / c("whole")).alias("share"))


def figure_owned_text(objects: DataFrame) -> DataFrame:
    """Text contained in an image; the first image from the top claims it."""
    images = objects.where("kind = 'image'").select("doc_id", "page", c("obj_id").alias("image_id"), *[c(k).alias(f"i{k}") for k in ("x0", "y0", "x1", "y1")])
    inter = X.area(F.greatest("x0", "ix0"), F.greatest("y0", "iy0"), F.least("x1", "ix1"), F.least("y1", "iy1"))
    owned = objects.where(X.has_ink()).join(images, ["doc_id", "page"]).where(inter / X.area(c("x0"), c("y0"), c("x1"), c("y1")) >= P.OWNED_CONTAINMENT)
    return owned.groupBy("doc_id", "page", "obj_id").agg(F.min(F.struct("iy0", "ix0", "image_id")).alias("i")).select("doc_id", "page", "obj_id", c("i.image_id").alias("image_id"))


def page_signals(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """One row a page: densities, math, numbers, turned text."""
    ink = X.has_ink()
    turned = F.degrees(F.atan2(c("tb"), c("ta")))
    angle = F.least(F.abs(turned), F.abs(180 - F.abs(turned)))
    counts = objects.groupBy("doc_id", "page").agg(
        F.count_if(ink).alias("texts"), F.count_if(c("kind") == "image").alias("images"), F.count_if(c("kind") == "graphic").alias("graphics"),
        F.sum(F.when(ink, X.matches(c("text"), r"[\p{Sm}]")).otherwise(0)).cast("bigint").alias("math"),
        F.count_if(ink & c("font").rlike(P.MATH_FONT)).alias("math_fonts"),
        F.sum(F.when(ink, X.matches(c("text"), r"[-+]?[0-9]+(?:[.,][0-9]+)?")).otherwise(0)).cast("bigint").alias("numbers"),
        F.sum(F.when(ink, F.length("text")).otherwise(0)).cast("bigint").alias("length"),
        F.count_if(ink & (angle >= P.ROTATED_DEGREES)).alias("turned"),
    )
    size = pages.select("doc_id", "page", "width", "height", "rotation")
    clip = objects.join(size, ["doc_id", "page"]).select("doc_id", "page", "kind", ink.alias("ink"), *[F.least(c(m), F.greatest(F.lit(0.0), c(k))).alias(k) for k, m in (("x0", "width"), ("y0", "height"), ("x1", "width"), ("y1", "height"))])
    text_area, image_area = union_area(clip.where("ink")).withColumnRenamed("area", "ta"), union_area(clip.where("kind = 'image'")).withColumnRenamed("area", "ia")
    all_ = size.join(counts, ["doc_id", "page"], "left").join(text_area, ["doc_id", "page"], "left").join(image_area, ["doc_id", "page"], "left")
    whole = c("width") * c("height")
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    image_share, density = F.coalesce("ia", F.lit(0.0)) / whole, F.coalesce("ta", F.lit(0.0)) / whole
    mean = F.when(zero("texts") == 0, 0.0).otherwise(c("length") / c("texts"))
    return all_.select(
        "doc_id", "page", "rotation", zero("texts").cast("bigint").alias("texts"), (zero("images") > 0).alias("has_image"),
        X.score(image_share).alias("image_area_ratio"), X.score(density).alias("text_density"), X.score(zero("graphics") / (whole / P.POINTS_PER_INCH**2)).alias("vector_density"),
        ((zero("texts") > 0) & (zero("images") > 0) & (image_share >= P.MIXED_MIN_IMAGE_SHARE)).alias("has_mixed"),
        ((zero("math") >= 1) | (zero("math_fonts") > 0)).alias("has_formula"),
        ((zero("graphics") >= P.CHART_VECTORS) & (mean <= P.CHART_MEAN_LENGTH) & (zero("numbers") >= P.CHART_NUMBERS)).alias("has_chart"),
        (zero("turned") > 0).alias("has_rotated"),
    )


def gutters(objects: DataFrame, pages: DataFrame, factors: tuple[float, ...] = (1 - P.COLUMN_PERTURBATION, 1.0, 1 + P.COLUMN_PERTURBATION)) -> DataFrame:
    """doc_id, page, factor, x0, x1, purity of each gutter: runs of little occupied bins in the middle of the page."""
    texts = objects.where(X.has_ink()).join(pages.select("doc_id", "page", "width"), ["doc_id", "page"]).select("doc_id", "page", "width", "x0", "x1", (c("y1") - c("y0")).alias("h"), X.visible_length(c("text")).alias("n"))
    bin_of = lambda x: F.least(F.lit(P.COLUMN_BINS - 1), F.greatest(F.lit(0), F.floor(x / (c("width") / P.COLUMN_BINS)))).cast("int")
    bins = texts.select("doc_id", "page", "width", "h", F.explode(F.sequence(bin_of(c("x0")), bin_of(c("x1")))).alias("bin")).groupBy("doc_id", "page", "width", "bin").agg(F.sum("h").alias("occupancy"))
    top = bins.groupBy("doc_id", "page", "width").agg(F.max("occupancy").alias("top"))
    first, last = int(P.COLUMN_BINS * P.COLUMN_SEARCH[0]), -int(-P.COLUMN_BINS * P.COLUMN_SEARCH[1] // 1)
    grid = top.select("*", F.explode(F.array(*map(F.lit, factors))).alias("factor")).select("*", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("bin"))
    low = grid.join(bins, ["doc_id", "page", "width", "bin"], "left").where(F.coalesce("occupancy", F.lit(0.0)) <= c("top") * P.COLUMN_OCCUPANCY * c("factor"))
    island = c("bin") - F.row_number().over(Window.partitionBy("doc_id", "page", "factor").orderBy("bin"))
    runs = low.withColumn("island", island).groupBy("doc_id", "page", "width", "factor", "island").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b"))
    runs = runs.select("doc_id", "page", "factor", c("width").alias("w"), (c("a") * (c("width") / P.COLUMN_BINS)).alias("g0"), (c("b") * (c("width") / P.COLUMN_BINS)).alias("g1"))
    mid = (c("x0") + c("x1")) / 2
    judged = runs.join(texts, ["doc_id", "page"]).groupBy("doc_id", "page", "factor", "w", "g0", "g1").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if((c("x0") < c("g1")) & (c("x1") > c("g0"))).alias("crossing"), F.sum("n").alias("n"), F.sum(F.when(mid < c("g0"), c("n")).otherwise(0)).alias("left"), F.sum(F.when(mid > c("g1"), c("n")).otherwise(0)).alias("right")
    )
    width = c("g1") - c("g0")
    good = (width >= P.COLUMN_MIN_GUTTER) & (width <= c("w") * P.COLUMN_MAX_GUTTER_SHARE) & (1 - c("crossing") / c("texts") >= P.COLUMN_PURITY) & (c("left") / c("n") >= P.COLUMN_SIDE_SHARE) & (c("right") / c("n") >= P.COLUMN_SIDE_SHARE)
    nth = F.row_number().over(Window.partitionBy("doc_id", "page", "factor").orderBy("g0"))
    return judged.where(good).withColumn("nth", nth).where(c("nth") < P.COLUMN_MOST).select("doc_id", "page", "factor", c("g0").alias("x0"), c("g1").alias("x1"), (1 - c("crossing") / c("texts")).alias("purity"))


def columns(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Columns of each page and how stable their number is when the threshold moves by a fifth."""
    found = gutters(objects, pages).groupBy("doc_id", "page", "factor").agg((F.count(F.lit(1)) + 1).alias("columns"), F.sum(c("x1") - c("x0")).alias("width"), F.avg("purity").alias("purity"))
    grid = pages.select("doc_id", "page", F.explode(F.array(*[F.lit(f) for f in (1 - P.COLUMN_PERTURBATION, 1.0, 1 + P.COLUMN_PERTURBATION)])).alias("factor"))
    every = grid.join(found, ["doc_id", "page", "factor"], "left").select("doc_id", "page", "factor", F.coalesce("columns", F.lit(1)).alias("columns"), F.coalesce("width", F.lit(0.0)).alias("width"), F.coalesce("purity", F.lit(1.0)).alias("purity"))
    base = lambda n: F.max(F.when(c("factor") == 1.0, c(n)))
    page = every.groupBy("doc_id", "page").agg(base("columns").alias("columns"), base("width").alias("w"), base("purity").alias("p"), F.collect_list("columns").alias("all"))
    stable = F.size(F.filter("all", lambda n: n == c("columns"))) / F.size("all")
    return page.select("doc_id", "page", c("columns").cast("bigint").alias("columns"), X.score(c("w")).alias("gutter_width"), X.score(c("p")).alias("gutter_purity"), X.score(stable).alias("column_stability"))


def row_cells(objects: DataFrame) -> DataFrame:
    """Runs of one baseline become cells where they are at most CELL_GAP apart from the right edge so far."""
    row = Window.partitionBy("doc_id", "page", "y1").orderBy("x0", "seq")
    ink = objects.where(X.has_ink()).withColumn("edge", F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1)))
    cells = ink.withColumn("cell", F.sum(F.when(c("x0") - c("edge") <= P.CELL_GAP, 0).otherwise(1)).over(row))
    return cells.groupBy("doc_id", "page", "y1", "cell").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("runs"))


def page_types(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Layout type, uncertainty and risk of each page; a partial scan loses its trust."""
    overlaid = overlaid_text(objects).select("doc_id", "page").distinct().withColumn("overlaid", F.lit(True))
    joined = page_signals(objects, pages).join(columns(objects, pages), ["doc_id", "page"]).join(text_layer(objects).select("doc_id", "page", "verdict"), ["doc_id", "page"], "left").join(overlaid, ["doc_id", "page"], "left")
    scan = (c("image_area_ratio") >= P.PARTIAL_SCAN_IMAGE_SHARE) & (c("text_density") <= P.PARTIAL_SCAN_TEXT_DENSITY)
    verdict = F.when(scan & (c("verdict") == "trusted"), "partial").otherwise(F.coalesce("verdict", F.lit("absent")))
    kind = F.when((c("image_area_ratio") >= P.SCANNED_IMAGE_SHARE) & (c("text_density") < P.SCANNED_TEXT_DENSITY), "scanned").when(c("columns") == 2, "two_column").when(c("columns") > 2, "mixed").otherwise("single_column")
    doubt = F.when(c("v").isin("broken", "absent"), 1.0).otherwise(F.greatest(F.when(c("v") == "partial", 0.5).otherwise(0.0), F.when(c("columns") > 1, 1 - c("column_stability")).otherwise(0.0), F.when(c("overlaid"), 0.3).otherwise(0.0)))
    return joined.withColumn("v", verdict).select("doc_id", "page", c("v").alias("verdict"), kind.alias("layout_type"), X.score(doubt).alias("uncertainty")).withColumn("risk", F.when(c("uncertainty") >= 0.7, "high").when(c("uncertainty") >= 0.25, "medium").otherwise("low"))
