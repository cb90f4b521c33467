"""Queries over the operators: the typeset projection of ``documents`` and the ruled tables of ``lineitem``, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import assembly, audit, furniture, layout, probes, tables
from ..sources import typeset

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def on_pages(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """A query over objects and pages of the projection."""
    return lambda spark, sf_dir: f(*typeset.read(spark, sf_dir))


def on_objects(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(typeset.read(spark, sf_dir)[0])


def on_lines(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def typeset_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return typeset._placed(docs).select("doc_id", "page", "k", "text", "x0", "y0", "x1", "y1", "size", "font")


def source_index(objects: DataFrame) -> DataFrame:
    return objects.select("doc_id", "page", "obj_id", "kind", "x0", "y0", "x1", "y1", F.sha2(c("text").cast("binary"), 256).alias("text_sha256"))


def visible_lengths(objects: DataFrame) -> DataFrame:
    return objects.where("kind = 'text'").select("doc_id", "obj_id", X.visible_length(c("text")).alias("n"), F.length("text").cast("long").alias("length"))


def visible_filter(objects: DataFrame) -> DataFrame:
    seen = (c("kind") == "text") & (X.visible_length(c("text")) > 0)
    return objects.groupBy("doc_id", "page").agg(F.count_if(X.has_ink()).alias("with_ink"), F.count_if(seen).alias("visible"), F.count_if((c("kind") == "text") & (c("text") == "")).alias("ignorable"))


def bbox_quantize(objects: DataFrame) -> DataFrame:
    q = lambda k: X.quantized(c(k) / 7)
    return objects.select("doc_id", "obj_id", q("x0").alias("x0"), q("y0").alias("y0"), F.greatest(q("x1"), q("x0") + 0.01).alias("x1"), F.greatest(q("y1"), q("y0") + 0.01).alias("y1"))


def font_buckets(objects: DataFrame) -> DataFrame:
    return objects.where("kind = 'text'").groupBy(X.font_bucket(c("size") * 1.03).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def list_markers(objects: DataFrame) -> DataFrame:
    return objects.where("kind = 'text'").where(X.is_list_marker(c("text"), c("font"))).select("doc_id", "page", "obj_id", "text")


def heading_markers(objects: DataFrame) -> DataFrame:
    t = X.trimmed(c("text"))
    return objects.where("kind = 'text'").where(X.is_heading_text(t) | X.is_numeric_heading(t)).select("doc_id", "obj_id", X.heading_level(t, F.lit(None).cast("int")).alias("level"))


def text_blocks(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks in reading order; greedy, hence without SQL and tested on hand-made pages."""
    sized = probes.columns(objects, pages).join(pages.select("doc_id", "page", "width"), ["doc_id", "page"])
    return layout.text_blocks(objects, sized).withColumn("obj_ids", F.array_join("obj_ids", ","))


def codepoint_rates(objects: DataFrame) -> DataFrame:
    return probes.text_layer(objects).select("doc_id", "page", "chars", "replacement", "cid", "suspicious")


def language_evidence(objects: DataFrame) -> DataFrame:
    return probes.text_layer(objects).where("gibberish = 1").select("doc_id", "page", "words", "odd_words")


def text_layer_verdict(objects: DataFrame) -> DataFrame:
    return probes.text_layer(objects).select("doc_id", "page", "statistical", "verdict")


def union_area(objects: DataFrame) -> DataFrame:
    return probes.union_area(objects.where(X.has_ink())).select("doc_id", "page", X.score(c("area")).alias("area"))


def column_histogram(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return probes.gutters(objects, pages, (1.0,)).select("doc_id", "page", X.score(c("x0")).alias("x0"), X.score(c("x1")).alias("x1"), X.score(c("purity")).alias("purity"))


def elements(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return assembly.ordered(assembly.classified(objects, pages))


def level_or_zero(frame: DataFrame) -> DataFrame:
    return frame.withColumn("level", F.coalesce("level", F.lit(0)))


def block_classify(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return level_or_zero(assembly.classified(objects, pages).select("doc_id", "page", "obj_id", "type", "level"))


def parents(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return assembly.heading_parents(elements(objects, pages))


def heading_jumps(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return assembly.heading_jumps(elements(objects, pages))


def parent_cycles(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return assembly.dangling_parents(parents(objects, pages)).groupBy().agg(F.count(F.lit(1)).alias("violations"))


def markdown_document(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return assembly.markdown_documents(elements(objects, pages))


def caption_targets(objects: DataFrame) -> DataFrame:
    captions = objects.where("kind = 'text' AND text LIKE 'Figure%'")
    return assembly.caption_targets(captions, objects.where("kind = 'image'"))


def list_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as list items: successive numbers are one list, an order is a document."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("nth", F.row_number().over(typeset.line_order()))
    number = c("nth").cast("string")
    items = lines.select(
        c("l_orderkey").alias("doc_id"), F.concat(F.lit("i"), number).alias("item_id"), F.lit(1).alias("page"), c("nth").alias("ord"), F.lit(None).cast("string").alias("parent_id"),
        F.when(c("l_returnflag") == "R", "-").otherwise(F.concat(number, F.lit("."))).alias("marker"),
        (100 + 20 * c("nth")).cast("double").alias("y0"), (110 + 20 * c("nth")).cast("double").alias("y1"), F.when(c("l_linestatus") == "F", 10.0).otherwise(3.0).alias("size"),
    )
    return assembly.list_containers(items)


def stable_ids(objects: DataFrame) -> DataFrame:
    """A draft for each two runs in order; the first run of a page makes one more draft, to collide."""
    runs = objects.where("kind = 'text'")
    pairs = runs.groupBy("doc_id", "page", F.floor(c("seq") / 2).alias("g")).agg(F.array_sort(F.collect_list("obj_id")).alias("ids"), *[F.min(k).alias(k) for k in ("x0", "y0", "x1", "y1")]).drop("g")
    again = pairs.where("ids[0] LIKE '%t0000'").select("doc_id", "page", "ids", (c("x0") + 1).alias("x0"), "y0", "x1", "y1")
    return assembly.stable_ids(pairs.unionByName(again))


def ledger(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return assembly.ledger_pages(assembly.ledger(objects, pages))


def dispositions(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return assembly.ledger(objects, pages).groupBy("doc_id", "disposition").agg(F.count(F.lit(1)).alias("n"))


def lost_kinds(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """A census of the projection, against its objects without the images and every third drawing."""
    kinds = {"text": ["text"], "path": ["graphic", "rule"], "image": ["image"], "annotation": ["annotation"]}
    count = lambda prefix: [F.count_if(c("kind").isin(*ks)).alias(prefix + n) for n, ks in kinds.items()]
    left = objects.where("kind != 'image' AND NOT (kind = 'graphic' AND seq % 3 = 1)")
    return assembly.lost_kinds(objects.groupBy("doc_id", "page").agg(*count("census_")), left.groupBy("doc_id", "page").agg(*count("")))


def object_coverage(objects: DataFrame) -> DataFrame:
    """Regions that name every fifth object twice and leave out every seventh."""
    regions = objects.where("seq % 7 != 3").select("doc_id", "page", "obj_id")
    return assembly.object_coverage(objects, regions.unionByName(objects.where("seq % 5 = 2 AND seq % 7 != 3").select("doc_id", "page", "obj_id")))


def kendall_distance(objects: DataFrame) -> DataFrame:
    """The first page of each document only, as the SQL has it; ``kendall_distance_pages`` takes all."""
    return kendall_distance_pages(objects.where("page = 1"))


def kendall_distance_pages(objects: DataFrame) -> DataFrame:
    """Order by object number against order by x, then y: what a wrong number of columns does."""
    texts = objects.where("kind = 'text'")
    by_x = texts.select("doc_id", "page", "obj_id", (c("x0") * 10_000_000 + c("y0") * 10_000 + c("seq")).alias("pos"))
    return assembly.kendall_distance(texts.select("doc_id", "page", "obj_id", c("seq").alias("pos")), by_x)


def page_verdict(objects: DataFrame, pages: DataFrame) -> DataFrame:
    layer = probes.text_layer(objects).select("doc_id", "page", "verdict")
    stable = probes.columns(objects, pages).select("doc_id", "page", (1 - c("column_stability")).alias("reading"))
    residuals = layer.join(object_coverage(objects).withColumnRenamed("residual", "coverage"), ["doc_id", "page"]).join(stable, ["doc_id", "page"])
    return assembly.page_verdict(residuals.withColumn("grid", F.lit(0.0)))


def page_status(objects: DataFrame, pages: DataFrame) -> DataFrame:
    verdicts = page_verdict(objects, pages).select("doc_id", "page", F.when(c("status") == "degraded", "warn").otherwise("info").alias("severity"))
    broken = probes.text_layer(objects).where("verdict = 'broken'").select("doc_id", "page", F.lit("error").alias("severity"))
    return assembly.page_status(verdicts.unionByName(broken))


def anchor_audit(objects: DataFrame) -> DataFrame:
    anchors = objects.select("doc_id", (c("page") + F.when(c("seq") % 11 == 5, 1).otherwise(0)).cast("int").alias("page"), "obj_id")
    return assembly.missing_anchors(anchors, objects)


def spans(lineitem: DataFrame) -> DataFrame:
    """Cells with spans that overlap where an order has a returned line: its second cell reaches over the third."""
    cells = typeset.table_cells(lineitem).select("order_id", "r", "c", "text")
    return cells.select("order_id", "r", "c", F.lit(1).alias("row_span"), F.when((c("c") == 1) & (F.max(F.when((c("c") == 4) & (c("text") == "R"), 1).otherwise(0)).over(Window.partitionBy("order_id", "r")) == 1), 2).otherwise(1).alias("col_span"))


def cross_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer as table parts on successive pages."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    parts = orders.select(
        c("o_custkey").alias("key"), F.row_number().over(w).alias("page"), F.when(c("o_orderkey") % 5 == 0, 400.0).otherwise(60.0).alias("y0"), F.when(c("o_orderkey") % 7 == 0, 500.0).otherwise(800.0).alias("y1"), F.lit(842.0).alias("height"),
        F.when(c("o_orderstatus") == "P", 4).otherwise(5).alias("cols"), F.when(c("o_orderstatus") == "F", "part|supp").otherwise("part|cost").alias("header"), (c("o_orderkey") % 2).cast("int").alias("header_rows"),
        (3 + c("o_orderkey") % 4).cast("int").alias("rows"), (100 + (c("o_orderkey") % 3)).cast("double").alias("first_edge"),
    )
    return tables.merge_across_pages(parts)


def borderless_vs_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a customer's open orders that no box of a finished order overlaps."""
    at = (c("o_orderkey") * 37) % 700
    boxes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        c("o_custkey").alias("key"), c("o_orderkey").alias("box"), "o_orderstatus", at.cast("double").alias("y0"), (at + 25).cast("double").alias("y1"),
        ((c("o_orderkey") * 13) % 300).cast("double").alias("x0"), ((c("o_orderkey") * 13) % 300 + 150).cast("double").alias("x1"),
    )
    return tables.without_overlap(boxes.where("o_orderstatus = 'O'"), boxes.where("o_orderstatus = 'F'")).select("key", "box", "x0", "y0")


def region_ids(objects: DataFrame) -> DataFrame:
    members = objects.where("kind = 'text'").select("doc_id", "page", F.floor(c("seq") / 4).cast("int").alias("region"), (-c("seq")).alias("pos"), "obj_id")
    return assembly.region_ids(members)


def accepted_pages(objects: DataFrame) -> DataFrame:
    return assembly.accepted_pages(objects.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n")), 60)


def missing_fields(objects: DataFrame) -> DataFrame:
    rows = objects.select("doc_id", "obj_id", F.when(c("kind") == "text", c("font")).alias("font"), F.when(c("text") != "", c("text")).alias("text"))
    return audit.missing_fields(rows, ["font", "text"]).groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n"))


def box_audit(objects: DataFrame, pages: DataFrame) -> DataFrame:
    return audit.boxes_on_page(objects.withColumn("x1", c("x1") + F.when(c("seq") % 9 == 4, 100).otherwise(0)), pages)


def queries() -> dict[str, Query]:
    rules = typeset.table_rules
    return {
        "typeset_runs": typeset_runs,
        "source_index": on_objects(source_index),
        "visible_length": on_objects(visible_lengths),
        "visible_filter": on_objects(visible_filter),
        "bbox_quantize": on_objects(bbox_quantize),
        "font_bucket": on_objects(font_buckets),
        "lane_assignment": on_pages(lambda o, p: assembly.lanes(o, p, 2)),
        "list_markers": on_objects(list_markers),
        "heading_markers": on_objects(heading_markers),
        "local_page_numbers": on_pages(probes.local_page_numbers),
        "thin_rules": on_objects(probes.thin_rules),
        "text_profile": on_objects(lambda o: level_or_zero(probes.text_profile(o))),
        "dominant_style": on_objects(probes.dominant_style),
        "language_profile": on_objects(probes.language_profile),
        "codepoint_rates": on_objects(codepoint_rates),
        "language_evidence": on_objects(language_evidence),
        "text_layer_verdict": on_objects(text_layer_verdict),
        "page_signals": on_pages(probes.page_signals),
        "union_area": on_objects(union_area),
        "overlaid_text": on_objects(probes.overlaid_text),
        "figure_owned_text": on_objects(probes.figure_owned_text),
        "column_histogram": on_pages(column_histogram),
        "column_stability": on_pages(probes.columns),
        "row_cells": on_objects(probes.row_cells),
        "page_layout_type": on_pages(probes.page_types),
        "furniture_clusters": on_pages(furniture.clusters),
        "furniture_modes": on_pages(furniture.modes),
        "continuations": on_pages(furniture.continuations),
        "block_classify": on_pages(block_classify),
        "heading_parents": on_pages(lambda o, p: level_or_zero(parents(o, p))),
        "heading_jumps": on_pages(heading_jumps),
        "parent_cycles": on_pages(parent_cycles),
        "markdown_document": on_pages(markdown_document),
        "caption_targets": on_objects(caption_targets),
        "list_containers": list_containers,
        "stable_ids": on_objects(stable_ids),
        "ledger": on_pages(ledger),
        "dispositions": on_pages(dispositions),
        "lost_kinds": on_pages(lost_kinds),
        "object_coverage": on_objects(object_coverage),
        "kendall_distance": on_objects(kendall_distance),
        "kendall_distance_pages": on_objects(kendall_distance_pages),
        "page_verdict": on_pages(page_verdict),
        "page_status": on_pages(page_status),
        "anchor_audit": on_objects(anchor_audit),
        "grid_intersections": on_lines(lambda t: tables.crossings(rules(t))),
        "grid_closure": on_lines(lambda t: tables.grid_closure(rules(t))),
        "rule_components": on_lines(lambda t: tables.rule_components(rules(t))),
        "cell_text": on_lines(lambda t: tables.cell_text(rules(t), typeset.table_cells(t))),
        "table_header_rows": on_lines(lambda t: tables.header_rows(typeset.table_cells(t))),
        "table_tiling": on_lines(lambda t: tables.tiling(spans(t))),
        "markdown_table": on_lines(lambda t: tables.markdown(typeset.table_cells(t))),
        "cross_page_tables": cross_page_tables,
        "text_blocks": on_pages(text_blocks),
        "table_roles": on_lines(lambda t: tables.roles(typeset.table_cells(t))),
        "borderless_vs_ruled": borderless_vs_ruled,
        "region_ids": on_objects(region_ids),
        "furniture_regions": on_pages(assembly.furniture_regions),
        "accepted_pages": on_objects(accepted_pages),
        "missing_fields": on_objects(missing_fields),
        "box_audit": on_pages(box_audit),
    }
