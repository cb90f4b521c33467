"""Hand-made rows at the thresholds."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import columns as X
from foliospark.operators import assembly, furniture, probes, tables
from foliospark.plans import queries
from foliospark.schema import OBJECTS

PAGES = "doc_id bigint, page int, width double, height double, rotation int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("x", "want"), [(1.005, 1.0), (2.675, 2.68), (-0.005, 0.0), (0.125, 0.13)])
def test_halves_round_up(spark, x, want):
    assert value(spark, X.quantized(F.lit(x))) == want


@pytest.mark.parametrize(("text", "n"), [("a b", 2), (" ﻿ ", 0), ("a😀b", 3), ("", 0)])
def test_visible_length(spark, text, n):
    assert value(spark, X.visible_length(F.lit(text))) == n


@pytest.mark.parametrize(("text", "font", "want"), [("•", "x", True), ("12.", "x", True), ("12", "x", False), ("", "Wingdings", True), ("", "Times", False), ("", "Wingdings", False), (" - ", "x", True)])
def test_list_markers(spark, text, font, want):
    assert value(spark, X.is_list_marker(F.lit(text), F.lit(font))) is want


@pytest.mark.parametrize(("text", "level"), [("IV. Results", 1), ("V. x", 1), ("B. Methods", 2), ("2 Intro", 1), ("2.1 Intro", 2), ("2.1.3 Intro", 3), ("plain", 1)])
def test_heading_levels(spark, text, level):
    assert value(spark, X.heading_level(F.lit(text), F.lit(None).cast("int"))) == level


def text(doc, page, seq, x0, y0, x1, y1, t="word", size=10.0, kind="text"):
    return (doc, page, kind, seq, f"p{page}_{kind[0]}{seq:04d}", float(x0), float(y0), float(x1), float(y1), t, "Times", size, 1.0, 0.0, None, None)


def test_union_area_counts_overlaps_once(spark):
    boxes = spark.createDataFrame([text(1, 1, 0, 0, 0, 10, 10), text(1, 1, 1, 5, 5, 15, 15), text(1, 1, 2, 0, 0, 10, 10), text(2, 1, 0, 0, 0, 2, 3)], OBJECTS)
    assert {(r.doc_id, r.area) for r in probes.union_area(boxes).collect()} == {(1, 175.0), (2, 6.0)}


def test_furniture_needs_enough_pages_and_keeps_duplicates_in_the_body(spark):
    pages = spark.createDataFrame([(d, p, 600.0, 800.0, 0) for d in (1, 2) for p in range(1, 8)], PAGES)
    rows = [text(1, p, 0, 10, 10, 60, 20, "Head") for p in (1, 2, 3)] + [text(1, 1, 1, 11, 10, 61, 20, "head")] + [text(2, p, 0, 10, 10, 60, 20, "Head") for p in (1, 2)] + [text(1, p, 5, 300, 780, 310, 790, str(p)) for p in range(1, 8)]
    objects = spark.createDataFrame(rows, OBJECTS)
    found = {(r.doc_id, r.type, r.key): r for r in furniture.clusters(objects, pages).collect()}
    assert set(found) == {(1, "header", "head"), (1, "page_number", "#")}
    assert found[1, "page_number", "#"].pages == 7 and found[1, "page_number", "#"].confidence == 1.0
    assert {(r.doc_id, r.obj_id) for r in furniture.body_objects(objects, pages).collect()} == {(1, "p1_t0001"), (2, "p1_t0000"), (2, "p2_t0000")}


def test_terminal_punctuation_stops_a_continuation(spark):
    pages = spark.createDataFrame([(d, p, 600.0, 800.0, 0) for d in (1, 2, 3) for p in (1, 2)], PAGES)
    rows = [text(d, 1, 0, 50, 760, 90, 770, t) for d, t in ((1, "it goes"), (2, "it ends."), (3, "- a list."))] + [text(d, 2, 0, 50, 50, 90, 60, "on") for d in (1, 2, 3)]
    found = {(r.doc_id, r.kind, r.confidence, r.objects) for r in furniture.continuations(spark.createDataFrame(rows, OBJECTS), pages).collect()}
    assert found == {(1, "paragraph", 0.72, "p1_t0000,p2_t0000"), (3, "list", 0.78, "p1_t0000,p2_t0000")}


def test_heading_parents_follow_levels(spark):
    rows = [(1, f"o{i}", i, "heading" if lv else "unknown", lv) for i, lv in enumerate([None, 1, None, 3, 2, None, 1, 2])]
    found = {r.obj_id: r.parent_id for r in assembly.heading_parents(spark.createDataFrame(rows, "doc_id bigint, obj_id string, ord int, type string, level int")).collect()}
    assert found == {"o0": None, "o1": None, "o2": "o1", "o3": "o1", "o4": "o1", "o5": "o4", "o6": None, "o7": "o6"}


def test_open_grid_has_low_closure(spark):
    rules = spark.createDataFrame([(1, "h", 0.0, 0.0, 50.0, 0.5), (1, "h", 10.0, 0.0, 100.0, 0.5), (1, "v", 0.0, 0.0, 10.0, 0.5), (1, "v", 100.0, 0.0, 10.0, 0.5)], "order_id bigint, orientation string, axis double, lo double, hi double, thickness double")
    assert tables.grid_closure(rules).first().closure == 0.75
    assert {r.component for r in tables.rule_components(rules).collect()} == {"h000000.00"}


def test_pipe_and_newline_are_escaped(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a|b"), (1, 0, 1, "c\nd"), (1, 1, 0, "1"), (1, 1, 1, "")], "order_id bigint, r int, c int, text string")
    assert tables.markdown(cells).first().markdown == "| a\\|b | c<br>d |\n| --- | --- |\n| 1 |  |"


def test_kendall_distance_of_every_page(spark):
    places = {(1, 1): [0, 50, 100], (1, 2): [100, 50, 0], (1, 3): [0, 100, 50, 75], (2, 2): [9, 0]}
    rows = [text(d, p, k, x, 0, x + 5, 10) for (d, p), xs in places.items() for k, x in enumerate(xs)]
    want = {}
    for page, xs in places.items():
        pairs = [(a, b) for k, a in enumerate(xs) for b in xs[k + 1 :]]
        want[page] = round(sum(a > b for a, b in pairs) / len(pairs), 6)
    found = queries.kendall_distance_pages(spark.createDataFrame(rows, OBJECTS)).collect()
    assert {(r.doc_id, r.page): r.distance for r in found} == want
