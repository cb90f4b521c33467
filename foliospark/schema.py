"""Schemas shared by sources and operators.

A source object is one text run, image, drawing, rule or annotation on a page; coordinates are points from the top left.
Tables are long: (doc_id, page) is the grain of page operators, (doc_id, page, kind, seq) that of objects.
"""

from __future__ import annotations

OBJECTS = (
    "doc_id bigint, page int, kind string, seq int, obj_id string, x0 double, y0 double, x1 double, y1 double, text string, font string, "
    "size double, ta double, tb double, orientation string, thickness double"
)
PAGES = "doc_id bigint, page int, width double, height double, rotation int"
ELEMENTS = "doc_id bigint, element_id string, page int, ord int, type string, level int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, marker string"

#: Letter of each object kind in an object id.
KIND_CODES = {"text": "t", "graphic": "g", "image": "i", "rule": "r", "annotation": "a"}
