"""Column functions of the document model: rounding, geometry, text tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def half_up(x: Column, scale: float) -> Column:
    """Nearest 1 / ``scale``, halves towards plus infinity."""
    return F.floor(x * F.lit(float(scale)) + 0.5) / F.lit(float(scale))


def score(x: Column) -> Column:
    return half_up(x, 1e6)


def quantized(x: Column) -> Column:
    """Coordinates have two decimals."""
    return half_up(x, 100)


def visible(text: Column) -> Column:
    return F.regexp_replace(text, P.WHITE, "")


def visible_length(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(visible(text)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{P.WHITE}+|{P.WHITE}+$", "")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def has_ink() -> Column:
    """Visible text with a box: what page probes look at."""
    return (F.col("kind") == "text") & (visible_length(F.col("text")) > 0) & (area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) > 0)


def font_bucket(size: Column) -> Column:
    return F.when(size > 0, F.floor(size / P.BUCKET + 0.5) * P.BUCKET).otherwise(0.0)


def is_list_marker(text: Column, font: Column) -> Column:
    t = trimmed(text)
    code = F.ascii(t)
    symbol = (F.length(t) == 1) & font.rlike(P.SYMBOL_FONT) & code.between(0xE000, 0xF8FF) & code.bitwiseAND(F.lit(255)).isin(*P.SYMBOL_CODES)
    return t.rlike(P.MARKER) | symbol


def is_heading_text(text: Column) -> Column:
    return text.rlike(P.PRIMARY_HEADING) | text.rlike(P.SECONDARY_HEADING)


def is_numeric_heading(text: Column) -> Column:
    return text.rlike(P.NUMERIC_HEADING) & (visible_length(text) <= P.NUMERIC_HEADING_MAX)


def heading_level(text: Column, ranked: Column) -> Column:
    """Level by numbering, else by font rank, else one."""
    number = F.regexp_extract(text, r"^([0-9]{1,2}(?:\.[0-9]{1,2})*)\s+[^0-9\s]", 1)
    return F.when(text.rlike(P.PRIMARY_HEADING), 1).when(text.rlike(P.SECONDARY_HEADING), 2).when(number != "", F.size(F.split(number, r"\."))).otherwise(F.coalesce(ranked, F.lit(1))).cast("int")


def anchor_hash(ids: Column) -> Column:
    """First eight digits of the SHA-1 of the least and the greatest object id."""
    return F.substring(F.sha1(F.concat(F.array_min(ids), F.lit("~"), F.array_max(ids)).cast("binary")), 1, 8)


def object_id(page: Column, code: Column, seq: Column) -> Column:
    return F.format_string("p%d_%s%04d", page, code, seq)
