"""A deterministic typeset projection: source objects made from text rows, for work without page files.

Paragraphs end at newlines and words at spaces; twelve words make a line, 43 lines a page of 595 by 842 points. Decorators
by id add what real pages have: headings, list markers, code fonts, figures, two columns, annotations, drawings, turned
text, broken characters. ``tables`` lays every order out as a ruled table. No shuffle is needed until objects are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import object_id
from ..schema import KIND_CODES

WORDS, LINES, WIDTH, HEIGHT = 12, 43, 595.0, 842.0


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, source, para, l (line of the paragraph), k (line of the document), txt."""
    cut = (
        "flatten(transform(split(coalesce(text, ''), '\\n'), (p, i) -> transform(sequence(0, cast(ceil(size(split(p, ' ')) / 12.0) AS int) - 1), "
        "l -> struct(i AS para, l AS l, array_join(slice(split(p, ' '), 12 * l + 1, 12), ' ') AS txt))))"
    )
    return docs.select("doc_id", "source", F.posexplode(F.expr(cut)).alias("k", "line")).select("doc_id", "source", "line.para", "line.l", "k", "line.txt")


def _placed(docs: DataFrame) -> DataFrame:
    row = F.col("k") % LINES
    two = F.col("doc_id") % 7 == 0
    text = F.when((F.col("doc_id") % 13 == 0) & (F.col("k") % 2 == 0), F.concat("txt", F.lit(" ��"))).otherwise(F.col("txt"))
    left = F.when(two, 72 + 248 * (row % 2)).otherwise(72).cast("double")
    top = (60 + 16 * F.when(two, row - row % 2).otherwise(row)).cast("double")
    size = F.when((F.col("k") == 0) & (F.col("doc_id") % 3 == 0), 16.0).otherwise(10.0)
    return lines(docs).select(
        "doc_id", "source", "para", "l", "k",
        (F.floor(F.col("k") / LINES) + 1).cast("int").alias("page"), row.alias("row"),
        text.alias("text"), F.when(F.col("doc_id") % 11 == 0, "CourierNew").otherwise("Times").alias("font"), size.alias("size"),
        left.alias("x0"), top.alias("y0"), (left + F.least(F.when(two, 200).otherwise(451), 5 * F.length(text))).cast("double").alias("x1"), (top + 10).alias("y1"),
    )


def _object(rows: DataFrame, kind: str, at: tuple, text="", font="Times", size=10.0, order=0, turned=False) -> DataFrame:
    lit = lambda v: v if not isinstance(v, int | float | str) else F.lit(v)
    return rows.select(
        "doc_id", "page", F.lit(kind).alias("kind"), lit(order).cast("int").alias("ord"),
        *[lit(v).cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), at, strict=True)],
        lit(text).alias("text"), lit(font).alias("font"), lit(size).cast("double").alias("size"), F.lit(0.0 if turned else 1.0).alias("ta"), F.lit(1.0 if turned else 0.0).alias("tb"),
    )


def objects(docs: DataFrame) -> DataFrame:
    """Source objects of the projection (schema OBJECTS)."""
    body = _placed(docs)
    c = F.col
    page = body.groupBy("doc_id", "page").agg(F.first("source").alias("source"))
    first = docs.select("doc_id", F.lit(1).alias("page"))
    parts = [
        _object(body, "text", (c("x0"), c("y0"), c("x1"), c("y1")), c("text"), c("font"), c("size"), 11 + 2 * c("row")),
        _object(body.where("para % 5 = 4 AND l = 0"), "text", (c("x0") - 12, c("y0"), c("x0") - 7, c("y1")), "•", order=10 + 2 * c("row")),
        _object(page, "text", (72, 20, 72 + 5 * F.length("source"), 30), c("source"), order=0),
        _object(page, "text", (292, 806, 304, 816), c("page").cast("string"), order=1000),
        _object(first.where("doc_id % 4 = 0"), "text", (150, 560, 190, 570), "label", order=900),
        _object(first.where("doc_id % 4 = 0"), "text", (100, 645, 190, 655), "Figure 1: overview", order=901),
        _object(first.where("doc_id % 17 = 0"), "text", (20, 300, 30, 400), "side", order=950, turned=True),
        _object(first.where("doc_id % 4 = 0"), "image", (100, 500, 300, 640)),
        _object(first.where("doc_id % 6 = 0"), "annotation", (72, 60, 120, 70), "https://example.org"),
        _object(first.where("doc_id % 5 = 0"), "graphic", (72, 40, 523, 40.5), order=0),
        _object(first.where("doc_id % 5 = 0"), "graphic", (40, 60, 40.4, 760), order=1),
        _object(first.where("doc_id % 5 = 0"), "graphic", (400, 700, 440, 720), order=2),
    ]
    return numbered(parts)


def numbered(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    by_kind = Window.partitionBy("doc_id", "page", "kind").orderBy("ord", "x0", "y0")
    code = F.create_map(*[F.lit(v) for kv in KIND_CODES.items() for v in kv])[F.col("kind")]
    return every.withColumn("seq", F.row_number().over(by_kind) - 1).withColumn("obj_id", object_id(F.col("page"), code, F.col("seq")))


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page, width, height, rotation, source."""
    return lines(docs).groupBy("doc_id", "source", (F.floor(F.col("k") / LINES) + 1).cast("int").alias("page")).agg(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(0).alias("rotation"))


def line_order():
    """Lines of an order by number; numbers can repeat, so the other values decide then."""
    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


COLUMN_NAMES = ("part", "supp", "qty", "price", "flag")


def table_cells(lineitem: DataFrame) -> DataFrame:
    """order_id, r, c, text, x0, y0, x1, y1 of the text of each cell; row 0 has the column names."""
    nth = F.row_number().over(line_order())
    values = F.array(*[F.col(x).cast("string") for x in ("l_partkey", "l_suppkey")], F.col("l_quantity").cast("bigint").cast("string"), F.col("l_extendedprice").cast("bigint").cast("string"), F.col("l_returnflag"))
    body = lineitem.withColumn("r", nth).select(F.col("l_orderkey").alias("order_id"), "r", F.posexplode(values).alias("c", "text"))
    head = lineitem.select(F.col("l_orderkey").alias("order_id")).distinct().select("order_id", F.lit(0).alias("r"), F.posexplode(F.array(*map(F.lit, COLUMN_NAMES))).alias("c", "text"))
    left, top = 105 + 80 * F.col("c"), 104 + 20 * F.col("r")
    return body.unionByName(head).select("order_id", "r", "c", "text", left.cast("double").alias("x0"), top.cast("double").alias("y0"), (left + F.least(F.lit(70), 5 * F.length("text"))).cast("double").alias("x1"), (top + 10).cast("double").alias("y1"))


def table_rules(lineitem: DataFrame) -> DataFrame:
    """order_id, orientation, axis, lo, hi, thickness: rows + 2 horizontal and 6 vertical rules a table."""
    size = lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    h = size.select("order_id", F.lit("h").alias("orientation"), F.explode(F.expr("sequence(0, n + 1)")).alias("i"), F.lit(100).alias("lo"), F.lit(500).alias("hi"))
    v = size.select("order_id", F.lit("v").alias("orientation"), F.explode(F.expr("sequence(0, 5)")).alias("i"), F.lit(100).alias("lo"), (100 + 20 * (F.col("n") + 1)).alias("hi"))
    step = F.when(F.col("orientation") == "h", 20).otherwise(80)
    return h.unionByName(v).select("order_id", "orientation", (100 + step * F.col("i")).cast("double").alias("axis"), F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0.5).alias("thickness"))


def read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Objects and pages of the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return objects(docs), pages(docs)
