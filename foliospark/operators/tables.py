"""Ruled tables: rule crossings, closure, cells, roles, tiling, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import columns as X

c = F.col


def crossings(rules: DataFrame, key: str = "order_id") -> DataFrame:
    """Pairs of a horizontal and a vertical rule of one page that meet, within half their thickness and a tolerance."""
    h = rules.where("orientation = 'h'").select(key, c("axis").alias("y"), c("lo").alias("hlo"), c("hi").alias("hhi"), c("thickness").alias("ht"))
    v = rules.where("orientation = 'v'").select(key, c("axis").alias("x"), c("lo").alias("vlo"), c("hi").alias("vhi"), c("thickness").alias("vt"))
    slack = (c("ht") + c("vt")) / 2 + P.INTERSECTION_TOLERANCE
    return h.join(v, key).where((c("x") >= c("hlo") - slack) & (c("x") <= c("hhi") + slack) & (c("y") >= c("vlo") - slack) & (c("y") <= c("vhi") + slack)).select(key, "x", "y")


def grid_closure(rules: DataFrame, key: str = "order_id") -> DataFrame:
    """Rows, columns and the share of lattice points where rules meet, of each rule group."""
    axes = rules.groupBy(key).agg(F.count_distinct(F.when(c("orientation") == "h", c("axis"))).alias("ys"), F.count_distinct(F.when(c("orientation") == "v", c("axis"))).alias("xs"))
    met = crossings(rules, key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("closed"))
    return axes.join(met, key, "left").select(key, (c("ys") - 1).alias("rows"), (c("xs") - 1).alias("cols"), X.score(F.coalesce("closed", F.lit(0)) / (c("xs") * c("ys"))).alias("closure"))


def rule_components(rules: DataFrame, key: str = "order_id") -> DataFrame:
    """Rules of a page that meet, directly or through others: key, orientation, axis, component (least rule of it).

    A table's rules are few and all within a page, so labels spread by a bounded number of exchanges of minima between
    horizontal and vertical rules: two suffice where every pair meets, and each further exchange follows one more crossing.
    """
    met = crossings(rules, key)
    h = rules.where("orientation = 'h'").select(key, c("axis").alias("y"), F.concat(F.lit("h"), F.format_string("%09.2f", "axis")).alias("label"))
    v = rules.where("orientation = 'v'").select(key, c("axis").alias("x"), F.concat(F.lit("v"), F.format_string("%09.2f", "axis")).alias("label"))
    for _ in range(3):
        low = met.join(h, [key, "y"]).groupBy(key, "x").agg(F.min("label").alias("m"))
        v = v.join(low, [key, "x"], "left").select(key, "x", F.least("label", F.coalesce("m", "label")).alias("label"))
        low = met.join(v, [key, "x"]).groupBy(key, "y").agg(F.min("label").alias("m"))
        h = h.join(low, [key, "y"], "left").select(key, "y", F.least("label", F.coalesce("m", "label")).alias("label"))
    return h.select(key, F.lit("h").alias("orientation"), c("y").alias("axis"), c("label").alias("component")).unionByName(v.select(key, F.lit("v").alias("orientation"), c("x").alias("axis"), c("label").alias("component")))


def cell_text(rules: DataFrame, texts: DataFrame, key: str = "order_id") -> DataFrame:
    """Text of each grid cell: runs whose middle lies strictly inside, by line and x."""
    lines = lambda o, n: rules.where(f"orientation = '{o}'").select(key, c("axis").alias(n)).distinct().withColumn(f"{n}1", F.lead(n).over(Window.partitionBy(key).orderBy(n))).withColumn(f"{n}n", F.row_number().over(Window.partitionBy(key).orderBy(n)) - 1).where(f"{n}1 IS NOT NULL")
    grid = lines("h", "gy").join(lines("v", "gx"), key)
    mx, my = (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    placed = texts.select(key, "text", "x0", "y1", mx.alias("mx"), my.alias("my")).join(grid, key).where((c("mx") > c("gx")) & (c("mx") < c("gx1")) & (c("my") > c("gy")) & (c("my") < c("gy1")))
    return placed.groupBy(key, c("gyn").alias("r"), c("gxn").alias("c")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", "x0", "text"))), lambda t: t["text"]), "").alias("text"))


def looks_numeric(text):
    t = X.trimmed(text)
    return (t != "") & t.rlike(P.NUMERIC_CELL)


def header_rows(cells: DataFrame, key: str = "order_id") -> DataFrame:
    """Rows that look like headers: mostly words, before a row that is mostly numbers (its first column aside); and how many lead the table."""
    number = looks_numeric(c("text")).cast("int")
    row = cells.groupBy(key, "r").agg((1 - F.avg(number)).alias("words"), F.avg(F.when(c("c") > 0, number)).alias("numbers"))
    w = Window.partitionBy(key).orderBy("r")
    like = row.withColumn("header_like", (c("words") >= P.HEADER_SHARE) & (F.coalesce(F.lead("numbers").over(w), F.lit(0.0)) >= P.HEADER_SHARE))
    lead = F.sum(F.when(c("header_like"), 0).otherwise(1)).over(w) == 0
    return like.select(key, "r", "header_like", lead.alias("leading"))


def roles(cells: DataFrame, key: str = "order_id") -> DataFrame:
    """Role of each cell: column header in leading header rows, section header in later ones, row header in the first column."""
    joined = cells.join(header_rows(cells, key), [key, "r"])
    role = F.when(c("leading"), "column_header").when(c("header_like"), "section_header").when(c("c") < 1, "row_header").otherwise("data")
    return joined.select(key, "r", "c", role.alias("role"), (role != "data").alias("is_header"))


def without_overlap(candidates: DataFrame, taken: DataFrame, key: str = "key") -> DataFrame:
    """Candidate boxes that overlap none of the taken boxes of their key (ruled tables win over borderless ones)."""
    t = taken.select(c(key).alias("k"), *[c(n).alias(f"t{n}") for n in ("x0", "y0", "x1", "y1")])
    meets = (c(key) == c("k")) & (c("x0") < c("tx1")) & (c("x1") > c("tx0")) & (c("y0") < c("ty1")) & (c("y1") > c("ty0"))
    return candidates.join(t, meets, "left_anti")


def tiling(cells: DataFrame, key: str = "order_id") -> DataFrame:
    """Cells of a table that are covered not exactly once; spans are r, c, row_span, col_span."""
    size = cells.groupBy(key).agg(F.max(c("r") + c("row_span")).alias("rows"), F.max(c("c") + c("col_span")).alias("cols"))
    all_ = size.select(key, F.explode(F.expr("sequence(0, rows - 1)")).alias("r"), "cols").select(key, "r", F.explode(F.expr("sequence(0, cols - 1)")).alias("c"))
    used = cells.select(key, F.explode(F.expr("sequence(r, r + row_span - 1)")).alias("r"), "c", "col_span").select(key, "r", F.explode(F.expr("sequence(c, c + col_span - 1)")).alias("c"))
    return all_.join(used.groupBy(key, "r", "c").agg(F.count(F.lit(1)).alias("n")), [key, "r", "c"], "left").select(key, "r", "c", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).where("n != 1")


def markdown(cells: DataFrame, key: str = "order_id") -> DataFrame:
    """Pipe table of each table, with a separator after its first row."""
    text = F.replace(F.replace(c("text"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    row = cells.groupBy(key, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", text.alias("t")))), lambda x: x["t"]).alias("ts"))
    bar = lambda a: F.concat(F.lit("| "), F.array_join(a, " | "), F.lit(" |"))
    line = F.when(c("r") == 0, F.concat(bar(c("ts")), F.lit("\n"), bar(F.transform("ts", lambda _: F.lit("---"))))).otherwise(bar(c("ts")))
    return row.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "\n").alias("markdown"))


def merge_across_pages(parts: DataFrame) -> DataFrame:
    """Chains of table parts on successive pages: key, part, chain (first part), row_offset, dropped header rows.

    ``parts`` has key, part, page, y0, y1, height, cols, header (text of the header rows or null), header_rows, rows, first_edge.
    """
    w = Window.partitionBy("key").orderBy("page")
    before = lambda n: F.lag(n).over(w)
    same_header = (c("header_rows") > 0) & (before("header_rows") == c("header_rows")) & (before("header") == c("header"))
    linked = (
        (before("page") == c("page") - 1) & (before("y1") >= before("height") * (1 - P.TABLE_EDGE)) & (c("y0") <= c("height") * P.TABLE_EDGE)
        & (before("cols") == c("cols")) & (F.abs(before("first_edge") - c("first_edge")) <= P.TABLE_COLUMN_TOLERANCE) & ((c("header_rows") == 0) | same_header)
    )
    found = parts.withColumn("linked", F.coalesce(linked, F.lit(False))).withColumn("dropped", F.when(c("linked") & same_header, c("header_rows")).otherwise(0))
    chained = found.withColumn("chain", F.sum(F.when(c("linked"), 0).otherwise(1)).over(w))
    inside = Window.partitionBy("key", "chain").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return chained.select("key", "page", "chain", "dropped", (F.coalesce(F.sum(c("rows") - c("dropped")).over(inside), F.lit(0)) - c("dropped")).alias("row_offset"))
