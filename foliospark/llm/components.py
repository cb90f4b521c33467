"""Connected components of a graph of links, as joins and combined aggregations.

Every round reduces the links to links between labels, hooks each label to the least label it meets, follows the hooks
to their ends and relabels. Minima are combined before the shuffle and every join is between written tables,
so a vertex with very many links is split over tasks. The number of rounds is logarithmic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """v, label (least vertex reachable) for each vertex of ``links`` (a, b); null ends are ignored. Ends when no link is live."""
    links = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = materialize(links.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("label")), "labels")
    live = links
    while True:
        hooks = materialize(live.groupBy("a").agg(F.min("b").alias("to")), "hooks")
        if hooks.isEmpty():
            break
        while True:  # follow hooks to their ends; each step doubles the distance
            ends = hooks.alias("h").join(hooks.select(F.col("a").alias("x"), F.col("to").alias("beyond")), F.col("to") == F.col("x"), "left")
            ends = materialize(ends.select("a", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hooks")
            discard(hooks)
            hooks = ends
            if ends.where("moved").isEmpty():
                break
            hooks = materialize(ends.select("a", "to"), "hooks")
            discard(ends)
        relabelled = materialize(labels.join(hooks, F.col("label") == F.col("a"), "left").select("v", F.coalesce("to", "label").alias("label")), "labels")
        discard(labels)
        labels = relabelled
        side = lambda frame, c: frame.join(hooks.select(F.col("a").alias("x"), "to"), F.col(c) == F.col("x"), "left").withColumn(c, F.coalesce("to", c)).drop("x", "to")
        rest = side(side(live, "a"), "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        rest = materialize(rest, "live-links")
        discard(live, hooks)
        live = rest
    return labels
