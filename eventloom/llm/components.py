"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node in ``edges`` (columns a, b): the smallest node it is connected to.

    In each round every node points at its smallest smaller neighbour, pointers are followed to their ends, and the other edges get
    the ends in place of their nodes. Edges inside one component vanish and the nodes that are left at most halve, so edges shrink
    from round to round and no join makes more rows than there are edges or nodes. Edges from a node to itself only name it.
    Rounds are written to the shared folder; only whether something is left reaches the driver.
    """
    given = stage(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges")
    rest, labels = given.filter("high <> low"), None
    while True:
        ends = _ends(stage(rest.groupBy("high").agg(F.min("low").alias("label")).withColumnRenamed("high", "node"), "pointers"))
        if labels is None:
            labels = ends
        else:
            further = ends.select(F.col("node").alias("label"), F.col("label").alias("further"))
            moved = labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
            labels = stage(moved.union(ends).groupBy("node").agg(F.min("label").alias("label")), "labels")
        for side in ("high", "low"):
            named = ends.select(F.col("node").alias(side), "label")
            rest = rest.join(named, side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
        rest = rest.filter("high <> low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low"))
        rest = stage(rest.distinct(), "edges")
        if rest.isEmpty():
            break
    smallest = given.select(F.explode(F.array("high", "low")).alias("node")).distinct().join(labels, "node", "left")
    return smallest.select("node", F.coalesce("label", "node").alias("label"))


def _ends(pointers: DataFrame) -> DataFrame:
    """``node, label`` with every pointer followed to its end, by jumping: rounds grow with the logarithm of the longest path."""
    while True:
        hop = pointers.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = stage(pointers.join(hop, "label", "left").select("node", F.coalesce("further", "label").alias("label"), "further"), "pointers")
        pointers = jumped.drop("further")
        if jumped.filter("further IS NOT NULL").isEmpty():
            return pointers
