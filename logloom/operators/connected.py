"""Connected parts of an undirected graph, for graphs over clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.scratch import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(node, part) of edges (a long, b long): the part is the smallest node that can be reached.

    Each round every node takes the smallest part of its neighbours, then the
    part of that part; both are aggregates and joins, and a round ends in a
    written table.
    """
    both = materialize(edges.union(edges.select("b", "a")).filter("a <> b").distinct(), "parts-edges")
    parts = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("part")), "parts")
    while True:
        near = both.join(parts.toDF("b", "part"), "b").groupBy("a").agg(F.min("part").alias("near"))
        step = parts.join(near, parts["node"] == near["a"]).select("node", F.col("part").alias("old"), F.least("part", "near").alias("part"))
        jump = parts.select(F.col("node").alias("part"), F.col("part").alias("beyond"))
        step = materialize(step.join(jump, "part", "left").select("node", "old", F.coalesce("beyond", "part").alias("part")), "parts")
        parts = step.select("node", "part")
        if step.filter("part <> old").isEmpty():
            return parts
