"""Connected components of an edge table by repeated contraction.

In each round every node points to the neighbour (or itself) that comes first
in an order drawn anew for the round, then to where that one points, and the
edges are rewritten between the nodes pointed to, until none is left.  The order is random, so that chains of
any numbering shrink by a constant share a round.  Each round is a
partial-aggregated group-by, a join of the pointers and two joins over the
remaining edges and ends in a written table; nothing but whether edges remain reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the component is its smallest node."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    labels, turn = None, 0
    while labels is None or not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("place"), F.col(c).alias("node"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy("a").agg(F.min(place("b")).alias("first")).select(F.col("a").alias("node"), F.least(place("a"), "first")["node"].alias("to"))
        points = materialize(points, "cc-points")
        # What the node pointed to points to: twice as far in one round.
        points = materialize(points.join(points.toDF("to", "beyond"), "to").select("node", F.col("beyond").alias("to")), "cc-jumps")
        if labels is None:
            labels = points.withColumnRenamed("to", "label")
        else:
            labels = labels.join(points.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        ends = edges.join(points.toDF("a", "ta"), "a").join(points.toDF("b", "tb"), "b")
        edges = materialize(ends.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        turn += 1
    labels = materialize(labels, "cc-labels")
    return materialize(labels.join(labels.groupBy("label").agg(F.min("node").alias("component")), "label").select("node", "component"), "cc-components")
