"""Weakly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.store import stored

#: More rounds than any input needs: the groups halve in each.
_MOST = 60


def connected(links: DataFrame) -> DataFrame:
    """(node, group) for each node of links (a, b): the smallest node that it is connected with.

    In a round each group that has a smaller neighbour goes under the smallest one; pointers are then followed, two
    steps in one, until all end at a group that goes under none. Links inside a group are dropped and the rest become
    links of groups, of which at most half are left: a long path takes as many rounds as the logarithm of its length.
    """
    left = links.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x != y")
    point = stored(left.select(F.col("x").alias("node")).union(left.select("y")).distinct().withColumn("group", F.col("node")))
    for _ in range(_MOST):
        left = left.join(point.toDF("x", "gx"), "x").join(point.toDF("y", "gy"), "y").where("gx != gy")
        left = stored(left.select(F.least("gx", "gy").alias("x"), F.greatest("gx", "gy").alias("y")).distinct())
        if left.isEmpty():
            return point
        # Nothing is put under a larger group, so there is no circle.
        under, moving = stored(left.groupBy("y").agg(F.min("x").alias("to")).toDF("g", "to")), True
        while moving:
            up = under.toDF("to", "up")
            jumped = stored(under.join(up, "to", "left").select("g", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")))
            moving, under = not jumped.where("moved").isEmpty(), jumped.select("g", "to")
        point = stored(point.join(under, point["group"] == under["g"], "left").select("node", F.coalesce("to", "group").alias("group")))
    raise RuntimeError("components did not settle")


def connected_components(graph: Graph) -> DataFrame:
    """(id, component): the smallest id that the vertex is connected with, edges taken in both directions."""
    found = connected(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    return graph.vertices.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("group", "id").alias("component"))
