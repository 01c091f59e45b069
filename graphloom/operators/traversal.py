"""Breadth-first search and shortest paths by frontiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.store import stored

#: Levels after which what has been visited is stored as one table again.
_COMPACT = 8
#: Vertices of a frontier that may be broadcast.
_SMALL = 500_000


def bfs(graph: Graph, source: int, mode: str = "push") -> DataFrame:
    """(id, dist): the least number of out-edges from the source, -1 where there is no path or no such source.

    push joins the frontier with its out-edges; pull joins the vertices not yet reached with their in-edges and the
    frontier. Both give the same. A level reads all edges; while its frontier has _SMALL vertices at most, that is
    broadcast and only the edges that leave it are shuffled, else both sides are. Each level is stored.
    """
    pairs = stored(graph.edges.select("src", "dst").where("src != dst").distinct())
    frontier = stored(graph.vertices.where(F.col("id") == source).select("id"))
    seen, level = [frontier.withColumn("dist", F.lit(0))], 0
    while size := frontier.count():
        level += 1
        visited = reduce(DataFrame.union, seen)
        ahead = frontier.withColumnRenamed("id", "src")
        if size <= _SMALL:
            ahead = F.broadcast(ahead)
        if mode == "pull":
            rest = graph.vertices.select("id").join(visited.select("id"), "id", "left_anti")
            step = pairs.join(ahead, "src", "left_semi").join(rest.withColumnRenamed("id", "dst"), "dst", "left_semi")
            step = step.select(F.col("dst").alias("id")).distinct()
        else:
            step = pairs.join(ahead, "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
        frontier = stored(step)
        seen.append(frontier.withColumn("dist", F.lit(level)))
        if len(seen) > _COMPACT:
            seen = [stored(reduce(DataFrame.union, seen))]
    found = reduce(DataFrame.union, seen)
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("dist", F.lit(-1)).alias("dist"))


def sssp(graph: Graph, source: int, default_weight: float | None = None) -> DataFrame:
    """(id, dist): the least sum of weights over out-edges, infinite where there is no path or no such source.

    Only vertices whose distance has fallen send along their edges. Negative weights are fine; a negative cycle that
    can be reached raises ValueError, as does an edge without a weight unless default_weight is given.
    """
    weight = F.col("weight") if default_weight is None else F.coalesce("weight", F.lit(float(default_weight)))
    pairs = stored(graph.edges.groupBy("src", "dst").agg(F.min(weight).alias("weight"), F.count_if(weight.isNull()).alias("none")))
    if not pairs.where("none > 0").isEmpty():
        raise ValueError("the graph has edges without a weight")
    limit = graph.num_vertices()
    dist = stored(graph.vertices.where(F.col("id") == source).select("id", F.lit(0.0).alias("dist")))
    changed, rounds = dist, 0
    while not changed.isEmpty():
        rounds += 1
        if rounds > limit:
            raise ValueError("a cycle of negative weight can be reached")
        new = pairs.join(changed.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("weight")).alias("new"))
        both = stored(dist.join(new, "id", "full").select("id", F.least("dist", "new").alias("dist"), F.coalesce(F.col("new") < F.col("dist"), F.col("dist").isNull()).alias("fell")))
        dist, changed = both.select("id", "dist"), both.where("fell").select("id", "dist")
    return graph.vertices.select("id").join(dist, "id", "left").select("id", F.coalesce("dist", F.lit(float("inf"))).alias("dist"))
