"""Bisection by greedy moves, and edge cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.store import stored

def edge_cut(graph: Graph, parts: DataFrame) -> DataFrame:
    """One row (edge_cut): edges between parts, halved, as undirected graphs store each twice."""
    side = lambda name, part: parts.select(F.col("id").alias(name), F.col("part").alias(part))
    both = graph.merged().join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return both.agg(F.floor(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("m"))), F.lit(0)) / 2).cast("long").alias("edge_cut"))


def bisect(graph: Graph, iterations: int = 10, exact: bool = True) -> DataFrame:
    """(id, part): halves by id, then vertices with more out-edges to the other part move, without regard to balance.

    exact sweeps over ids in order, each move seeing the earlier ones; that is sequential, so one task does it and must
    hold all different edges. exact=False is another rule for larger graphs, with other results: all even ids move at
    once, then all odd ones, and the work is spread.
    """
    n = graph.num_vertices()
    if exact:
        return _sweep(graph, n, iterations)
    edges = stored(graph.merged())
    parts = stored(graph.vertices.select("id", (F.col("id") >= n // 2).cast("int").alias("part")))
    for k in range(2 * iterations):
        other = edges.join(parts.toDF("dst", "there"), "dst").join(parts.toDF("src", "here"), "src")
        gain = other.groupBy(F.col("src").alias("id")).agg(F.sum(F.when(F.col("here") != F.col("there"), F.col("m")).otherwise(-F.col("m"))).alias("gain"))
        moves = (F.col("gain") > 0) & (F.col("id") % 2 == k % 2)
        new = stored(parts.join(gain, "id", "left").select("id", F.when(moves, 1 - F.col("part")).otherwise(F.col("part")).alias("part"), F.coalesce(moves, F.lit(False)).alias("moved")))
        still, parts = new.where("moved").isEmpty(), new.select("id", "part")
        if still and k % 2:
            break
    return parts


def _sweep(graph: Graph, n: int, iterations: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids = np.sort(pdf.loc[pdf["dst"].isna(), "src"].to_numpy(np.int64))
        edges = pdf[pdf["dst"].notna()].sort_values("src", kind="stable")
        src, dst, m = np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"].astype("int64")), edges["m"].to_numpy(np.int64)
        starts = np.searchsorted(src, np.arange(len(ids) + 1))
        part = (ids >= n // 2).astype(np.int64)
        for _ in range(iterations):
            moved = False
            for u in range(len(ids)):
                to = slice(starts[u], starts[u + 1])
                if m[to][part[dst[to]] != part[u]].sum() * 2 > m[to].sum():
                    part[u], moved = 1 - part[u], True
            if not moved:
                break
        return pd.DataFrame({"id": ids, "part": part.astype(np.int32)})

    rows = graph.merged().select("src", "dst", "m").union(graph.vertices.select("id", F.lit(None).cast("long"), F.lit(0).cast("long")))
    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "id long, part int")
