"""The choice of an execution mode by the size of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from .traversal import bfs

#: The modes' labels and the reasons given, which are part of the result.
LABELS = ("CPU (Sequential)", "CPU (OpenMP)", "GPU (CUDA)")
_CONTENTION = "High atomic contention risk detected in power-law graph; OpenMP selected over CUDA."
_BANDWIDTH = "Low contention, high parallelism. CUDA selected for maximum memory bandwidth."
_MEMORY = "Graph exceeds VRAM capacity. Falling back to OpenMP CPU."
_CACHE = "Graph easily fits in CPU L3 Cache. Sequential execution prevents thread-spawning overhead."


def decision(sizes: DataFrame) -> DataFrame:
    """(mode, cpu, omp, cuda, reasoning, and the other columns) for rows with v and e, the numbers of vertices and edges."""
    v, e = F.col("v").cast("double"), F.col("e").cast("double")
    small, dense = e < 1e6, F.when(v > 0, e / v).otherwise(F.lit(0.0)) > 10
    # 8-byte offsets are counted as 4 bytes here: that is the rule.
    large = (v + 1) * 4 + e * 4 > 0.9 * 8 * 1024**3
    add = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    scored = sizes.withColumns({
        "cpu": F.lit(0.1) + add(small, 0.8),
        "omp": F.lit(0.5) + add(small, 0.3) + add(dense, 0.4),
        "cuda": F.lit(0.8) + add(small, -0.6) + add(dense, -0.4) + add(large, -10.0),
    })
    cpu_wins = (F.col("cpu") > F.col("omp")) & (F.col("cpu") > F.col("cuda"))
    mode = F.when(cpu_wins, LABELS[0]).when(F.col("omp") > F.col("cuda"), LABELS[1]).otherwise(LABELS[2])
    why = F.when(cpu_wins & small, _CACHE).when(large, _MEMORY).when(dense, _CONTENTION).otherwise(_BANDWIDTH)
    return scored.withColumn("mode", mode).withColumn("reasoning", why)


def scheduler_decision(graph: Graph) -> DataFrame:
    sizes = graph.vertices.agg(F.count("*").alias("v")).join(graph.edges.agg(F.count("*").alias("e")))
    return decision(sizes).select("mode", "cpu", "omp", "cuda", "reasoning")


def execute_bfs(graph: Graph, source: int) -> DataFrame:
    """Breadth-first search; on graphs for which the rule picks the accelerator, by pulling, which reads all in-edges at once."""
    mode = scheduler_decision(graph).first()["mode"]
    return bfs(graph, source, "pull" if mode == LABELS[2] else "push")
