"""PageRank and what is built on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import bits_float, float_bits
from ..plans.graph import Graph
from ..plans.store import stored

#: Iterations that are planned as one job before the scores are stored.
TOGETHER = 5


def pagerank(graph: Graph, iterations: int = 20, damping: float = 0.85, dangling: str = "leak") -> DataFrame:
    """(id, score): a fixed number of iterations from 1/V. Mass at vertices without out-edges leaks, or is spread over all.

    Parallel edges are merged, and each edge's share of its source is found once and stored: an iteration is one join
    on the source and one sum by target, partly summed before the shuffle, so a hot target sends one row a task.
    """
    n = graph.num_vertices()
    merged = graph.merged()
    out = merged.groupBy("src").agg(F.sum("m").alias("deg"))
    share = stored(merged.join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")))
    ends = stored(graph.vertices.select("id").join(share.select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True)), "id", "left"))
    scores = ends.withColumn("score", F.lit(1.0 / max(n, 1)))
    for k in range(1, iterations + 1):
        sums = share.join(scores.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("into"))
        base = F.lit((1.0 - damping) / max(n, 1))
        if dangling == "redistribute":
            lost = scores.where("out is null").agg((F.coalesce(F.sum("score"), F.lit(0.0)) / n).alias("lost"))
            # One row beside every vertex.
            scores = ends.join(sums, "id", "left").join(F.broadcast(lost)).select("id", "out", (base + damping * (F.coalesce("into", F.lit(0.0)) + F.col("lost"))).alias("score"))
        else:
            scores = ends.join(sums, "id", "left").select("id", "out", (base + damping * F.coalesce("into", F.lit(0.0))).alias("score"))
        # Lost mass is a second use of the scores, which would double the plan with each iteration.
        if (k % TOGETHER == 0 or dangling == "redistribute") and k < iterations:
            scores = stored(scores)
    return scores.select("id", "score")


def pagerank_single(graph: Graph, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, score) in 32-bit floats, each sum in the order of (source, pos), bit for bit as a loop over the sources gives it.

    For commitments that must equal such a loop's. A target's in-edges are one array here, so it is for small graphs.
    """
    n = graph.num_vertices()
    kept, base = F.lit(damping).cast("float"), F.lit((1 - np.float32(damping)) / np.float32(max(n, 1))).cast("float")
    out = graph.edges.groupBy("src").agg(F.count("*").cast("float").alias("deg"))
    edges = stored(graph.edges.select("src", "dst", "pos").join(out, "src"))
    scores = graph.vertices.select("id", F.lit(np.float32(1) / np.float32(max(n, 1))).cast("float").alias("score"))
    for k in range(1, iterations + 1):
        push = (kept * (F.col("score") / F.col("deg")).cast("float")).cast("float")
        into = edges.join(scores.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list(F.struct("src", "pos", push.alias("push")))).alias("pushes"))
        total = F.aggregate("pushes", base, lambda a, x: (a + x["push"]).cast("float"))
        scores = graph.vertices.select("id").join(into, "id", "left").select("id", F.coalesce(total, base).alias("score"))
        if k % TOGETHER == 0 and k < iterations:
            scores = stored(scores)
    return scores


def encrypted_pagerank(graph: Graph, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """PageRank by the operations a homomorphic scheme would offer. A simulation: nothing is encrypted, nothing is secret."""
    return pagerank(graph, iterations, damping)


def tmr_pagerank(graph: Graph, iterations: int = 20, damping: float = 0.85, simulate_cosmic_ray: bool = False) -> DataFrame:
    """(id, score, fault): three copies of 32-bit scores and their bitwise majority; fault where a copy differs from it.

    The copies come from one stored result, as a second run may differ in the last bit and would look like a fault.
    The simulated ray flips bit 16 of the first copy of vertex 0.
    """
    bits = stored(pagerank(graph, iterations, damping).select("id", float_bits(F.col("score")).alias("b")))
    flipped = F.when((F.col("id") == 0) & F.lit(simulate_cosmic_ray), F.col("b").bitwiseXOR(F.lit(1 << 16))).otherwise(F.col("b"))
    a, b, c = F.col("first"), F.col("b"), F.col("b")
    vote = a.bitwiseAND(b).bitwiseOR(b.bitwiseAND(c)).bitwiseOR(c.bitwiseAND(a))
    voted = bits.withColumn("first", flipped).withColumn("vote", vote)
    return voted.select("id", bits_float(F.col("vote")).alias("score"), (F.col("first") != F.col("vote")).cast("int").alias("fault"))
