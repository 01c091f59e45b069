"""A graph convolution and federated averaging over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.store import stored


def _gathered(graph: Graph, features: DataFrame) -> DataFrame:
    """(id, x, s): the own feature, and it plus those of all out-neighbours, parallel edges counted."""
    x = features.select("id", F.col("x").cast("double").alias("x"))
    into = graph.merged().join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("m") * F.col("x")).alias("into"))
    return graph.vertices.select("id").join(x, "id", "left").join(into, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"), (F.coalesce("x", F.lit(0.0)) + F.coalesce("into", F.lit(0.0))).alias("s"))


def gcn_forward_pass(graph: Graph, features: DataFrame, layer_weight: float) -> DataFrame:
    """(id, value): the larger of 0 and weight * (own feature + those of out-neighbours). features: (id, x); x is 0 where missing."""
    return _gathered(graph, features).select("id", F.greatest(F.lit(0.0), F.lit(float(layer_weight)) * F.col("s")).alias("value"))


def gcn_forward_vector(graph: Graph, features: DataFrame, layer_weight: float) -> DataFrame:
    """The same for features (id, x array<double>) of one length; vertices without one are left out."""
    x = features.select("id", F.posexplode(F.col("x").cast("array<double>")).alias("k", "x"))
    into = graph.merged().join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "k").agg(F.sum(F.col("m") * F.col("x")).alias("into"))
    value = F.greatest(F.lit(0.0), F.lit(float(layer_weight)) * (F.col("x") + F.coalesce("into", F.lit(0.0))))
    out = x.join(into, ["id", "k"], "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))).alias("kv"))
    return out.select("id", F.col("kv.v").alias("value"))


def shards(graph: Graph, nodes: int) -> DataFrame:
    """(id, node): consecutive ranges of ids of V / nodes, one at least, the last taking the rest."""
    size = max(1, graph.num_vertices() // nodes)
    return graph.vertices.select("id", F.least(F.floor(F.col("id") / size), F.lit(nodes - 1)).cast("int").alias("node"))


def seeded(graph: Graph, nodes: int = 4, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Features (id, x) and a first weight for each node: uniform 32-bit floats of the Mersenne Twister.

    The draws follow one another: the features of a node's vertices, then its weight, then those of the next node. They
    are a sequence, so one task makes them, some at a time.
    """
    n = graph.num_vertices()
    size = max(1, n // nodes)
    ends = [min((k + 1) * size, n) if k < nodes - 1 else n for k in range(nodes)]
    total = n + nodes

    def run(batches):
        import numpy as np
        import pandas as pd

        for _ in batches:
            twister = np.random.MT19937()
            twister._legacy_seeding(seed)
            for first in range(0, total, 1 << 20):
                draws = twister.random_raw(min(1 << 20, total - first)).astype(np.float32) / np.float32(2**32)
                yield pd.DataFrame({"at": np.arange(first, first + len(draws)), "x": np.minimum(draws, np.nextafter(np.float32(1), np.float32(0))).astype(float)})

    drawn = stored(graph.spark.range(1).coalesce(1).mapInPandas(run, "at long, x double"))
    weights = [end + k for k, end in enumerate(ends)]
    found = {r["at"]: r["x"] for r in drawn.where(F.col("at").isin(weights)).collect()}
    part = shards(graph, nodes)
    return part.withColumn("at", F.col("id") + F.col("node")).join(drawn, "at").select("id", "x"), [found[w] for w in weights]


def federated_train(graph: Graph, num_nodes: int = 4, num_rounds: int = 10, features: DataFrame | None = None, rate: float = 0.01, epochs: int = 5, start: float | list[float] = 0.5) -> dict:
    """weight, rounds, loss and nodes [(node, weight, loss)] after rounds of local epochs and size-weighted averages.

    A node has its range of vertices and the edges inside it. In an epoch out = max(0, w * s), loss is the mean square
    of out - x, and w falls by rate * 2 * (mean out - mean x) * mean x. As out is linear in w on either side of 0, the
    epochs need eight sums a node, found in one pass over the graph; the rounds are arithmetic on these few rows.
    Without features (id, x) they and the nodes' first weights are drawn by `seeded`.
    """
    if features is None:
        features, start = seeded(graph, num_nodes)
    part = shards(graph, num_nodes)
    inside = graph.edges.join(part.toDF("src", "a"), "src").join(part.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "weight", "pos")
    g = _gathered(Graph(graph.vertices, inside), features).join(part, "id")
    up, down = F.greatest("s", F.lit(0.0)), F.least("s", F.lit(0.0))
    sums = [F.avg(c).alias(n) for n, c in (("x", F.col("x")), ("xx", F.col("x") * F.col("x")), ("up", up), ("uu", up * up), ("ux", up * F.col("x")), ("down", down), ("dd", down * down), ("dx", down * F.col("x")))]
    rows = {r["node"]: r for r in g.groupBy("node").agg(F.count("*").alias("n"), *sums).collect()}
    weights = {k: start if isinstance(start, float) else start[k] for k in rows}
    total, weight, loss = sum(r["n"] for r in rows.values()), 0.0, 1.0
    last: list = []
    for _ in range(num_rounds):
        last = []
        for k, r in sorted(rows.items()):
            w, lost = weights[k], 1.0
            for _ in range(epochs):
                s, ss, sx = (r["up"], r["uu"], r["ux"]) if w >= 0 else (r["down"], r["dd"], r["dx"])
                lost = w * w * ss - 2 * w * sx + r["xx"]
                w -= rate * 2 * (w * s - r["x"]) * r["x"]
            last.append((k, w, lost))
        weight = sum(rows[k]["n"] * w for k, w, _ in last) / max(total, 1)
        loss = sum(rows[k]["n"] * lost for k, _, lost in last) / max(total, 1)
        weights = dict.fromkeys(rows, weight)
    return {"weight": weight, "rounds": num_rounds, "loss": loss, "nodes": last}
