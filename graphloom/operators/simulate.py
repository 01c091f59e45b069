"""Spiking networks and amplitude amplification."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.store import stored

#: Steps planned as one job before the state is stored.
TOGETHER = 10


def simulate_lif_network(graph: Graph, time_steps: int = 100, current: float = 0.5, threshold: float = 1.0, leak: float = 0.9, weight: float = 0.2) -> DataFrame:
    """(id, spikes): in each step m = m * leak + current + input; from the threshold on the vertex spikes, m is 0, and each out-edge brings weight in the next step.

    The edges have one more row a vertex, from it to itself, that carries its state on beside the spikes: so a step
    reads the state once, and is one join and one sum, partly summed before its shuffle.
    """
    own = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("m"))
    pairs = stored(graph.merged().select("src", "dst", F.lit(False).alias("own"), "m").unionByName(own))
    state = graph.vertices.select("id", F.lit(0.0).alias("level"), F.lit(0).cast("long").alias("heard"), F.lit(0).alias("spikes"))
    for t in range(1, time_steps + 1):
        level = F.col("level") * leak + current + F.col("heard") * F.lit(weight)
        state = state.select(F.col("id").alias("src"), level.alias("level"), "spikes").select("src", F.when(F.col("level") >= threshold, 0.0).otherwise(F.col("level")).alias("level"), (F.col("level") >= threshold).alias("fired"), "spikes")
        sent = state.join(pairs, "src").where("own or fired")
        state = sent.groupBy(F.col("dst").alias("id")).agg(
            F.max(F.when(F.col("own"), F.col("level"))).alias("level"), F.coalesce(F.sum(F.when(~F.col("own"), F.col("m"))), F.lit(0)).alias("heard"),
            F.max(F.when(F.col("own"), F.col("spikes") + F.col("fired").cast("int"))).alias("spikes"),
        )
        if t % TOGETHER == 0:
            state = stored(state)
    return state.select("id", "spikes")


def quantum_grover_search(graph: Graph, target_vertex: int, iterations: int = 1) -> DataFrame:
    """(id, probability) after amplitude amplification: in closed form, as all vertices but the target stay alike.

    iterations of 0 or less: the best number, floor(pi / 4 * sqrt(V)), 1 at least. A target outside leaves 1 / V each.
    """
    n = graph.num_vertices()
    k = iterations if iterations > 0 else max(1, math.floor(math.pi / 4 * math.sqrt(n)))
    if not 0 <= target_vertex < n:
        return graph.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("probability"))
    angle = (2 * k + 1) * math.asin(1 / math.sqrt(n))
    hit, miss = math.sin(angle) ** 2, math.cos(angle) ** 2 / max(n - 1, 1)
    return graph.vertices.select("id", F.when(F.col("id") == target_vertex, hit).otherwise(miss).alias("probability"))


class Encrypted:
    """A number in the place of a ciphertext: sums and products work, and it is read by decrypting. A simulation, without secrecy."""

    def __init__(self, value: float):
        self._value = float(value)

    def __add__(self, other: Encrypted) -> Encrypted:
        return Encrypted(self._value + other._value)

    def __mul__(self, factor: Encrypted | float) -> Encrypted:
        return Encrypted(self._value * (factor._value if isinstance(factor, Encrypted) else factor))

    def decrypt(self) -> float:
        return self._value
