"""Noise for differential privacy."""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from .pagerank import pagerank


def _uniform(key: Column, seed: int, k: int) -> Column:
    """A number in (0, 1) fixed by seed, k and key: unlike rand(), the same however rows are partitioned or retried. From 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{k}|"), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _seed(seed: int | None) -> int:
    """A secret one unless given, so that the noise differs each time, as it should."""
    return secrets.randbits(62) if seed is None else seed


def laplace_mechanism(scores: DataFrame, epsilon: float, sensitivity: float, seed: int | None = None, value: str = "score", key: str = "id") -> DataFrame:
    """scores with Laplace noise of scale sensitivity / epsilon on each key's value."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    u = _uniform(F.col(key), _seed(seed), 0) - 0.5
    return scores.withColumn(value, F.col(value) - F.lit(sensitivity / epsilon) * F.signum(u) * F.ln(1 - 2 * F.abs(u)))


def gaussian_mechanism(scores: DataFrame, epsilon: float, delta: float, sensitivity: float, seed: int | None = None, value: str = "score", key: str = "id") -> DataFrame:
    """scores with normal noise, from two uniform numbers each."""
    if epsilon <= 0 or delta <= 0:
        raise ValueError("epsilon and delta must be positive")
    sigma, seed = sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon, _seed(seed)
    normal = F.sqrt(-2 * F.ln(_uniform(F.col(key), seed, 1))) * F.cos(2 * math.pi * _uniform(F.col(key), seed, 2))
    return scores.withColumn(value, F.col(value) + normal * sigma)


def pagerank_sensitivity(graph: Graph, damping: float = 0.85) -> float:
    n = graph.num_vertices()
    return 2 * damping / (n * (1 - damping)) if n else 0.0


def dp_pagerank(graph: Graph, epsilon: float, iterations: int = 20, damping: float = 0.85, seed: int | None = None) -> DataFrame:
    """(id, score): PageRank with Laplace noise, not below 0."""
    noisy = laplace_mechanism(pagerank(graph, iterations, damping), epsilon, pagerank_sensitivity(graph, damping), seed)
    return noisy.withColumn("score", F.greatest("score", F.lit(0.0)))
