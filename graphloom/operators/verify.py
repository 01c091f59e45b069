"""Commitments to scores and checks of them. Hash chains, not zero-knowledge proofs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import OFFSET, PRIME
from ..plans.graph import Graph

_ALL = (1 << 64) - 1
#: Fixed value: the blinding used unless another is given.
RANDOMNESS = 0xDEADBEEFCAFEBABE


@dataclass(frozen=True)
class Commitment:
    commitment_hash: int
    randomness: int
    num_vertices: int


@dataclass(frozen=True)
class Proof:
    proof_hash: int
    challenge: int
    is_valid: bool = True


def chain(words: DataFrame, order: list[str], value: str, start: int = OFFSET) -> int:
    """FNV-1a over a column of numbers in that order. Each step needs the one before, so sorted rows run through one task, which holds one batch."""

    def run(batches):
        h, n = start, 0
        for pdf in batches:
            for x in pdf["_word"].to_numpy(np.uint64).tolist():
                h = (h ^ x) * PRIME & _ALL
            n += len(pdf)
        yield pd.DataFrame({"h": [str(h)], "n": [n]})

    rows = words.select(*order, F.col(value).alias("_word")).repartition(1).sortWithinPartitions(*order).mapInPandas(run, "h string, n long").collect()
    return int(rows[0]["h"]) if rows else start


def _folded(h: int, *words: int) -> int:
    for w in words:
        h = (h ^ w) * PRIME & _ALL
    return h


def _bits(x: float) -> int:
    return int(np.float32(x).view(np.uint32))


def _scores_chain(scores: DataFrame) -> int:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "bits": pdf["score"].astype(np.float32).to_numpy().view(np.uint32).astype(np.int64)})

    return chain(scores.select("id", F.col("score").cast("float").alias("score")).mapInPandas(run, "id long, bits long"), ["id"], "bits")


def zkp_commit(scores: DataFrame, randomness: int = RANDOMNESS) -> Commitment:
    """The hash of the scores' 32-bit floats in the order of ids, then of the blinding."""
    return Commitment(_folded(_scores_chain(scores), randomness & _ALL), randomness, scores.count())


def graph_fingerprint(graph: Graph) -> int:
    """The hash of the row offsets and then of the ends of edges by (source, order of input)."""
    from pyspark.sql import Window

    # Offsets: how many edges begin before each vertex. The running sum is over blocks of ids, then within them.
    block = F.floor(F.col("id") / 65_536)
    d = graph.degrees().withColumn("block", block)
    sums = d.groupBy("block").agg(F.sum("degree").alias("s"))
    before = sums.select("block", F.coalesce(F.sum("s").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ends = d.join(before, "block").select("id", (F.col("before") + F.sum("degree").over(Window.partitionBy("block").orderBy("id"))).alias("end"))
    h = chain(ends.withColumn("end", F.col("end").cast("long")), ["id"], "end", _folded(OFFSET, 0))
    return chain(graph.edges.select("src", "pos", "dst"), ["src", "pos", "dst"], "dst", h)


def _challenged(scores: DataFrame, challenge: int, randomness: int) -> int:
    return _folded(_scores_chain(scores), _bits(np.float32(challenge % 1_000_000) / np.float32(1_000_000)), randomness ^ challenge)


def zkp_prove(graph: Graph, commitment: Commitment, scores: DataFrame) -> Proof:
    challenge = graph_fingerprint(graph) ^ commitment.commitment_hash
    return Proof(_challenged(scores, challenge, commitment.randomness), challenge)


def zkp_verify(graph: Graph, commitment: Commitment, proof: Proof) -> bool:
    """What can be seen without the scores: the proof is marked valid, and neither its hash nor the challenge is zero."""
    return proof.is_valid and proof.proof_hash != 0 and (graph_fingerprint(graph) ^ commitment.commitment_hash) != 0


def zkp_open(graph: Graph, commitment: Commitment, proof: Proof, scores: DataFrame) -> bool:
    """Whether commitment and proof are those of these scores and this graph."""
    return zkp_commit(scores, commitment.randomness) == commitment and zkp_prove(graph, commitment, scores) == replace(proof, is_valid=True) and proof.is_valid
