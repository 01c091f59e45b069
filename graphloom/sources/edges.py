"""Edge lists as text, Matrix Market files, the binary cache, and Parquet."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a, modulo
from ..plans.graph import Graph


def with_default_weight(edges: DataFrame) -> DataFrame:
    """edges with `weight`: as given, or else from 1 to 10 fixed by the two ends, wherever and in whatever order the edge is read."""
    hashed = edges.withColumn("_hash", fnv1a(F.shiftleft("src", 32).bitwiseXOR(F.col("dst"))))
    return hashed.withColumn("weight", F.coalesce("given", 1 + 9 * modulo(F.col("_hash"), 1_000_000) / 1e6))


def read_edgelist(spark: SparkSession, path: str, dense: bool = True, mtx: bool = False) -> Graph:
    """Lines `u v [w]`; empty lines, comments (% or #) and what isn't two numbers are skipped. Edges without a weight get one.

    mtx: a Matrix Market file, whose first line that isn't a comment is the size, and whose ids begin with 1.
    pos is the order within the files as far as Spark keeps it: exact for a file read as one partition.
    """
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    lines = lines.where(~F.col("value").rlike(r"^[%#]") & (F.trim("value") != ""))
    if mtx:
        first = lines.agg(F.min("pos")).first()[0]
        lines = lines.where(F.col("pos") != (-1 if first is None else first))
    part = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    number = lambda i: F.get(part, F.lit(i)).try_cast("long") - (1 if mtx else 0)
    edges = lines.select(number(0).alias("src"), number(1).alias("dst"), F.get(part, F.lit(2)).try_cast("double").alias("given"), "pos").where("src >= 0 and dst >= 0")
    return Graph.from_edges(with_default_weight(edges), dense)


def read_mtx(spark: SparkSession, path: str, dense: bool = True) -> Graph:
    return read_edgelist(spark, path, dense, mtx=True)


def write_graph(graph: Graph, path: str) -> None:
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def write_binary(graph: Graph, path: str) -> None:
    """The cache file that read_binary reads, ids being 0 to V - 1 and weights 0 where there are none; edges stand by (src, pos, dst).

    A single file is written by a single task, which streams sorted rows: offsets first, then ends, then weights.
    """
    size = struct.pack("<IQ", graph.num_vertices(), graph.num_edges())
    at = lambda kind, i, pos, j, whole, weight: [x.cast(t).alias(n) for x, t, n in zip((F.lit(kind), i, pos, j, whole, weight), ("int", "long", "long", "long", "long", "float"), ("kind", "i", "pos", "j", "whole", "weight"), strict=True)]
    none = F.lit(0)
    degrees = graph.degrees().select(*at(0, F.col("id"), none, none, F.col("degree"), none))
    ends = graph.edges.select(*at(1, F.col("src"), F.col("pos"), F.col("dst"), F.col("dst"), none))
    weights = graph.edges.select(*at(2, F.col("src"), F.col("pos"), F.col("dst"), none, F.coalesce("weight", F.lit(0.0))))
    rows = degrees.unionByName(ends).unionByName(weights).repartition(1).sortWithinPartitions("kind", "i", "pos", "j")

    def save(batches):
        import numpy as np
        import pandas as pd
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        total = 0
        with system.open_output_stream(name) as out:
            out.write(size + struct.pack("<Q", 0))
            for pdf in batches:
                for kind, part in pdf.groupby("kind", sort=True):
                    if kind == 0:
                        offsets = total + part["whole"].to_numpy(np.int64).cumsum()
                        total = int(offsets[-1])
                        out.write(offsets.astype("<u8").tobytes())
                    else:
                        out.write((part["whole"].to_numpy().astype("<u4") if kind == 1 else part["weight"].to_numpy().astype("<f4")).tobytes())
        yield pd.DataFrame({"edges": [total]})

    rows.mapInPandas(save, "edges long").collect()


def read_binary(spark: SparkSession, path: str) -> Graph:
    """The cache file of a graph: number of vertices (4 bytes) and edges (8), row offsets (8 each), ends (4 each), weights (4 each).

    The file is one row, so it must fit in a task; larger graphs are kept as Parquet. A short file raises ValueError.
    """
    import pandas as pd

    def unpack(batches):
        import numpy as np

        for pdf in batches:
            for data in pdf["content"]:
                v, e = struct.unpack_from("<IQ", data)
                if len(data) < 12 + 8 * (v + 1) + 8 * e:
                    raise ValueError("the file ends early")
                offsets = np.frombuffer(data, "<u8", v + 1, 12).astype(np.int64)
                ends = np.frombuffer(data, "<u4", e, 12 + 8 * (v + 1))
                weights = np.frombuffer(data, "<f4", e, 12 + 8 * (v + 1) + 4 * e)
                yield pd.DataFrame({"src": np.repeat(np.arange(v), np.diff(offsets)), "dst": ends.astype(np.int64), "weight": weights.astype(float), "pos": np.arange(e), "v": v})

    content = spark.read.format("binaryFile").load(path).select("content")
    head = content.select(F.substring("content", 1, 4).alias("v")).first()
    return Graph.from_edges(content.mapInPandas(unpack, "src long, dst long, weight double, pos long, v long"), vertices=spark.range(int.from_bytes(head["v"], "little")))


def topology(graph: Graph, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first edges by (pos, src, dst), and their vertices as (id, group)."""
    links = graph.edges.orderBy(F.col("pos").asc_nulls_last(), "src", "dst").limit(limit).select(F.col("src").alias("source"), F.col("dst").alias("target"))
    nodes = links.select(F.col("source").alias("id")).union(links.select("target")).distinct().select("id", F.lit(1).alias("group"))
    return nodes, links
