"""Edges that arrive over time: appended to a table, with snapshots and sketches of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sketch import EDGE_DEPTH, EDGE_WIDTH, cms_cells, edge_key
from ..plans.graph import Graph

SCHEMA = "src long, dst long, weight double"


def edge_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, num_vertices: int, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends edges whose ends are below num_vertices to the sink; others are dropped, copies kept. Ends with the input at hand."""
    valid = stream.where((F.col("src") >= 0) & (F.col("dst") >= 0) & (F.col("src") < num_vertices) & (F.col("dst") < num_vertices))
    return valid.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def freeze(spark: SparkSession, sink: str, num_vertices: int) -> Graph:
    """What the sink has now, as a graph of all vertices; weights are dropped."""
    edges = spark.read.schema(SCHEMA).parquet(sink)
    return Graph.from_edges(edges.select("src", "dst"), vertices=spark.range(num_vertices))


def sketch_updates(stream: DataFrame) -> DataFrame:
    """A running Count-Min sketch (row, col, cnt) of the edges of a stream, for output mode complete or update: its state has width * depth rows at most."""
    cells = cms_cells(stream.select(edge_key(F.col("src"), F.col("dst")).alias("item")), "item", EDGE_WIDTH, EDGE_DEPTH)
    return cells.groupBy("row", "col").agg(F.count("*").alias("cnt"))


def keep_sketch(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Keeps the running sketch of the stream's edges in a table of its own, written anew with each batch. Ends with the input at hand."""
    return (
        sketch_updates(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink)).start()
    )


def degree_updates(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
