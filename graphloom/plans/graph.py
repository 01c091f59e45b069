"""A graph as two DataFrames: vertices (id, properties) and directed edges (src, dst, weight, pos)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Directed, with parallel edges and self-loops; weight is null where edges have none; pos is the order of input.

    A dense graph has all ids from 0 to the largest seen, gaps being vertices without edges; otherwise those seen.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, dense: bool = True, vertices: DataFrame | None = None) -> Graph:
        spark = edges.sparkSession
        named = edges.select(
            F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"),
            (F.col("weight").cast("double") if "weight" in edges.columns else F.lit(None).cast("double")).alias("weight"),
            (F.col("pos").cast("long") if "pos" in edges.columns else F.lit(None).cast("long")).alias("pos"),
        ).where("src is not null and dst is not null")
        if vertices is None:
            if dense:
                top = named.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0
                vertices = spark.range(top + 1)
            else:
                vertices = named.select(F.col("src").alias("id")).union(named.select("dst")).distinct()
        return Graph(vertices, named)

    @staticmethod
    def tiny(spark: SparkSession) -> Graph:
        """Five vertices and six unweighted edges, for trying things out."""
        pairs = [(0, 1), (0, 2), (1, 3), (2, 1), (2, 4), (3, 4)]
        return Graph.from_edges(spark.createDataFrame([(u, v, i) for i, (u, v) in enumerate(pairs)], "src long, dst long, pos long"))

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def add_edges(self, edges: DataFrame) -> Graph:
        """With more edges; those with an end outside the graph are dropped, as ingestion does."""
        more = Graph.from_edges(edges, vertices=self.vertices).edges
        ids = self.vertices.select("id")
        more = more.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.vertices, self.edges.unionByName(more.select(*self.edges.columns)))

    def neighbors(self, vertex: int) -> DataFrame:
        return self.edges.where(F.col("src") == vertex).select("dst")

    def degrees(self) -> DataFrame:
        """(id, degree): out-edges, parallel ones counted, for every vertex."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def adjacency(self) -> DataFrame:
        """(id, neighbors) with sorted lists, empty ones too. A vertex's list is one row, as a printed row is."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
        return self.vertices.select("id").join(out, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<long>")).alias("neighbors"))

    def merged(self) -> DataFrame:
        """(src, dst, m): parallel edges as one with their number."""
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("m"))

    def symmetrized(self) -> Graph:
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "pos")
        return Graph(self.vertices, self.edges.unionByName(back))

    def with_properties(self, properties: DataFrame) -> Graph:
        """Properties (id, properties map) set on vertices; values given later win, key by key."""
        own = self.vertices if "properties" in self.vertices.columns else self.vertices.withColumn("properties", F.lit(None).cast("map<string,string>"))
        new = properties.select("id", F.col("properties").alias("_new"))
        both = own.join(new, "id", "left")
        old = F.coalesce("properties", F.create_map().cast("map<string,string>"))
        add = F.coalesce("_new", F.create_map().cast("map<string,string>"))
        kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(add, k))
        return Graph(both.select("id", F.map_concat(kept, add).alias("properties")), self.edges)

    def property(self, key: str) -> DataFrame:
        """(id, value): the empty string where the vertex or the key has none."""
        if "properties" not in self.vertices.columns:
            return self.vertices.select("id", F.lit("").alias("value"))
        return self.vertices.select("id", F.coalesce(F.try_element_at("properties", F.lit(key)), F.lit("")).alias("value"))

    def views(self) -> None:
        """Makes `vertices` and `edges` known to SQL."""
        self.vertices.createOrReplaceTempView("vertices")
        self.edges.createOrReplaceTempView("edges")
