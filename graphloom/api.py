"""All operations under short names, with their usual arguments; a value for each vertex comes as a DataFrame (id, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import learn, simulate, sketch, traversal
from .operators.components import connected_components
from .operators.learn import federated_train
from .operators.pagerank import encrypted_pagerank, pagerank, tmr_pagerank
from .operators.partition import bisect, edge_cut
from .operators.privacy import dp_pagerank, gaussian_mechanism, laplace_mechanism, pagerank_sensitivity
from .operators.sketch import CountMinSketch, build_edge_sketch, estimate_degrees
from .operators.triangles import triangle_count
from .operators.verify import graph_fingerprint, zkp_commit, zkp_prove, zkp_verify
from .plans.graph import Graph
from .plans.match import match as execute_cypher
from .sources.edges import read_binary as load_graph_binary
from .sources.edges import read_edgelist
from .sources.edges import write_binary as save_graph_binary

__all__ = [
    "CountMinSketch", "Graph", "bfs", "bisect", "build_edge_sketch", "connected_components", "create_tiny_test_graph", "dp_pagerank", "edge_cut", "encrypted_pagerank", "estimate_degrees",
    "execute_cypher", "federated_train", "gaussian_mechanism", "gcn_forward_pass", "graph_fingerprint", "laplace_mechanism", "load_graph", "load_graph_binary", "pagerank", "pagerank_sensitivity",
    "quantum_grover_search", "query_edge_freq", "save_graph_binary", "simulate_lif_network", "sssp", "tmr_pagerank", "triangle_count", "zkp_commit", "zkp_prove", "zkp_verify",
]


def _session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def load_graph(filepath: str) -> Graph:
    return read_edgelist(_session(), filepath)


def create_tiny_test_graph() -> Graph:
    return Graph.tiny(_session())


def bfs(graph: Graph, source_vertex: int) -> DataFrame:
    return traversal.bfs(graph, source_vertex)


def sssp(graph: Graph, source_vertex: int, default_weight: float | None = None) -> DataFrame:
    return traversal.sssp(graph, source_vertex, default_weight)


def gcn_forward_pass(graph: Graph, node_features: DataFrame | list[float], layer_weight: float) -> DataFrame:
    """node_features: (id, x), or a list with the value of each id."""
    if isinstance(node_features, list):
        node_features = graph.spark.createDataFrame(list(enumerate(map(float, node_features))), "id long, x double")
    return learn.gcn_forward_pass(graph, node_features, layer_weight)


def quantum_grover_search(graph: Graph, target_vertex: int, iterations: int = 1) -> DataFrame:
    return simulate.quantum_grover_search(graph, target_vertex, iterations)


def simulate_lif_network(graph: Graph, time_steps: int = 100, input_current: float = 0.5, threshold: float = 1.0, leak_rate: float = 0.9, synaptic_weight: float = 0.2) -> DataFrame:
    return simulate.simulate_lif_network(graph, time_steps, input_current, threshold, leak_rate, synaptic_weight)


def query_edge_freq(edge_sketch: DataFrame, u: int, v: int) -> int:
    """About how often the edge occurs, by a sketch of build_edge_sketch: a look at one counter of each row."""
    pair = edge_sketch.sparkSession.createDataFrame([(u, v)], "src long, dst long")
    return sketch.query_edge_frequency(edge_sketch, pair).first()["estimate"]
