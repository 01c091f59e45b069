import subprocess
import sys

import pytest

from graphloom import api
from graphloom.operators import sketch


def ordered(df):
    return [r[1] for r in sorted(map(tuple, df.collect()))]


def test_names_and_defaults(spark, tmp_path):
    (tmp_path / "g.txt").write_text("0 1\n0 2\n1 3\n2 1\n2 4\n3 4\n")
    for g in (api.create_tiny_test_graph(), api.load_graph(str(tmp_path / "g.txt"))):
        assert ordered(api.bfs(g, source_vertex=0)) == [0, 1, 1, 2, 2]
        assert ordered(api.pagerank(g, iterations=20, damping=0.85)) == pytest.approx([0.03, 0.06091875, 0.04275, 0.081780938, 0.117682547])
        assert ordered(api.gcn_forward_pass(g, node_features=[1.0, 0.5, -0.2, 0.8, 0.1], layer_weight=0.5)) == pytest.approx([0.65, 0.65, 0.2, 0.45, 0.05])
    assert ordered(api.sssp(g, source_vertex=0))[0] == 0 and ordered(api.connected_components(g)) == [0] * 5
    assert ordered(api.simulate_lif_network(g, time_steps=100, input_current=0.5, threshold=1.0, leak_rate=0.9, synaptic_weight=0.2)) == [33, 49, 34, 49, 49]
    assert api.query_edge_freq(api.build_edge_sketch(g), 0, 1) == 1 and api.query_edge_freq(api.build_edge_sketch(g), 4, 0) == 0
    assert max(ordered(api.quantum_grover_search(g, target_vertex=2))) == pytest.approx(0.968)
    people = spark.createDataFrame([(0, {"name": "Alice", "age": "25"}), (1, {"name": "Bob", "age": "19"}), (2, {"name": "Charlie", "age": "30"})], "id long, properties map<string,string>")
    assert sorted(r.id for r in api.execute_cypher(g.with_properties(people), "MATCH (n) WHERE n.age > 20 RETURN n").collect()) == [0, 2]
    assert all(hasattr(api, name) for name in api.__all__)


def test_a_sketch_item_by_item(spark):
    s = api.CountMinSketch(width=64, depth=3)
    for i in range(200):
        s.update(i % 9, 2)
    s.update(-5)
    items = spark.createDataFrame([(i % 9,) for i in range(200) for _ in range(2)] + [(-5,)], "k long")
    assert sorted(map(tuple, s.rows(spark).collect())) == sorted(map(tuple, sketch.cms_build(items, "k", width=64, depth=3).collect()))
    assert s.query(3) >= 44 and api.CountMinSketch().query(1) == 0


def test_entry_without_the_training_data_operators():
    # A library that they need is not there: the graph queries still are.
    code = "import sys, warnings; warnings.simplefilter('ignore'); sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pagerank_cp' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
