import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import datasets
from graphloom.functions import hashing
from graphloom.operators import components, learn, pagerank, partition, privacy, scheduler, simulate, sketch, traversal, triangles, verify
from graphloom.plans.graph import Graph
from graphloom.plans.match import QuerySyntaxError, compile_predicate, match, parse_number
from graphloom.plans.profile import Profiler, environment
from graphloom.sources import edges as sources
from graphloom.streaming import ingest


@pytest.fixture(scope="module")
def tiny(spark):
    return Graph.tiny(spark)


def values(df, digits=None):
    rows = sorted(map(tuple, df.collect()))
    return [r[1] if digits is None else round(r[1], digits) for r in rows]


def random_graph(spark, seed, n=30, m=90):
    rng = random.Random(seed)
    e = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 9))) for _ in range(m)] + [(n - 1, 0, 1.0)]
    return e, Graph.from_edges(spark.createDataFrame(e, "src long, dst long, weight double"))


# --- golden values of the tiny graph


def test_pagerank(tiny):
    want = [0.03, 0.06091875, 0.04275, 0.081780938, 0.117682547]
    scores = values(pagerank.pagerank(tiny), 9)
    assert scores == pytest.approx(want, abs=1e-9)
    assert values(pagerank.encrypted_pagerank(tiny), 6) == [round(x, 6) for x in want]
    assert sum(values(pagerank.pagerank(tiny, 4, dangling="redistribute"))) == pytest.approx(1)


def test_bfs_both_ways(tiny):
    assert values(traversal.bfs(tiny, 0)) == values(traversal.bfs(tiny, 0, "pull")) == [0, 1, 1, 2, 2]
    assert values(traversal.bfs(tiny, 99)) == [-1] * 5
    assert values(scheduler.execute_bfs(tiny, 0)) == [0, 1, 1, 2, 2]


def test_sssp(tiny):
    assert values(traversal.sssp(tiny, 0, default_weight=1.0)) == [0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        traversal.sssp(tiny, 0)
    assert values(traversal.sssp(tiny, 77, default_weight=1.0)) == [math.inf] * 5


def test_negative_weights(spark):
    good = spark.createDataFrame([(0, 1, 5.0), (0, 2, 2.0), (2, 1, -4.0), (1, 3, 1.0)], "src long, dst long, weight double")
    assert values(traversal.sssp(Graph.from_edges(good), 0)) == [0, -2, 2, -1]
    with pytest.raises(ValueError):
        traversal.sssp(Graph.from_edges(good.union(spark.createDataFrame([(3, 2, 0.5)], good.schema).withColumn("dst", F.lit(2)))), 0)


def test_components_triangles_and_parts(tiny):
    assert values(components.connected_components(tiny)) == [0] * 5
    assert triangles.triangle_count(tiny).first()[0] == 0
    assert triangles.triangle_count(tiny, canonicalize=True).first()[0] == 1
    parts = partition.bisect(tiny)
    assert values(parts) == [1] * 5 and partition.edge_cut(tiny, parts).first()[0] == 0


def test_simulations(spark, tiny):
    x = spark.createDataFrame(list(enumerate([1.0, 0.5, -0.2, 0.8, 0.1])), "id long, x double")
    assert values(learn.gcn_forward_pass(tiny, x, 0.5), 6) == [0.65, 0.65, 0.2, 0.45, 0.05]
    assert [v[0] for v in values(learn.gcn_forward_vector(tiny, x.select("id", F.array("x").alias("x")), 0.5))] == pytest.approx([0.65, 0.65, 0.2, 0.45, 0.05])
    assert values(simulate.simulate_lif_network(tiny)) == [33, 49, 34, 49, 49]
    p = values(simulate.quantum_grover_search(tiny, 2), 6)
    assert p == [0.008, 0.008, 0.968, 0.008, 0.008]
    assert values(simulate.quantum_grover_search(tiny, 9)) == [0.2] * 5
    assert sum(values(simulate.quantum_grover_search(tiny, 2, 0))) == pytest.approx(1)
    assert ((simulate.Encrypted(2) + simulate.Encrypted(3)) * 0.5).decrypt() == 2.5


def test_redundant_copies(tiny):
    calm = pagerank.tmr_pagerank(tiny).collect()
    hit = pagerank.tmr_pagerank(tiny, simulate_cosmic_ray=True).collect()
    assert sum(r.fault for r in calm) == 0 and [(r.id) for r in hit if r.fault] == [0]
    assert sorted(r.score for r in calm) == sorted(r.score for r in hit) == pytest.approx([0.03, 0.04275, 0.06091875, 0.081780938, 0.117682547])


def test_privacy(tiny):
    assert privacy.pagerank_sensitivity(tiny) == pytest.approx(2.266666667)
    noisy = values(privacy.dp_pagerank(tiny, 1.0, seed=3))
    assert all(x >= 0 for x in noisy) and noisy == values(privacy.dp_pagerank(tiny, 1.0, seed=3))
    many = tiny.spark.range(20_000).select("id", F.lit(0.0).alias("score"))
    lap = np.array(values(privacy.laplace_mechanism(many, 2.0, 1.0, seed=1)))
    gauss = np.array(values(privacy.gaussian_mechanism(many, 2.0, 1e-5, 1.0, seed=1)))
    assert np.abs(lap).mean() == pytest.approx(0.5, rel=0.05) and gauss.std() == pytest.approx(math.sqrt(2 * math.log(1.25e5)) / 2, rel=0.05)
    for bad in (lambda: privacy.laplace_mechanism(many, 0, 1.0), lambda: privacy.gaussian_mechanism(many, 1.0, 0, 1.0)):
        with pytest.raises(ValueError):
            bad()


def test_commitments(tiny):
    assert verify.graph_fingerprint(tiny) == 0x6E11FD2BD2FF50BC
    scores = pagerank.pagerank(tiny)
    c = verify.zkp_commit(scores)
    p = verify.zkp_prove(tiny, c, scores)
    assert verify.zkp_verify(tiny, c, p) and verify.zkp_open(tiny, c, p, scores)
    assert not verify.zkp_open(tiny, c, p, scores.withColumn("score", F.col("score") * 1.001))
    # Known values of the chain over 32-bit scores, and of the proof.
    single = pagerank.pagerank_single(tiny)
    known = verify.zkp_commit(single)
    assert (known.commitment_hash, verify.zkp_prove(tiny, known, single).proof_hash) == (0x828B111045592392, 0x7E646400019B9D18)
    # The chain over the scores' bits, step by step.
    h = hashing.OFFSET
    for x in values(scores):
        h = (h ^ int(np.float32(x).view(np.uint32))) * hashing.PRIME % 2**64
    assert c.commitment_hash == (h ^ verify.RANDOMNESS) * hashing.PRIME % 2**64


def test_sketches(spark, tiny):
    assert values(sketch.estimate_degrees(tiny), 9) == [2.001955672, 1.000488599, 2.001955672, 1.000488599, 0.0]
    assert [f"{s:x}" for s in sketch.seeds(7)] == ["288d8bee49957ceb", "d8dcaa4228073331", "4ce8c80387f65a04", "bfd094b1326d7a84", "9901eaaf0cd0d464", "1ce291bf284ee2db", "5e11878507f4586"]
    s = sketch.build_edge_sketch(tiny)
    got = {(r.src, r.dst): r.estimate for r in sketch.query_edge_frequency(s, spark.createDataFrame([(0, 1), (4, 0)], "src long, dst long")).collect()}
    assert got == {(0, 1): 1, (4, 0): 0}
    items = spark.createDataFrame([(i % 17,) for i in range(500)], "k long")
    got = {r.item: r.estimate for r in sketch.cms_query(sketch.cms_build(items, "k", width=100, depth=3), items, "k", 100, 3).collect()}
    assert all(got[k] >= len(range(k, 500, 17)) for k in range(17))
    a, b = (sketch.hll_registers(spark.createDataFrame([(0, i) for i in r], "k long, v long"), "k", "v") for r in (range(0, 80), range(40, 120)))
    whole = sketch.hll_registers(spark.createDataFrame([(0, i) for i in range(120)], "k long, v long"), "k", "v")
    assert sorted(map(tuple, sketch.hll_merge(a, b).collect())) == sorted(map(tuple, whole.collect()))


def test_hashes(spark):
    rng = random.Random(1)
    xs = [0, 1, -1, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    got = df.select("x", hashing.fnv1a(F.col("x")).alias("h"), hashing.modulo(F.col("x"), 1000).alias("m"), hashing.modulo(F.col("x"), 4096).alias("p"), hashing.leading_zeros(F.col("x")).alias("z")).collect()
    for r in got:
        u = r.x % 2**64
        assert (hashing.unsigned(r.h), r.m, r.p, r.z) == (hashing.fnv1a_int(r.x), u % 1000, u % 4096, 64 - u.bit_length())
    assert hashing.signed(hashing.fnv1a_int(1)) == -8517097267634966620


def test_scheduler(spark, tiny):
    r = scheduler.scheduler_decision(tiny).first()
    assert (round(r.cpu, 6), round(r.omp, 6), round(r.cuda, 6), r.mode) == (0.9, 0.8, 0.2, "CPU (Sequential)")
    sizes = [(10, 200), (10**6, 2 * 10**6), (10**6, 2 * 10**7), (10**9, 3 * 10**9), (0, 0)]
    got = [r.mode for r in scheduler.decision(spark.createDataFrame(sizes, "v long, e long").coalesce(1)).collect()]
    assert got == ["CPU (OpenMP)", "GPU (CUDA)", "CPU (OpenMP)", "CPU (OpenMP)", "CPU (Sequential)"]


# --- the query surface


def test_match(spark):
    props = {0: {"age": "25"}, 1: {"age": "19"}, 2: {"age": " 30abc"}, 3: {"age": ""}, 4: {"age": "1e2"}, 5: {"age": "abc"}, 6: {}, 7: {"age": "nan"}, 8: {"age": "-inf"}}
    v = spark.createDataFrame(list(props.items()), "id long, properties map<string,string>")
    g = Graph(spark.range(10), Graph.tiny(spark).edges).with_properties(v)
    ids = lambda q, **k: sorted(r.id for r in match(g, q, **k).collect())
    assert ids("MATCH (n) WHERE n.age > 20 RETURN n") == [0, 2, 4]
    assert ids("MATCH (n) WHERE n.age < 20x RETURN n") == [1, 8]
    assert ids("MATCH (x) WHERE y.age == 25") == [0] and ids("MATCH (n) WHERE n.age > abc") == []
    assert ids("MATCH (n) WHERE n.age ~ 3", strict=False) == [] and ids("nonsense", strict=False) == []
    for bad in ("match (n) WHERE n.age > 20", "MATCH (n) WHERE n.age", "MATCH (n) WHERE n.age >= 20", "MATCH (n) WHERE age > 20"):
        with pytest.raises(QuerySyntaxError):
            match(g, bad)
    assert sorted(r.id for r in g.vertices.where(compile_predicate("age", "=", "")).collect()) == [3, 6, 9]
    assert parse_number(".5x") == 0.5 and parse_number("1e") == 1 and parse_number("e1") is None
    assert {r.id: r.value for r in g.property("age").collect()}[9] == ""
    again = g.with_properties(spark.createDataFrame([(0, {"age": "26", "name": "A"})], "id long, properties map<string,string>"))
    assert again.vertices.where("id = 0").first().properties == {"age": "26", "name": "A"}


# --- sources


def test_edge_lists(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\n% c\n\n0 1 2.5\n 0\t4\nbad line\n1 x\n3 1 7\n")
    g = sources.read_edgelist(spark, str(tmp_path / "g.txt"))
    rows = sorted(map(tuple, g.edges.select("src", "dst", "weight").collect()))
    assert [r[:2] for r in rows] == [(0, 1), (0, 4), (3, 1)] and rows[0][2] == 2.5 and rows[2][2] == 7 and 1 <= rows[1][2] <= 10
    assert g.num_vertices() == 5 and g.num_edges() == 3
    assert sources.read_edgelist(spark, str(tmp_path / "g.txt"), dense=False).num_vertices() == 4
    (tmp_path / "m.mtx").write_text("%%MatrixMarket x\n% c\n3 3 2\n1 2\n3 1 4.0\n")
    assert sorted((r.src, r.dst) for r in sources.read_mtx(spark, str(tmp_path / "m.mtx")).edges.collect()) == [(0, 1), (2, 0)]
    (tmp_path / "none.txt").write_text("# nothing\n")
    assert sources.read_edgelist(spark, str(tmp_path / "none.txt")).num_vertices() == 1
    sources.write_graph(g, str(tmp_path / "out"))
    assert sources.read_graph(spark, str(tmp_path / "out")).num_edges() == 3


def test_binary_cache(spark, tmp_path):
    data = struct.pack("<IQ", 4, 3) + np.array([0, 2, 2, 3, 3], "<u8").tobytes() + np.array([1, 3, 0], "<u4").tobytes() + np.array([1, 2, 3], "<f4").tobytes()
    (tmp_path / "g.bin").write_bytes(data)
    g = sources.read_binary(spark, str(tmp_path / "g.bin"))
    assert sorted((r.src, r.dst, r.weight, r.pos) for r in g.edges.collect()) == [(0, 1, 1, 0), (0, 3, 2, 1), (2, 0, 3, 2)] and g.num_vertices() == 4
    sources.write_binary(g, str(tmp_path / "again.bin"))
    assert (tmp_path / "again.bin").read_bytes() == data
    (tmp_path / "short.bin").write_bytes(data[:-5])
    with pytest.raises(Exception, match="ends early"):
        sources.read_binary(spark, str(tmp_path / "short.bin")).edges.collect()


def test_structure(spark, tiny):
    assert [(r.id, r.neighbors) for r in sorted(tiny.adjacency().collect())] == [(0, [1, 2]), (1, [3]), (2, [1, 4]), (3, [4]), (4, [])]
    nodes, links = sources.topology(tiny, 2)
    assert sorted(r.id for r in nodes.collect()) == [0, 1, 2] and links.count() == 2
    more = tiny.add_edges(spark.createDataFrame([(4, 0), (4, 9), (-1, 2)], "src long, dst long"))
    assert more.num_edges() == 7 and [r.dst for r in more.neighbors(4).collect()] == [0] and more.neighbors(50).collect() == []
    tiny.views()
    assert spark.sql("select count(*) from edges join vertices on id = src").first()[0] == 6
    prof = Profiler()
    with prof.span("work"):
        pass
    assert prof.events[0]["name"] == "work" and environment(spark)["version"] == spark.version


# --- against plain versions on random graphs


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    e, g = random_graph(spark, seed)
    n = 30
    score = [1 / n] * n
    deg = [sum(u == i for u, *_ in e) for i in range(n)]
    for _ in range(7):
        new = [0.15 / n] * n
        for u, v, _ in e:
            new[v] += 0.85 * score[u] / deg[u]
        score = new
    assert values(pagerank.pagerank(g, 7)) == pytest.approx(score)
    dist, hops, label = [math.inf] * n, [-1] * n, list(range(n))
    dist[3], hops[3] = 0, 0
    for _ in range(n):
        for u, v, w in e:
            dist[v] = min(dist[v], dist[u] + w)
            if hops[u] >= 0 and (hops[v] < 0 or hops[u] + 1 < hops[v]):
                hops[v] = hops[u] + 1
            label[u] = label[v] = min(label[u], label[v])
    assert values(traversal.sssp(g, 3)) == dist and values(traversal.bfs(g, 3)) == hops
    assert values(components.connected_components(g)) == label
    both = {(min(u, v), max(u, v)) for u, v, _ in e if u != v}
    count = sum({(a, b), (b, c), (a, c)} <= both for c in range(n) for b in range(c) for a in range(b))
    assert triangles.triangle_count(g, canonicalize=True).first()[0] == count
    once = Counter((u, v) for u, v, _ in e if u < v)
    assert triangles.triangle_count(g).first()[0] == sum(m * min(once[u, w], once[v, w]) for (u, v), m in once.items() for w in range(v + 1, n))
    part = [int(i >= n // 2) for i in range(n)]
    for _ in range(10):
        moved = False
        for u in range(n):
            out = [v for a, v, _ in e if a == u]
            if 2 * sum(part[v] != part[u] for v in out) > len(out):
                part[u], moved = 1 - part[u], True
        if not moved:
            break
    assert values(partition.bisect(g)) == part
    part = [int(i >= n // 2) for i in range(n)]
    for k in range(4):
        gain = Counter()
        for u, v, _ in e:
            gain[u] += 1 if part[u] != part[v] else -1
        part = [1 - p if i % 2 == k % 2 and gain[i] > 0 else p for i, p in enumerate(part)]
    assert values(partition.bisect(g, 2, exact=False)) == part
    level, heard, spikes = [0.0] * n, [0] * n, [0] * n
    for _ in range(25):
        level = [x * 0.9 + 0.5 + h * 0.2 for x, h in zip(level, heard, strict=True)]
        fired = [x >= 1 for x in level]
        heard = [sum(fired[u] for u, v, _ in e if v == i) for i in range(n)]
        level, spikes = [0.0 if f else x for x, f in zip(level, fired, strict=True)], [k + f for k, f in zip(spikes, fired, strict=True)]
    assert values(simulate.simulate_lif_network(g, 25)) == spikes


def test_federated_epochs(spark):
    e, g = random_graph(spark, 5)
    x = [((i * 7) % 11 - 3) / 10 for i in range(30)]
    got = learn.federated_train(g, features=spark.createDataFrame(list(enumerate(x)), "id long, x double"), rate=0.05, start=-0.1, num_rounds=3)
    node = [min(i // 7, 3) for i in range(30)]
    w = dict.fromkeys(range(4), -0.1)
    for _ in range(3):
        loss = {}
        for k in w:
            ids = [i for i in range(30) if node[i] == k]
            s = [x[i] + sum(x[v] for u, v, _ in e if u == i and node[v] == k) for i in ids]
            for _ in range(5):
                out = [max(0.0, w[k] * a) for a in s]
                loss[k] = np.mean([(o - x[i]) ** 2 for o, i in zip(out, ids, strict=True)])
                mean_x = np.mean([x[i] for i in ids])
                w[k] -= 0.05 * 2 * (np.mean(out) - mean_x) * mean_x
        size = [node.count(k) for k in range(4)]
        avg = sum(size[k] * w[k] for k in w) / 30
        total = sum(size[k] * loss[k] for k in w) / 30
        w = dict.fromkeys(w, avg)
    assert got["weight"] == pytest.approx(avg) and got["loss"] == pytest.approx(total)


def test_federated_training_as_it_comes(spark, tiny):
    drawn, weights = learn.seeded(tiny)
    assert values(drawn)[0] == pytest.approx(1608637542 / 2**32) and len(weights) == 4
    got = learn.federated_train(tiny)
    assert (round(got["weight"], 6), round(got["loss"], 6)) == (0.602699, 0.062009)
    # More nodes than vertices: the rest have none.
    small = Graph(spark.range(2), tiny.edges.limit(0))
    assert 0 < learn.federated_train(small, 4, 1)["weight"] < 1


def test_streams(spark, tmp_path):
    spark.createDataFrame([(0, 1, 1.0), (0, 1, 1.0), (1, 9, 1.0), (-1, 0, 1.0), (2, 0, 3.0)], ingest.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = ingest.edge_stream(spark, str(tmp_path / "in"))
    ingest.ingest(stream, 3, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    g = ingest.freeze(spark, str(tmp_path / "out"), 3)
    assert sorted((r.src, r.dst, r.weight) for r in g.edges.collect()) == [(0, 1, None), (0, 1, None), (2, 0, None)] and g.num_vertices() == 3
    q = ingest.sketch_updates(stream.where("src >= 0")).writeStream.outputMode("complete").format("memory").queryName("cms").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sketch.build_edge_sketch(Graph(spark.range(10), spark.read.parquet(str(tmp_path / "in")).where("src >= 0")))
    assert sorted(map(tuple, spark.table("cms").collect())) == sorted(map(tuple, want.collect()))


def test_triangles_in_buckets(spark):
    rng = random.Random(31)
    n, e = 40, [(0, v) for v in range(1, 40)]
    e += [(rng.randrange(n), rng.randrange(n)) for _ in range(300)] * 2 + [(7, 7)]
    g = Graph.from_edges(spark.createDataFrame(e, "src long, dst long"))
    both, once = {(min(p), max(p)) for p in e if p[0] != p[1]}, Counter(p for p in e if p[0] < p[1])
    simple = sum({(a, b), (b, c), (a, c)} <= both for c in range(n) for b in range(c) for a in range(b))
    stored = sum(m * min(once[u, w], once[v, w]) for (u, v), m in once.items() for w in range(v + 1, n))
    for bucket in (1 << 20, 40):
        found = triangles.triangle_count(g, canonicalize=True, bucket=bucket)
        assert found.first()[0] == simple and triangles.triangle_count(g, bucket=bucket).first()[0] == stored
        # No pair of edges goes through a shuffle: a join of them is what filled the disks.
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    none = Graph.from_edges(spark.createDataFrame([(3, 3), (4, 2)], "src long, dst long"))
    assert triangles.triangle_count(none).first()[0] == triangles.triangle_count(none, canonicalize=True).first()[0] == 0


def test_copurchase_of_odd_rows(spark, tmp_path):
    rows = [(1, 5), (1, 3), (1, 5), (1, None), (None, 3), (None, 9), (2, 3), (2, 5), (2, 4), (3, 8), (4, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    g = datasets.copurchase(spark, str(tmp_path))
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(3, 4), (3, 5), (4, 5)] and g.num_vertices() == 6
