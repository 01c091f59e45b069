"""Registered queries of the graph engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import datasets
from .datasets import GRAPHS, SQL
from .functions.hashing import unsigned
from .operators import components, learn, pagerank, partition, privacy, scheduler, simulate, sketch, traversal, triangles, verify
from .plans.graph import Graph
from .plans.match import compile_predicate, match
from .plans.store import folder
from .streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df, column: str, digits: int = 9):
    return df.withColumn(column, F.round(F.col(column).cast("double"), digits))


# --- pieces of SQL


def graph_sql(name: str, dense: bool = True) -> str:
    """e, v and n: edges, vertices, and their number."""
    ids = "SELECT unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e))) AS id" if dense else "SELECT DISTINCT conv_id * 1000 + turn AS id FROM conversations"
    return f"WITH RECURSIVE e AS ({SQL[name]}), v AS ({ids}), n AS (SELECT count(*) AS n FROM v), m AS (SELECT src, dst, count(*) AS m FROM e GROUP BY src, dst)"


def pagerank_steps(k: int, damping: str = "CAST(0.85 AS DOUBLE)") -> str:
    out = ", deg AS (SELECT src, sum(m) AS deg FROM m GROUP BY src), sh AS (SELECT m.src, dst, CAST(m AS DOUBLE) / deg AS share FROM m JOIN deg ON m.src = deg.src)"
    out += ", s0 AS (SELECT id, CAST(1 AS DOUBLE) / n AS score FROM v, n)"
    for i in range(k):
        out += f", s{i + 1} AS (SELECT v.id, (1 - {damping}) / n + {damping} * coalesce(t.x, 0) AS score FROM n, v LEFT JOIN (SELECT dst, sum(score * share) AS x FROM sh JOIN s{i} ON src = id GROUP BY dst) t ON v.id = t.dst)"
    return out


def pagerank_sql(name: str, k: int) -> str:
    return f"{graph_sql(name)}{pagerank_steps(k)} SELECT id, round(score, 9) AS score FROM s{k}"


def bfs_sql(name: str, source: str, most: int, dense: bool = True) -> str:
    return f"""{graph_sql(name, dense)}, b(id, dist) AS (SELECT id, 0 FROM v WHERE id = {source} UNION SELECT m.dst, dist + 1 FROM b JOIN m ON b.id = m.src WHERE dist < {most})
    SELECT v.id, coalesce(min(dist), -1) AS dist FROM v LEFT JOIN b ON v.id = b.id GROUP BY v.id"""


def fnv_sql(x: str) -> str:
    octets = ", ".join(f"(CAST({x} AS UBIGINT) >> {s}) & 255" for s in range(0, 64, 8))
    return f"CAST(list_reduce([CAST(14695981039346656037 AS UHUGEINT), {octets}], lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT)"


def q(name: str):
    return GRAPHS[name]


def flagship(spark, sf_dir):
    return rounded(pagerank.pagerank(datasets.copurchase(spark, sf_dir), 5), "score")


# --- structure


@query("degrees_cs", f"{graph_sql('cs')} SELECT v.id, CAST(coalesce(sum(m), 0) AS BIGINT) AS degree FROM v LEFT JOIN m ON v.id = m.src GROUP BY v.id")
def degrees_cs(spark, d):
    return q("cs")(spark, d).degrees()


_TINY = "(VALUES (0, 1), (0, 2), (1, 3), (2, 1), (2, 4), (3, 4)) t(src, dst)"


@query("adjacency_tiny", f"SELECT CAST(id AS BIGINT) AS id, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst), '') AS neighbors FROM range(5) r(id) LEFT JOIN {_TINY} ON id = src GROUP BY id")
def adjacency_tiny(spark, d):
    return Graph.tiny(spark).adjacency().withColumn("neighbors", F.array_join("neighbors", ","))


@query("topology_sample", f"WITH e AS ({SQL['cp']}) SELECT src AS source, dst AS target FROM e ORDER BY src, dst LIMIT 500")
def topology_sample(spark, d):
    from .sources.edges import topology

    return topology(q("cp")(spark, d))[1]


@query("symmetrized_geo", f"WITH e AS ({SQL['geo']}), s AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT src AS id, count(*) AS degree FROM s GROUP BY src")
def symmetrized_geo(spark, d):
    return q("geo")(spark, d).symmetrized().degrees()


# --- iterative algorithms


@query("pagerank_cp", pagerank_sql("cp", 5))
def pagerank_cp(spark, d):
    return flagship(spark, d)


@query("pagerank_ut_multi", pagerank_sql("ut", 10))
def pagerank_ut(spark, d):
    return rounded(pagerank.pagerank(q("ut")(spark, d), 10), "score")


@query("pagerank_mpi_equiv", pagerank_sql("cs", 6))
def pagerank_spread(spark, d):
    g = q("cs")(spark, d)
    return rounded(pagerank.pagerank(Graph(g.vertices, g.edges.repartition(16, "src")), 6), "score")


@query("encrypted_pagerank_ut", pagerank_sql("ut", 10))
def encrypted_ut(spark, d):
    return rounded(pagerank.encrypted_pagerank(q("ut")(spark, d)), "score")


@query("tmr_pagerank_ut", f"{graph_sql('ut')}{pagerank_steps(6)} SELECT id, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 9) AS score, CAST(id = 0 AS INT) AS fault FROM s6")
def tmr_ut(spark, d):
    return rounded(pagerank.tmr_pagerank(q("ut")(spark, d), 6, simulate_cosmic_ray=True), "score")


@query("bfs_geo", bfs_sql("geo", "0", 4))
def bfs_geo(spark, d):
    return traversal.bfs(q("geo")(spark, d), 0)


@query("bfs_ut", bfs_sql("ut", "3", 14))
def bfs_ut(spark, d):
    return traversal.bfs(q("ut")(spark, d), 3)


@query("bfs_ut_pull", bfs_sql("ut", "3", 14))
def bfs_ut_pull(spark, d):
    return traversal.bfs(q("ut")(spark, d), 3, "pull")


@query("bfs_cv", bfs_sql("cv", "(SELECT min(conv_id * 1000 + turn) FROM conversations)", 1000, dense=False))
def bfs_cv(spark, d):
    g = q("cv")(spark, d)
    return traversal.bfs(g, g.vertices.agg(F.min("id")).first()[0])


@query("bfs_out_of_range", f"{graph_sql('geo')} SELECT id, -1 AS dist FROM v")
def bfs_outside(spark, d):
    return traversal.bfs(q("geo")(spark, d), 10**9)


@query("execute_bfs_ut", bfs_sql("ut", "0", 14))
def scheduled_bfs(spark, d):
    return scheduler.execute_bfs(q("ut")(spark, d), 0)


_CC_CV = f"""{graph_sql('cv', False)}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), r(id, other) AS (SELECT id, id FROM v UNION SELECT r.id, b.dst FROM r JOIN b ON r.other = b.src)
SELECT id, min(other) AS component FROM r GROUP BY id"""
_CC_CS = f"{graph_sql('cs')}, b AS (SELECT src, dst FROM m UNION SELECT dst, src FROM m), l0 AS (SELECT id, id AS label FROM v)" + "".join(
    f", l{i + 1} AS (SELECT l.id, least(any_value(l.label), coalesce(min(o.label), any_value(l.label))) AS label FROM l{i} l LEFT JOIN b ON l.id = b.src LEFT JOIN l{i} o ON b.dst = o.id GROUP BY l.id)" for i in range(10)
)


@query("cc_cv", _CC_CV)
def cc_cv(spark, d):
    return components.connected_components(q("cv")(spark, d))


@query("cc_cs", f"{_CC_CS} SELECT id, label AS component FROM l10")
def cc_cs(spark, d):
    return components.connected_components(q("cs")(spark, d))


def sssp_sql(name: str, source: int, rounds: int) -> str:
    out = f"{graph_sql(name)}, w AS (SELECT src, dst, min(weight) AS w FROM e GROUP BY src, dst), d0 AS (SELECT id, CAST(0 AS DOUBLE) AS dist FROM v WHERE id = {source})"
    for i in range(rounds):
        out += f", d{i + 1} AS (SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM d{i} UNION ALL SELECT w.dst, dist + w FROM d{i} JOIN w ON id = src) GROUP BY id)"
    return f"{out} SELECT v.id, coalesce(CAST(round(dist, 6) AS VARCHAR), 'Infinity') AS dist FROM v LEFT JOIN d{rounds} d ON v.id = d.id"


@query("sssp_ut", sssp_sql("ut", 3, 24).replace("coalesce(CAST(round(dist, 6) AS VARCHAR), 'Infinity')", "coalesce(round(dist, 6), -1)"))
def sssp_ut(spark, d):
    found = traversal.sssp(q("ut")(spark, d), 3)
    # -1 for infinity, which not all readers compare.
    return rounded(found.withColumn("dist", F.when(F.col("dist") == float("inf"), -1.0).otherwise(F.col("dist"))), "dist", 6)


@query("triangles_ut_directed", f"""WITH e AS ({SQL['ut']}), m AS (SELECT src, dst, count(*) AS m FROM e WHERE src < dst GROUP BY src, dst)
SELECT CAST(coalesce(sum(a.m * least(b.m, c.m)), 0) AS BIGINT) AS triangles FROM m a JOIN m b ON a.src = b.src AND a.dst < b.dst JOIN m c ON c.src = a.dst AND c.dst = b.dst""")
def triangles_ut(spark, d):
    return triangles.triangle_count(q("ut")(spark, d))


@query("triangles_cp", f"WITH m AS ({SQL['cp']}) SELECT count(*) AS triangles FROM m a JOIN m b ON a.src = b.src AND a.dst < b.dst JOIN m c ON c.src = a.dst AND c.dst = b.dst")
def triangles_cp(spark, d):
    return triangles.triangle_count(q("cp")(spark, d), canonicalize=True)


#: One step a vertex and sweep: the list of parts with the vertex's own turned if more of its out-edges lead to the other part.
_KL_SWEEP = f"""{graph_sql('ut')}, adj AS (SELECT src, list(dst) AS d, list(m) AS w FROM m GROUP BY src), r(step, part) AS (
SELECT 0, list(CAST(id >= n // 2 AS INT) ORDER BY id) FROM v, n UNION ALL
SELECT step + 1, CASE WHEN coalesce(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN part[d[i] + 1] <> part[src + 1] THEN w[i] ELSE -w[i] END)), 0) > 0
THEN list_transform(range(1, len(part) + 1), lambda i: CASE WHEN i = src + 1 THEN 1 - part[i] ELSE part[i] END) ELSE part END
FROM r, n LEFT JOIN adj ON src = step % n WHERE step < 10 * n)
SELECT CAST(unnest(range(len(part))) AS BIGINT) AS id, CAST(unnest(part) AS INT) AS part FROM r, n WHERE step = 10 * n"""


@query("kl_bisection_ut", _KL_SWEEP)
def kl_ut(spark, d):
    return partition.bisect(q("ut")(spark, d))


def _kl_spread_sql(name: str, iterations: int) -> str:
    out = f"{graph_sql(name)}, b AS (SELECT src, dst, sum(m) AS w FROM (SELECT src, dst, m FROM m UNION ALL SELECT dst, src, m FROM m) GROUP BY src, dst), p0 AS (SELECT id, CAST(id >= n // 2 AS INT) AS part FROM v, n)"
    for k in range(2 * iterations):
        out += f""", p{k + 1} AS (SELECT p.id, CASE WHEN p.id % 2 = {k % 2} AND gain > 0 THEN 1 - part ELSE part END AS part FROM p{k} p LEFT JOIN
        (SELECT src, sum(CASE WHEN x.part <> y.part THEN w ELSE -w END) AS gain FROM b JOIN p{k} x ON src = x.id JOIN p{k} y ON dst = y.id GROUP BY src) ON p.id = src)"""
    return f"{out} SELECT id, CAST(part AS INT) AS part FROM p{2 * iterations}"


@query("kl_bisection_spread_cs", _kl_spread_sql("cs", 2))
def kl_cs(spark, d):
    return partition.bisect(q("cs")(spark, d).symmetrized(), iterations=2, exact=False)


@query("edge_cut_ut", f"{graph_sql('ut')} SELECT CAST(coalesce(sum(m) FILTER ((src >= n // 2) <> (dst >= n // 2)), 0) // 2 AS BIGINT) AS edge_cut FROM m, n")
def edge_cut_ut(spark, d):
    g = q("ut")(spark, d)
    n = g.num_vertices()
    return partition.edge_cut(g, g.vertices.select("id", (F.col("id") >= n // 2).cast("int").alias("part")))


# --- the query surface


def _match(name: str, text: str, where: str):
    @query(name, f"SELECT CAST(c_custkey AS BIGINT) AS id FROM customer WHERE {where}")
    def run(spark, d):
        return match(datasets.customers(spark, d), text)


_match("match_eq", "MATCH (n) WHERE n.segment = BUILDING RETURN n", "c_mktsegment = 'BUILDING' AND c_custkey % 7 <> 0")
_match("match_gt", "MATCH (n) WHERE n.balance > 5000 RETURN n", "c_acctbal > 5000")
_match("match_lt", "MATCH (n) WHERE n.balance < 1e2", "c_acctbal < 100")
_match("match_prefix_number", "MATCH (n) WHERE n.code > 25xyz RETURN n", "c_custkey % 50 > 25")
_match("match_no_number", "MATCH (n) WHERE n.name > 1", "false")


@query("vm_eq_missing", "SELECT CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_custkey % 7 = 0")
def vm_eq_missing(spark, d):
    return datasets.customers(spark, d).vertices.where(compile_predicate("n.segment", "=", "")).select("id")


# --- sketches


@query("hll_degree_cs", f"""{graph_sql('cs')}, h AS (SELECT src, {fnv_sql('dst')} AS h FROM m), r AS (
SELECT src, h >> 54 AS idx, max(CASE WHEN (h & 18014398509481983) = 0 THEN 65 ELSE 54 - length(bin(h & 18014398509481983)) + 1 END) AS rho FROM h GROUP BY src, h >> 54),
z AS (SELECT src, sum(pow(CAST(2 AS DOUBLE), -rho)) + (1024 - count(*)) AS z, 1024 - count(*) AS zeros FROM r GROUP BY src),
f AS (SELECT src, CAST(0.7213 AS DOUBLE) / (1 + CAST(1.079 AS DOUBLE) / 1024) * 1024 * 1024 / z AS raw, zeros FROM z)
SELECT v.id, round(coalesce(CASE WHEN raw <= 2560 AND zeros > 0 THEN 1024 * ln(CAST(1024 AS DOUBLE) / zeros) ELSE raw END, 0), 6) AS degree FROM v LEFT JOIN f ON v.id = f.src""")
def hll_cs(spark, d):
    return rounded(sketch.estimate_degrees(q("cs")(spark, d)), "degree", 6)


@query("hll_builtin_cs")
def hll_builtin_cs(spark, d):
    return sketch.estimate_degrees(q("cs")(spark, d), method="builtin")


def cms_sql(name: str) -> str:
    rows = " UNION ALL ".join(f"SELECT src, dst, m, {i} AS row, {fnv_sql(f'xor((CAST(src AS UBIGINT) << 32) | CAST(dst AS UBIGINT), CAST({s} AS UBIGINT))')} % 4096 AS col FROM m" for i, s in enumerate(sketch.seeds(sketch.EDGE_DEPTH)))
    return f"{graph_sql(name)}, k AS ({rows}), t AS (SELECT row, col, sum(m) AS cnt FROM k GROUP BY row, col) SELECT src, dst, CAST(min(cnt) AS BIGINT) AS estimate FROM k JOIN t USING (row, col) GROUP BY src, dst"


@query("cms_edges_cs", cms_sql("cs"))
def cms_cs(spark, d):
    g = q("cs")(spark, d)
    return sketch.query_edge_frequency(sketch.build_edge_sketch(g), g.edges.select("src", "dst"))


# --- learning and simulation

_X = "x AS (SELECT user_id AS id, avg(value) AS x FROM events GROUP BY user_id)"


def features(spark, d):
    return datasets.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("x"))


@query("gcn_ut", f"{graph_sql('ut')}, {_X}, a AS (SELECT src, sum(m * x) AS a FROM m JOIN x ON dst = id GROUP BY src) SELECT v.id, round(greatest(0, CAST(0.5 AS DOUBLE) * (coalesce(x, 0) + coalesce(a, 0))), 6) AS value FROM v LEFT JOIN x ON v.id = x.id LEFT JOIN a ON v.id = a.src")
def gcn_ut(spark, d):
    return rounded(learn.gcn_forward_pass(q("ut")(spark, d), features(spark, d), 0.5), "value", 6)


def _federated_sql(rounds: int) -> str:
    out = f"""{graph_sql('ut')}, {_X.replace('avg(value)', 'avg(value) / 1000')}, p AS (SELECT id, least(id // greatest(1, n // 4), 3) AS node FROM v, n),
    a AS (SELECT m.src, sum(m * x) AS a FROM m JOIN p p1 ON m.src = p1.id JOIN p p2 ON m.dst = p2.id AND p1.node = p2.node JOIN x ON m.dst = x.id GROUP BY m.src),
    g AS (SELECT node, coalesce(x, 0) AS x, coalesce(x, 0) + coalesce(a, 0) AS s FROM p LEFT JOIN x ON p.id = x.id LEFT JOIN a ON p.id = a.src),
    t AS (SELECT node, count(*) AS n, avg(x) AS x, avg(x * x) AS xx, avg(greatest(s, 0)) AS u, avg(greatest(s, 0) * greatest(s, 0)) AS uu, avg(greatest(s, 0) * x) AS ux, avg(least(s, 0)) AS d, avg(least(s, 0) * least(s, 0)) AS dd, avg(least(s, 0) * x) AS dx FROM g GROUP BY node),
    w0 AS (SELECT node, CAST(0.5 AS DOUBLE) AS w, CAST(1 AS DOUBLE) AS loss FROM t)"""
    k = 0
    for _ in range(rounds):
        for _ in range(5):
            out += f""", w{k + 1} AS (SELECT node, w - CAST(0.01 AS DOUBLE) * 2 * (w * (CASE WHEN w >= 0 THEN u ELSE d END) - x) * x AS w,
            w * w * (CASE WHEN w >= 0 THEN uu ELSE dd END) - 2 * w * (CASE WHEN w >= 0 THEN ux ELSE dx END) + xx AS loss FROM w{k} JOIN t USING (node))"""
            k += 1
        out += f", w{k + 1} AS (SELECT node, sum(n * w) OVER () / sum(n) OVER () AS w, sum(n * loss) OVER () / sum(n) OVER () AS loss FROM w{k} JOIN t USING (node))"
        k += 1
    return f"{out} SELECT DISTINCT round(w, 6) AS weight, round(loss, 6) AS loss FROM w{k}"


@query("federated_ut", _federated_sql(2))
def federated_ut(spark, d):
    r = learn.federated_train(q("ut")(spark, d), 4, 2, features(spark, d).withColumn("x", F.col("x") / 1000))
    return spark.createDataFrame([(round(r["weight"], 6), round(r["loss"], 6))], "weight double, loss double")


def _lif_sql(name: str, steps: int) -> str:
    out = f"{graph_sql(name)}, t0 AS (SELECT id, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS i, 0 AS spikes FROM v)"
    for k in range(steps):
        out += f""", f{k} AS (SELECT id, m * CAST(0.9 AS DOUBLE) + CAST(0.5 AS DOUBLE) + i AS m, spikes FROM t{k}), t{k + 1} AS (SELECT f.id, CASE WHEN f.m >= 1 THEN 0 ELSE f.m END AS m, coalesce(c, 0) * CAST(0.2 AS DOUBLE) AS i, spikes + CAST(f.m >= 1 AS INT) AS spikes
        FROM f{k} f LEFT JOIN (SELECT dst, sum(m.m) AS c FROM m JOIN f{k} g ON m.src = g.id WHERE g.m >= 1 GROUP BY dst) s ON f.id = s.dst)"""
    return f"{out} SELECT id, spikes FROM t{steps}"


@query("lif_ut", _lif_sql("ut", 10))
def lif_ut(spark, d):
    return simulate.simulate_lif_network(q("ut")(spark, d), 10)


@query("grover_ut", f"{graph_sql('ut')} SELECT id, round(CASE WHEN id = 5 THEN sin(7 * asin(1 / sqrt(n))) ** 2 ELSE cos(7 * asin(1 / sqrt(n))) ** 2 / (n - 1) END, 9) AS probability FROM v, n")
def grover_ut(spark, d):
    return rounded(simulate.quantum_grover_search(q("ut")(spark, d), 5, 3), "probability")


# --- privacy, verification, scheduling


@query("dp_sensitivity", f"{graph_sql('ut')} SELECT round(2 * CAST(0.85 AS DOUBLE) / (n * (1 - CAST(0.85 AS DOUBLE))), 9) AS sensitivity FROM n")
def dp_sensitivity(spark, d):
    return spark.createDataFrame([(round(privacy.pagerank_sensitivity(q("ut")(spark, d)), 9),)], "sensitivity double")


@query("dp_pagerank_rows", f"""{graph_sql('ut')}{pagerank_steps(5)}, u AS (SELECT id, score, (CAST('0x' || substr(md5('7|0|' || id), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / pow(CAST(2 AS DOUBLE), 52) - CAST(0.5 AS DOUBLE) AS u FROM s5)
SELECT id, round(greatest(score - 2 * CAST(0.85 AS DOUBLE) / (n * (1 - CAST(0.85 AS DOUBLE))) * sign(u) * ln(1 - 2 * abs(u)), 0), 9) AS score FROM u, n""")
def dp_rows(spark, d):
    return rounded(privacy.dp_pagerank(q("ut")(spark, d), 1.0, 5, seed=7), "score")


def folded_sql(start: str, words: str) -> str:
    return f"list_reduce([CAST({start} AS UHUGEINT)] || {words}, lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))"


def float_bits_sql(x: str) -> str:
    """The bits of a positive float: exponent and fraction."""
    e = f"floor(log2(CAST({x} AS DOUBLE)))"
    return f"CAST((CAST({e} AS BIGINT) + 127) * 8388608 + CAST((CAST({x} AS DOUBLE) / pow(CAST(2 AS DOUBLE), {e}) - 1) * 8388608 AS BIGINT) AS UHUGEINT)"


def _zkp_sql() -> str:
    out = f"WITH e AS (SELECT * FROM {_TINY}), deg AS (SELECT src, count(*) AS deg FROM e GROUP BY src), v AS (SELECT unnest(range(5)) AS id), s0 AS (SELECT id, CAST(0.2 AS FLOAT) AS score FROM v), "
    base = "(CAST(1 AS FLOAT) - CAST(0.85 AS FLOAT)) / CAST(5 AS FLOAT)"
    # No path has more than four edges, so six iterations give what any more do.
    for k in range(6):
        push = "CAST(0.85 AS FLOAT) * CAST(score / CAST(deg AS FLOAT) AS FLOAT)"
        out += f"s{k + 1} AS (SELECT v.id, list_reduce([CAST({base} AS FLOAT)] || coalesce(p, []), lambda a, b: CAST(a + b AS FLOAT)) AS score FROM v LEFT JOIN (SELECT dst, list(CAST({push} AS FLOAT) ORDER BY e.src) AS p FROM e JOIN deg USING (src) JOIN s{k} ON e.src = id GROUP BY dst) t ON v.id = dst), "
    start, blinding = "14695981039346656037", f"CAST({verify.RANDOMNESS} AS UHUGEINT)"
    out += f"w AS (SELECT list({float_bits_sql('score')} ORDER BY id) AS bits FROM s6), g AS (SELECT [CAST(0 AS UHUGEINT), 2, 3, 5, 6, 6] || (SELECT list(CAST(dst AS UHUGEINT) ORDER BY src, dst) FROM e) AS words), "
    out += f"c AS (SELECT bits, {folded_sql(start, f'(bits || [{blinding}])')} AS c, {folded_sql(start, 'words')} AS f FROM w, g), "
    out += f"p AS (SELECT c, {folded_sql(start, f'(bits || [{float_bits_sql('CAST(CAST(xor(f, c) % 1000000 AS FLOAT) / CAST(1000000 AS FLOAT) AS FLOAT)')}, xor({blinding}, xor(f, c))])')} AS p FROM c) "
    return out + "SELECT lower(to_hex(CAST(c AS UBIGINT))) AS commitment, lower(to_hex(CAST(p AS UBIGINT))) AS proof, true AS verified, true AS opened FROM p"


@query("zkp_roundtrip", _zkp_sql())
def zkp_roundtrip(spark, d):
    g = Graph.tiny(spark)
    scores = pagerank.pagerank_single(g)
    c = verify.zkp_commit(scores)
    p = verify.zkp_prove(g, c, scores)
    return spark.createDataFrame([(f"{c.commitment_hash:x}", f"{p.proof_hash:x}", verify.zkp_verify(g, c, p), verify.zkp_open(g, c, p, scores))], "commitment string, proof string, verified boolean, opened boolean")


_WORDS = "[CAST(14695981039346656037 AS UHUGEINT), 0] || list_transform(ends, lambda x: CAST(x AS UHUGEINT)) || list_transform(dsts, lambda x: CAST(x AS UHUGEINT))"


@query("graph_fingerprint_geo", f"""{graph_sql('geo')}, o AS (SELECT v.id, sum(coalesce(c, 0)) OVER (ORDER BY v.id) AS e FROM v LEFT JOIN (SELECT src, count(*) AS c FROM e GROUP BY src) t ON v.id = t.src),
l AS (SELECT (SELECT list(e ORDER BY id) FROM o) AS ends, (SELECT list(dst ORDER BY src, dst) FROM e) AS dsts)
SELECT CAST(CAST(list_reduce({_WORDS}, lambda h, b: (xor(h, b) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT)) AS UBIGINT) AS VARCHAR) AS fingerprint FROM l""")
def fingerprint_geo(spark, d):
    return spark.createDataFrame([(str(unsigned(verify.graph_fingerprint(q("geo")(spark, d)))),)], "fingerprint string")


def _scheduler_sql() -> str:
    sizes = " UNION ALL ".join(f"SELECT '{k}' AS graph, {'(SELECT count(DISTINCT conv_id * 1000 + turn) FROM conversations)' if k == 'cv' else 'max(greatest(src, dst)) + 1'} AS v, count(*) AS e FROM ({s})" for k, s in SQL.items())
    return f"""WITH s AS ({sizes}), c AS (SELECT graph, 0.1 + CASE WHEN e < 1000000 THEN 0.8 ELSE 0 END AS cpu, 0.5 + CASE WHEN e < 1000000 THEN 0.3 ELSE 0 END + CASE WHEN e > 10 * v THEN 0.4 ELSE 0 END AS omp,
    0.8 - CASE WHEN e < 1000000 THEN 0.6 ELSE 0 END - CASE WHEN e > 10 * v THEN 0.4 ELSE 0 END - CASE WHEN (v + 1) * 4 + e * 4 > 7730941132.8 THEN 10 ELSE 0 END AS cuda FROM s)
    SELECT graph, CASE WHEN cpu > omp AND cpu > cuda THEN 'CPU (Sequential)' WHEN omp > cuda THEN 'CPU (OpenMP)' ELSE 'GPU (CUDA)' END AS mode, round(CAST(cpu AS DOUBLE), 6) AS cpu, round(CAST(omp AS DOUBLE), 6) AS omp, round(CAST(cuda AS DOUBLE), 6) AS cuda FROM c"""


@query("scheduler_all", _scheduler_sql())
def scheduler_all(spark, d):
    out = None
    for k, make in GRAPHS.items():
        row = scheduler.scheduler_decision(make(spark, d)).select(F.lit(k).alias("graph"), "mode", *(F.round(c, 6).alias(c) for c in ("cpu", "omp", "cuda")))
        out = row if out is None else out.unionByName(row)
    return out


# --- streams


@query("stream_freeze_cs", f"{graph_sql('cs')} SELECT v.id, CAST(coalesce(sum(m), 0) AS BIGINT) AS degree FROM v LEFT JOIN m ON v.id = m.src GROUP BY v.id")
def stream_freeze(spark, d):
    g = q("cs")(spark, d)
    base = folder(spark, "streams")
    # Some edges lead outside and are dropped on the way.
    outside = g.edges.limit(5).withColumn("dst", F.lit(10**12))
    g.edges.unionByName(outside).select("src", "dst", "weight").write.parquet(f"{base}/in")
    n = g.num_vertices()
    ingest.ingest(ingest.edge_stream(spark, f"{base}/in"), n, f"{base}/out", f"{base}/state").awaitTermination()
    return ingest.freeze(spark, f"{base}/out", n).degrees()


@query("stream_cms", cms_sql("cs"))
def stream_cms(spark, d):
    g = q("cs")(spark, d)
    base = folder(spark, "streams")
    g.edges.select("src", "dst", "weight").write.parquet(f"{base}/in")
    ingest.keep_sketch(ingest.edge_stream(spark, f"{base}/in"), f"{base}/sketch", f"{base}/state").awaitTermination()
    return sketch.query_edge_frequency(spark.read.parquet(f"{base}/sketch"), g.edges.select("src", "dst"))
