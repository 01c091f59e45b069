import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.operators import components
from graphloom.plans import store


def plain(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a B c", "Ä B c d", "x y z w v u " * 9, "a\x1cb\x0bc d\xa0e f g"])
def test_fingerprint(text):
    assert simhash.majority(simhash.shingle_hashes(text)) == plain(text)


def groups(fps, bits):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def near(rng, n):
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 5])):
            out.append(x)
            for b in rng.sample(range(64), rng.choice([0, 1, 4, 5, 6])):
                x ^= 1 << b
    return out


@pytest.mark.parametrize("tile,blocks", [(1024, 7), (3, 6)])
def test_links_connect_all_close_pairs(spark, tile, blocks):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = list(dict.fromkeys(near(rng, 150) + [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(20, 32)] + [0, 2**64 - 1]))
    nodes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long").repartition(4)
    found = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(nodes, 4, blocks, tile).collect()}
    assert all(bin(a ^ b).count("1") <= 4 for a, b in found)
    got = {r.node & (2**64 - 1): r.group for r in components.connected(simhash.links(nodes, 4, blocks, tile)).collect()}
    want = groups(fps, 4)
    same = {}
    for f, g in zip(fps, want, strict=True):
        same.setdefault(g, []).append(f)
    for members in same.values():
        assert len({got.get(m, m) for m in members}) == 1
    assert len({got.get(f, f"alone {f}") for f in fps}) == len(same)


def test_rows_of_all_masks_are_not_broadcast(spark):
    nodes = store.stored(spark.createDataFrame([(i * 7919,) for i in range(-50, 50)], "fp long"))
    # The table itself is far below what Spark broadcasts by itself; its rows under all masks are 35 times as many.
    plan = simhash.links(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_whole_query_merges_masks(spark, tmp_path):
    """What op3 writes on its way, at Spark's own threshold for broadcasts: the join of masks is merged as it runs, not only as planned."""
    docs = spark.createDataFrame([(i, f"some words of number {i // 2} and more of {i // 2}") for i in range(40)], "doc_id long, text string")
    nodes = store.stored(simhash.fingerprints(docs).select("fp").distinct())
    ran = simhash.links(nodes)
    ran.write.parquet(str(tmp_path / "links"))
    assert ran.count() == spark.read.parquet(str(tmp_path / "links")).count()
    ran.collect()
    assert "BroadcastHashJoin" not in ran._jdf.queryExecution().executedPlan().toString()
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) <= 20


def test_long_chain_is_one_component(spark):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 300)
    links = spark.createDataFrame(list(zip(names, names[1:])) + [(5_000_000, 5_000_001), (7, 7)], "a long, b long")
    got = {r.node: r.group for r in components.connected(links).collect()}
    assert {got[n] for n in names} == {min(names)} and got[5_000_001] == 5_000_000
    assert components.connected(links.limit(0)).collect() == []


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(60):
        text = [word() for _ in range(300)]
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            text[rng.randrange(300)] = word()
            rows.append((1000 - i, " ".join(text).title()))
    return rows + [(2000 + i, rows[5][1]) for i in range(40)] + [(3000, None), (3001, ""), (3002, "\n"), (5, rows[5][1]), (None, rows[7][1]), (None, "alone without an id"), (None, "alone without an id"), (4, "other text of the same id here")]


def test_components_and_deduplication(spark):
    rows = corpus(random.Random(6))
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    fps = [plain(t) for _, t in rows]
    want = groups(fps, 4)
    least = {}
    for (i, _), g in zip(rows, want, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == sorted((repr(i), f"{f:016x}", repr(least[g])) for (i, _), f, g in zip(rows, fps, want, strict=True))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == len(set(want)) and sorted(repr(r.doc_id) for r in kept) == sorted(repr(x) for x in least.values())
    assert {rows[r.component_id] for r in kept} <= set(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.deduplicated(docs.limit(0)).collect() == []


def test_ties_and_very_long_texts(spark, monkeypatch):
    rng = random.Random(16)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60_000))
    rows = [(1, long, "x", None), (1, long, None, "x"), (2, long + " end", "y", "y"), (3, "other words than those", "z", "z"), (3, "other words than those", "z", "z"), (3, "other words than those", "z", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `of.it` string")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {1, 3}
    first = sorted(map(repr, simhash.deduplicated(docs).collect()))
    assert len(first) == 2 and sorted(map(repr, simhash.deduplicated(docs.repartition(5)).collect())) == first
    # Beyond the bound of what is broadcast the same rows stay.
    monkeypatch.setattr("graphloom.llm.common.FEW", 0)
    assert sorted(map(repr, simhash.deduplicated(docs).collect())) == first
    wide = docs.withColumn("more", F.create_map(F.lit("k"), F.lit(1)))
    assert simhash.deduplicated(wide).schema == wide.schema and simhash.deduplicated(wide).count() == 2


def test_spanning_in_blocks():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 900, dtype=np.uint64)))
    assert len(list(simhash.spanning(fps, None, 4))) == len(fps) - 1
    assert len(list(simhash.spanning(fps[:9], fps[9:], 4))) == len(fps) - 1
