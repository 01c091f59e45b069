import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm import mixing

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2


def plain_targets(sizes):
    """Resharing round by round, as the rule says."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = SHARE * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= CAP * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(CAP * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def plain_mix(rows):
    """Copies of each id: systematic sampling in the order of (size, id) within each source."""
    sources = defaultdict(list)
    for i, text, source in rows:
        sources[source].append((len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), i))
    sizes = {s: sum(n for n, _ in v) for s, v in sources.items()}
    target, out = plain_targets(sizes), Counter()
    for s, v in sources.items():
        u = int(hashlib.md5((mixing.SEED + "|" + ("n" if s is None else "s" + s)).encode()).hexdigest()[:8], 16) / 2**32
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        for k, (_, i) in enumerate(sorted(v, key=lambda x: (x[0], x[1] is not None, x[1] or 0)), 1):
            out[i] += math.floor(rate * k + u) - math.floor(rate * (k - 1) + u)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(15)
    out = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(["hot"] * 6 + ["b", "c", "Z", "", None])) for i in range(600)]
    return out + [(601, None, "hot"), (602, "", None), (603, None, "empty"), (None, "no id here", "b")]


def test_copies_and_targets(spark, rows):
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    want = plain_mix(rows)
    assert {r.doc_id: r.copies for r in got} == {i: want[i] for i, *_ in rows}
    sizes = {r.source: r.source_size for r in got}
    target = plain_targets(sizes)
    assert all(r.target == pytest.approx(target[r.source]) for r in got)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 2 * max(r["size"] for r in mine) and all(0 <= r.taken <= 2 * r["size"] for r in mine)
    assert sorted(map(repr, mixing.plan_mix(docs.repartition(7)).collect())) == sorted(map(repr, got))


def test_rows_come_out_as_often_as_planned(spark, rows):
    more = rows + [(5, rows[5][1], rows[5][2])] * 3
    docs = spark.createDataFrame([(*r, {"k": 1}) for r in more], "doc_id long, text string, source string, `__id` map<string,int>")
    plan = Counter()
    for r in mixing.plan_mix(docs).collect():
        plan[r.doc_id] += r.copies
    out = mixing.mix(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = out.collect()
    assert Counter(r.doc_id for r in got) == +plan and {(r.doc_id, r.text, r.source) for r in got} <= set(rows)


def test_rows_that_differ_elsewhere_are_told_apart(spark):
    rows = [(i % 5, f"w {i % 5}", "s", k, None if k % 3 else {"a": k}) for i in range(10) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `of.it` int, more map<string,int>")
    outs = [sorted(map(repr, mixing.mix(d).collect())) for d in (docs, docs.repartition(5), docs.orderBy(docs["`of.it`"].desc()))]
    assert outs[0] == outs[1] == outs[2]
    # One source takes 1.5 times its words: each of the 40 different rows stands twice, and is taken twice to four times.
    seen = Counter(outs[0])
    assert len(seen) == 40 and set(seen.values()) <= {2, 3, 4} and sum(seen.values()) == 120


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(i, "ab " * (200_000 if i == 3 else 5), "s") for i in range(6)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.plan_mix(docs).collect()}
    assert got[3]["size"] == 200_000 and {r.source_size for r in got.values()} == {200_025}
    assert sum(r.taken for r in got.values()) == sum(len(r.text.split()) for r in mixing.mix(docs).collect())


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan_mix(docs).collect() == [] and mixing.mix(docs).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.plan_mix(blank).collect()} == {(0.0, 0)}
