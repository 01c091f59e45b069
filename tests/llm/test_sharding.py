import zlib
from collections import Counter, defaultdict

import pytest

from graphloom.llm import sharding


def brute(rows, shards):
    import hashlib

    sized = sorted((hashlib.md5((t or "").encode()).hexdigest()[:30], -(2**63) if i is None else i, len((t or "").encode()) + 8) for i, t in rows)
    total, at, out = sum(s for *_, s in sized), 0, []
    for _, i, s in sized:
        out.append((i, s, min(shards - 1, int((at + s / 2) * shards // total))))
        at += s
    return Counter(out)


@pytest.mark.parametrize("ranges", [4, 64])
def test_shards_slots_and_hot_texts(spark, ranges):
    hot = "the same text again"
    rows = [(i, f"text {i} " * (i % 40)) for i in range(400)] + [(1000 + i, hot) for i in range(300)] + [(7, "repeated")] * 200 + [(None, None), (2000, ""), (2001, "ß" * 3000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, size string, shard int")
    got = sharding.shard(docs, 24, ranges=ranges).collect()
    assert Counter((-(2**63) if r.doc_id is None else r.doc_id, r["size"], r.shard) for r in got) == brute(rows, 24)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 6008
    assert {r.text_crc32 for r in got if r.doc_id == 2000} == {0} and {r.text_crc32 for r in got if r.doc_id == 7} >= {zlib.crc32(b"repeated")}


def test_empty_and_few(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = sharding.shard(spark.createDataFrame([(1, "a"), (2, "bb")], "doc_id long, text string")).collect()
    assert sorted(r.slot for r in got) == [0, 0] and all(0 <= r.shard < 24 for r in got)
