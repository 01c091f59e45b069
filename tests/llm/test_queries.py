"""Each registered query over a small table of odd rows: null and repeated ids, null, empty and very long texts, ties, clashing columns."""

import hashlib
import random
import zlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, pii, quality, queries

from .test_langid import SYLLABLES, text
from .test_mixing import plain_mix, plain_targets
from .test_simhash import groups
from .test_simhash import plain as fingerprint

EXTRA = ["score", "fp", "shard", "__id", "label", "at", "size"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(40)
    out = []
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        t = text(rng, lang, rng.choice([3, 60, 90]))
        if i % 6 == 0:
            t += " nastyfoo vilebart you nastyfoo."
        if i % 7 == 0:
            t += " card 4041894974608795 on 1999-12-31"
        out.append((i, t, lang, rng.choice(["s1", "s1", "s2", None]), len(t)))
    long = text(rng, "xa", 60_000)
    out += [(500, long, "xa", "s1", len(long)), (501, long, "xa", "s1", 0), (502, "y" * 70_000, None, "s2", 1), (503, None, "xo", "s1", None), (504, "", "xo", None, 0), (505, " \n\t", None, "s3", 3), (506, "12 34 !!", "xa", "s1", 8)]
    return out + [(None, out[1][1], "xa", "s1", 2), (5, out[5][1], *out[5][2:]), (5, out[5][1], "xo", "s2", 9)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    for name, part in (("full", rows), ("none", [])):
        docs = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in part], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
        docs.repartition(3).write.parquet(f"{base}/{name}/documents.parquet")
        labels = [(r[0], 1, int("nastyfoo" in (r[1] or "")), "x") for r in part if r[0] != 4] + ([(None, 1, 1, "x"), (3, 0, None, "x"), (9999, 1, 1, "x"), (6, 1, 1, "x")] if part else [])
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{base}/{name}/labels.parquet")
    return str(base)


def run(spark, folder, name):
    found = queries.QUERIES[name](spark, f"{folder}/full").collect()
    assert queries.QUERIES[name](spark, f"{folder}/none").collect() == []
    return found


def data(t):
    return (t or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def key(*values):
    return tuple(map(repr, values))


def test_op1(spark, folder, rows):
    got = run(spark, folder, "op1_toxicity")
    assert sorted(key(r.doc_id, r.held_out) for r in got) == sorted(key(r[0], zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {r[0]: int("nastyfoo" in (r[1] or "")) for r in rows}
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.95 and all(r.predicted == 0 for r in got if r.doc_id in (503, 504, 505))


def test_op2(spark, folder, rows):
    got = run(spark, folder, "op2_sharding")
    assert sorted(key(r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in got) == sorted(key(r[0], len(data(r[1])) + 8, zlib.crc32(data(r[1])), "bytes", None) for r in rows)
    for s in {r.shard for r in got}:
        assert 0 <= s < 24 and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_op3(spark, folder, rows):
    got = run(spark, folder, "op3_simhash")
    fps = [fingerprint(r[1]) for r in rows]
    group, least = groups(fps, 4), {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min([x for x in (least.get(g), r[0]) if x is not None], default=None)
    assert sorted(key(r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(key(r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group, strict=True))


def test_op4(spark, folder, rows):
    got = run(spark, folder, "op4_quality")
    want = []
    for r in rows:
        b = quality.basics(r[1])
        want.append(key(r[0], *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert sorted(key(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert not any(r.kept and r.base_failed for r in got) and sum(r.kept for r in got) > 50


def test_op5(spark, folder, rows):
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = [key(r[0], len(ids := enc.encode_ordinary(r[1] or "")), sha(" ".join(map(str, ids)).encode()), sha(data(r[1]))) for r in rows]
    assert sorted(key(*r) for r in run(spark, folder, "op5_byte_bpe")) == sorted(want)


def test_op6(spark, folder, rows):
    got = run(spark, folder, "op6_pii")
    assert sorted(key(r.doc_id, r.text, r.n_found) for r in got) == sorted(key(r[0], pii.replaced(r[1], pii.EXAMPLE), len(list(pii.find(r[1], pii.EXAMPLE)))) for r in rows)
    assert not any("4041894974608795" in (r.text or "") for r in got)


def test_op7(spark, folder, rows):
    full = [(r[0], d, d.ljust(max(1, -(-len(d) // 64)) * 64, b"\0")) for r in rows for d in [data(r[1])]]
    got = run(spark, folder, "op7_gif")
    assert sorted(key(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(key(i, len(d), len(x), sha(x), zlib.crc32(x[-64:])) for i, d, x in full)
    same = {}
    for r in got:
        same.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in same.values())


def test_op8(spark, folder, rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got = sorted(run(spark, folder, "op8_token_file"), key=lambda r: r.start)
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert sorted(key(r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(key(*w) for w in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)


def test_op9(spark, folder, rows):
    got = run(spark, folder, "op9_language_id")
    assert sorted(key(r.doc_id, r.held_out) for r in got) == sorted(key(r[0], zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 4 == 2) for r in rows)
    truth = {r[0]: r[2] for r in rows[:150]}
    assert sum(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id in truth) / 152 > 0.97
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (503, 504, 505, 506)} == {("und", 0.0)}


def test_op10(spark, folder, rows):
    got = run(spark, folder, "op10_mixing")
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    target = plain_targets(sizes)
    assert sorted(key(r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in got) == sorted(key(r[0], len((r[1] or "").split()), sizes[r[3]], round(target[r[3]], 6)) for r in rows)
    once = [r for r in rows if r[0] not in (5, None)]
    copies = plain_mix([(r[0], r[1], r[3]) for r in rows])
    taken = {r.doc_id: r.taken for r in got}
    assert all(taken[r[0]] == copies[r[0]] * len((r[1] or "").split()) for r in once)
