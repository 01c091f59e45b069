import hashlib
import random

import public_tokenizers as P
import pytest

from graphloom.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "a", "don't  stop\n\n  now 123", "x" * 400, "word " * 300, "  \n " * 120, "é日本語🙂 " * 60, "'re'll" * 90, "a1!" * 150, " " * 500 + "end"]


def test_encode_equals_the_library_whatever_the_chunks(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["a", "bc", " ", "  ", "\n", "'", "s", "re", "7", "!", "ü", "\x1c", "\u2003"]) for _ in range(rng.randint(50, 400))) for _ in range(60)]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(3, texts[3], "extra"), (None, "word " * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encoding(PATH, P.PATTERN)
    want = sorted((repr(i), enc.encode_ordinary(t or "")) for i, t, _ in rows)
    for chunk, overlap in ((60, 20), (101, 7), (100_000, 100)):
        back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap), PATH).collect()
        assert sorted((repr(r.doc_id), r.ids) for r in back) == want
        assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        digests = bpe.digests(docs, PATH, P.PATTERN, chunk=chunk, overlap=overlap)
        assert sorted((repr(r[0]), *r[1:]) for r in digests.collect()) == sorted((repr(i), len(x := enc.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t, _ in rows)


def test_very_long_texts_at_the_usual_chunk(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choices("abcdeé .", k=7)) for _ in range(40_000))
    rows = [(1, long), (2, long), (3, "y" * 70_000), (4, "short"), (5, long + "."), (6, None)]
    enc = bpe.encoding(PATH, P.PATTERN)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(rows, "doc_id int, text string"), PATH, P.PATTERN).collect()}
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_no_rows_and_unknown_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, PATH, P.PATTERN).collect() == bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, [99_999_999]), (2, None)], "doc_id long, ids array<int>"), PATH).select("bytes").distinct().collect() == [(None,)]


@pytest.mark.parametrize("text", TEXTS[1:])
def test_stitches_are_true_boundaries(text):
    true = set(bpe.boundaries(text, P.PATTERN, True))
    parts = bpe.chunks(text, 40, 15)
    tails = [bpe.edges(b, not s, z, P.PATTERN, 40, 15) for s, b, z in parts]
    at = {0}
    for k in range(1, len(parts)):
        shared = {40 * (k - 1) + x for x in tails[k - 1][1]} & {40 * k + x for x in tails[k][0]}
        if not shared:
            break
        at.add(min(shared))
    assert at <= true | {0} and bpe.chunks('', 4, 2) == [(0, '', True)]
