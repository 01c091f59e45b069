import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

import corpus_pipeline
from graphloom.llm import bpe, pii, queries
from graphloom.llm.common import cut
from graphloom.plans import store

from .test_mixing import plain_mix
from .test_simhash import groups
from .test_simhash import plain as fingerprint

SYLLABLES = {"xa": "ba da ga la ma".split(), "xo": "bo do go lo mo".split()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(14)
    out = []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(60, 200)))
        if i % 5 == 0:
            text += " card 4041894974608795 tel +1 (988) 555-2485"
        out.append((i, text, lang, rng.choice(["s1", "s1", "s2", "s3", None]), len(text)))
    for k in range(30):
        _, text, lang, source, n = out[k]
        out.append((1000 + k, text + " ba" * (k % 2), lang, source, n))
    return out + [(2000, None, "xa", "s1", 0), (2001, "", None, "s1", 0), (2002, "12 34", "xa", "s2", 5), (7, out[7][1], *out[7][2:])]


def test_stages_by_plain_versions(spark, rows):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "pii", "mixing", "byte_bpe"]
    stages, at, seen = [f for _, f in corpus_pipeline.STAGES], docs, []
    for f in stages:
        at = cut(f(spark, at, ""))
        seen.append(at.collect())
        if f is not stages[-1]:
            assert at.schema.simpleString() == docs.schema.simpleString()
    # Language: what the model rejects, and nothing else.
    model = queries.language_model(docs)
    _, scores, rejected = model.predict([r[1] for r in rows])
    kept = [r for r, s, x in zip(rows, scores, rejected, strict=True) if s > 0 and not x]
    assert sorted(map(repr, map(tuple, seen[0]))) == sorted(map(repr, kept)) and not {2000, 2001, 2002} & {r[0] for r in kept} and len(kept) >= 185
    # Near copies: the smallest id of each group, once.
    group, least = groups([fingerprint(r[1]) for r in kept], 4), {}
    for r, g in zip(kept, group, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    assert sorted(r.doc_id for r in seen[1]) == sorted(least.values())
    first = {r[0]: r for r in kept}
    assert {tuple(r) for r in seen[1]} == {first[i] for i in least.values()}
    # Personal data: the same rows with other values of the same length.
    assert {tuple(r) for r in seen[2]} == {(r[0], pii.replaced(r[1], pii.EXAMPLE), *r[2:]) for r in map(tuple, seen[1])}
    assert not any("4041894974608795" in r.text or "555-2485" in r.text for r in seen[2])
    # Mixing: the copies of the plain version.
    copies = plain_mix([(r.doc_id, r.text, r.source) for r in seen[2]])
    assert Counter(r.doc_id for r in seen[3]) == Counter({i: c for i, c in copies.items() if c})
    # Encoding: ids of the library, and the text again.
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((r.doc_id, len(ids := enc.encode_ordinary(r.text)), sha(" ".join(map(str, ids)).encode()), sha(r.text.encode())) for r in seen[3])
    assert Counter(map(tuple, seen[4])) == want


def test_odd_tables(spark, rows):
    """Null ids, no rows at all, a very long text, columns whose names clash with those of the operators."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, fp string, `__of` map<string,int>, `te.xt` string"
    long = " ".join([rows[3][1]] * 200)
    odd = [(*r, "f", {"k": 1}, "t") for r in rows] + [(None, rows[2][1] + " other words bo", rows[2][2], "s1", 1, None, None, None)] * 2 + [(3000, long, rows[3][2], "s2", len(long), "", {}, "")]
    for part in (odd, []):
        at = spark.createDataFrame(part, columns)
        for name, f in corpus_pipeline.STAGES:
            before = at.count()
            at = cut(f(spark, at, ""))
            n = at.count()
            assert (n == before if name in ("pii", "byte_bpe") else n <= before * (2 if name == "mixing" else 1)) and bool(n) == bool(part)
            if name != "byte_bpe":
                assert at.schema.simpleString() == spark.createDataFrame([], columns).schema.simpleString()
            if part and name == "near_dedup":
                ids = [r.doc_id for r in at.collect()]
                assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_run_reads_documents(spark, rows, tmp_path):
    spark.createDataFrame(rows[:60], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and got[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert corpus_pipeline.ORACLE_SQL is None
    # Of what was stored on the way, only what the result reads is left.
    left = list(store._written)
    corpus_pipeline.run(spark, str(tmp_path))
    assert len(store._written) == len(left) + 1
