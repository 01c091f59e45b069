import random

import numpy as np
import pytest

from graphloom.llm import subword, toxicity

BAD = ["nastyfoo", "vilebart", "grimwort"]


def doc(rng, toxic, n):
    words = ["".join(rng.choices("th er on an re in ed".split(), k=rng.randint(1, 4))) for _ in range(n)]
    for _ in range(rng.randint(1, 3) if toxic else 0):
        words[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(10)
    return [(i, doc(rng, i % 4 == 0, rng.choice([8, 40, 200])), int(i % 4 == 0)) for i in range(800)]


def test_words_and_bags_alone_or_together():
    texts = ["One, two three!", None, "", "a", "über-lang st*pid x", " . "]
    ids, owner, first, muted = toxicity.word_bags(subword.Points(texts, subword.inside_words()))
    assert len(first) == 7 and not muted.any() and owner.min() == 0 and owner.max() == 6
    alone = [toxicity.word_bags(subword.Points([t], subword.inside_words())) for t in texts]
    assert np.array_equal(np.bincount(owner, minlength=7), np.concatenate([np.bincount(o, minlength=len(f)) for _, o, f, _ in alone]))
    assert sorted(ids.tolist()) == sorted(i for x, *_ in alone for i in x.tolist())
    # The same word has the same bucket anywhere.
    p = subword.Points(["pad pad word", "word"], subword.inside_words())
    whole = toxicity.words_of(p)[2].tolist()
    assert toxicity.word_bags(p)[3].tolist() == [False, True, False, False]
    assert whole[2] == whole[3] and whole[0] == whole[1] != whole[2]


def test_windows_cover_all_words():
    for n in range(0, 40):
        spans = toxicity.windows(n)
        assert {w for a, b in spans for w in range(a, b)} == set(range(n)) and len(spans) <= max(1, n // 4)


def test_odds_are_those_of_the_top_window():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 1.0, 0.0)
    r = random.Random(4)
    texts = [doc(r, False, n) for n in (1, 4, 5, 8, 9, 12, 13, 50)] + ["ba " * 40, None, ""]
    for t, odds in zip(texts, model.odds(texts), strict=True):
        ids, owner, first, muted = toxicity.word_bags(subword.Points([t], subword.inside_words()))
        heard = np.where(muted[owner], 0, model.table[ids])
        want = [heard[(owner >= a) & (owner < b)].mean() for a, b in toxicity.windows(len(first))]
        assert odds == pytest.approx(max(want), abs=1e-5) if want else odds == -np.inf


def test_learns_words_and_their_misspellings(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.where("doc_id % 5 != 0").select("doc_id", "toxic"), sample=400)
    rng = random.Random(11)
    long_toxic = doc(rng, False, 3000) + " you nastyfoo " + doc(rng, False, 3000)
    odd = [(9000, None), (9001, ""), (9002, "?!"), (9003, long_toxic), (9004, doc(rng, False, 6000)), (9005, doc(rng, False, 30) + " vilebarrt " + doc(rng, False, 9)), (None, "nastyfoo")]
    all_rows = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(i, t, "s") for i, t in odd], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.score(all_rows, model).collect()}
    held = [got[i].predicted == y for i, _, y in rows if i % 5 == 0]
    assert np.mean(held) > 0.97
    assert [got[i].predicted for i in (9000, 9001, 9002, 9003, 9004, 9005)] == [0, 0, 0, 1, 0, 1]
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows[:4], "doc_id long, text string, toxic int")
    for part in (docs.limit(0), docs.where("toxic = 0")):
        assert {r.predicted for r in toxicity.score(docs, toxicity.train(part, part)).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs, docs)).collect() == []
