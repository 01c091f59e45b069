import random

import numpy as np
import pytest

from graphloom.llm import langid, subword

SYLLABLES = {"xa": "ba da ga la ma".split(), "xo": "bo do go lo mo".split(), "xü": "ßü tü kü rü nü".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 60)), lang) for i in range(500)]


def test_grams_of_each_text_alone():
    texts = ["Ab, cd", None, "", "...", "x", "ab", "…ü ß"]
    together = list(subword.bags(subword.Points(texts, subword.letters()), (1, 2, 3), 1 << 12))
    for t, (ids, counts) in zip(texts, together, strict=True):
        alone = next(subword.bags(subword.Points([t], subword.letters()), (1, 2, 3), 1 << 12))
        assert ids.tolist() == alone[0].tolist() and counts.tolist() == alone[1].tolist()
        letters = [c for c in (t or "") if c.isalpha()]
        words = "".join(c if c.isalpha() else " " for c in t or "").split()
        assert counts.sum() == len(letters) + sum(len(w) + 1 for w in words) + sum(len(w) for w in words)
    table = np.random.default_rng(1).normal(size=(1 << 12, 3))
    want = [np.average(table[i], axis=0, weights=c) if len(i) else np.zeros(3) for i, c in together]
    assert np.allclose(subword.means(subword.Points(texts, subword.letters()), (1, 2, 3), table), want)


def test_learns_and_rejects(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where(langid.remainder(docs.doc_id, 4) != 2))
    assert model.langs == ("xa", "xo", "xü")
    odd = [(900, None, "xa"), (901, "", "xa"), (902, "12 34!", "xa"), (903, "qwrt zxcv plkj " * 9, "xa"), (None, rows[0][1], None), (0, rows[0][1], "xo")]
    more = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = langid.identify(more, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: lang for i, _, lang in rows}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 900]
    assert np.mean(right) > 0.99
    assert {(r.doc_id, r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (900, 901, 902)} == {(i, "und", 0.0, True) for i in (900, 901, 902)}
    kept = langid.accepted(more, model)
    assert kept.schema == more.schema
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if not r.rejected)
    assert np.mean([r.rejected for r in got if r.doc_id is not None and r.doc_id < 900]) < 0.02
    again = langid.train(docs.repartition(7).where(langid.remainder(docs.doc_id, 4) != 2))
    assert np.array_equal(again.table, model.table) and again.least == model.least


def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows[:3], "doc_id long, text string, lang string")
    model = langid.train(docs.limit(0))
    assert {(r.lang_pred, r.score, r.rejected) for r in langid.identify(docs, model).collect()} == {("und", 0.0, True)}
    assert langid.identify(docs.limit(0), model).collect() == []
