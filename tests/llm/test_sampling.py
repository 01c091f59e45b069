import random

import numpy as np
import pytest

from graphloom.llm import langid, sampling, toxicity

from .test_langid import text


def pool(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    return df, df.selectExpr("label", "xxhash64(doc_id, text) AS at", "octet_length(text) AS size")


def test_null_and_repeated_ids_do_not_swell_the_sample(spark):
    rows = [(None if i % 2 else i, f"text {i}", "a") for i in range(20_000)] + [(7, "again", "a")] * 10_000
    df, keys = pool(spark, rows)
    drawn = sampling.draw(keys, 400, 1 << 20)
    assert len(drawn) == 400 == len(set(drawn)) and sampling.draw(keys.repartition(7), 400, 1 << 20) == drawn
    got = sampling.taken(df, drawn, "string", lambda label, text, at: [label, at, text], "label string, at long, text string")
    assert got.num_rows == 400 and len(set(got["text"].to_pylist())) == 400
    # Half of the ids are null, and about half of the sample.
    assert 120 < sum(int(t.split()[1]) % 2 for t in got["text"].to_pylist() if t != "again") < 280


def test_copies_count_once(spark):
    df, keys = pool(spark, [(None, "same", "b")] * 5000 + [(i, f"t {i}", "b") for i in range(30)])
    drawn = sampling.draw(keys, 100, 1 << 20)
    assert len(drawn) == 31
    got = sampling.taken(df.repartition(9), drawn, "string", lambda label, text, at: [label, at, text], "label string, at long, text string")
    assert sorted(got["text"].to_pylist()) == sorted(["same", *(f"t {i}" for i in range(30))])


def test_bytes_are_bounded_but_one_row_is_taken(spark):
    _, keys = pool(spark, [(i, "x" * 1000, "big") for i in range(50)] + [(99, "y" * 90_000, "one")] + [(1, "z", None)])
    drawn = sampling.draw(keys, 40, 10_000)
    assert [x for x, _ in drawn].count("big") == 10 and [x for x, _ in drawn].count("one") == 1 and len(drawn) == 11
    assert sampling.draw(keys.limit(0), 40, 10_000) == []


def test_pieces():
    assert sampling.piece("abc", 5, 3) == "abc" and sampling.piece("abcdef", -2, 3) in "abcdef"
    assert {sampling.piece("abcdef", k, 3) for k in range(9)} == {"abc", "bcd", "cde", "def"}


def test_a_rare_language_and_one_of_long_texts_are_learned(spark):
    rng = random.Random(30)
    rows = [(i, text(rng, "xa" if i % 3 else "xo", rng.randint(4, 12)), "xa" if i % 3 else "xo") for i in range(20_000)]
    rows += [(30_000 + k, text(rng, "xü", 80), "xü") for k in range(3)]
    vowels = {"long": "bi di gi li".split()}
    long = lambda: " ".join("".join(rng.choices(vowels["long"], k=rng.randint(1, 4))) for _ in range(14_000))
    rows += [(31_000 + k, long(), "long") for k in range(4)]
    assert len(rows[-1][1]) > 1 << 16
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert model.langs == ("long", "xa", "xo", "xü")
    new = [text(rng, "xü", 60) for _ in range(20)] + [long()[:400] for _ in range(20)] + [text(rng, "xa", 30) for _ in range(200)]
    langs, _, rejected = model.predict(new)
    assert np.mean([a == b for a, b in zip(langs, ["xü"] * 20 + ["long"] * 20 + ["xa"] * 200, strict=True)]) > 0.98
    assert rejected[:20].mean() <= 0.5 and rejected[40:].mean() < 0.02


def test_toxic_words_of_long_texts_are_learned(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("th er on an re in ed".split(), k=rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(40)), 0) for i in range(300)]
    rows += [(1000 + i, " ".join([*(word() for _ in range(2000)), "nastyfoo", "vilebart", *(word() for _ in range(2000))]), 1) for i in range(40)]
    assert len(rows[-1][1]) > 1 << 14
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    scores = model.scores(["then nastyfoo there", "on there " + "reined " * 9, None])
    assert scores[0] > 0.5 > scores[1]


@pytest.mark.parametrize("share", [0.5])
def test_training_with_null_ids(spark, share):
    rng = random.Random(32)
    rows = [(None if rng.random() < share else i, text(rng, lang := rng.choice(["xa", "xo"]), 20), lang) for i in range(600)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=100)
    langs, _, _ = model.predict([r[1] for r in rows])
    assert np.mean([a == r[2] for a, r in zip(langs, rows, strict=True)]) > 0.99
