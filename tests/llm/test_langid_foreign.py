import random

import numpy as np
import pytest

from graphloom.llm import langid, queries

FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Quanto a dir qual era è cosa dura, questa selva selvaggia e aspra e forte che nel pensier rinova la paura",
    "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")


def test_foreign_and_random_text_is_rejected(docs):
    model = queries.language_model(docs)
    rng = random.Random(21)
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(200)]
    gibberish = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(50)]
    assert model.predict(FOREIGN)[2].all()
    assert model.predict(noise)[2].mean() > 0.99 and model.predict(gibberish)[2].all()
    rows = docs.where(langid.remainder(docs.doc_id, 4) == 2).collect()
    langs, _, rejected = model.predict([r.text for r in rows])
    print("held out", len(rows), "rejected", int(rejected.sum()), "right", np.mean([a == r.lang for a, r in zip(langs, rows, strict=True)]))
    assert rejected.mean() < 0.005
    # The first words of a clean document are clean.
    short = model.predict([" ".join(r.text.split()[:12]) for r in rows])
    print("first 12 words rejected", short[2].mean())
    assert short[2].mean() < 0.02


def test_two_languages_reject_a_third(docs):
    model = queries.language_model(docs.where("lang IN ('en', 'de')"))
    assert model.langs == ("de", "en") and model.predict(FOREIGN)[2].all()
