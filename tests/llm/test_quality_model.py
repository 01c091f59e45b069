import math
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import quality

from .test_quality import slow


def plain_model(texts, spelling):
    """log_ppl of each text by the formulas, n-gram by n-gram."""
    rows = []
    for t in texts:
        points, _ = quality.pieces([(t or "").lower()])
        rows.append([0] * 5 + [int(x) for p in points for x in spelling.table[p] if x >= 0])
    grams = [[tuple(r[i - 5 : i + 1]) for i in range(5, len(r))] for r in rows]
    tables = {6: Counter(g for x in grams for g in x)}
    for k in (5, 4):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    classes = [int(c) for c in spelling.classes]
    low = slow(Counter(tuple(classes[s] for s in g[2:]) for x in grams for g in x), 4, 32)
    single = Counter(g[-1] for x in grams for g in x)
    contexts = {k: {} for k in tables}
    for k, t in tables.items():
        for g, c in t.items():
            contexts[k].setdefault(g[:-1], []).append(c)
    d = {k: quality.discounts(np.array(list(t.values()))) for k, t in tables.items()}
    of_class = {c: sum(single[s] + 1 for s in range(1024) if classes[s] == c) for c in set(classes)}

    def p(g):
        k, mine = len(g), contexts[len(g)][g[:-1]]
        lower = p(g[1:]) if k > 4 else low(tuple(classes[s] for s in g[:-1]), classes[g[-1]]) * (single[g[-1]] + 1) / of_class[classes[g[-1]]]
        c = tables[k][g]
        return (c - d[k][min(c, 3)]) / sum(mine) + sum(d[k][min(x, 3)] for x in mine) / sum(mine) * lower

    return [-sum(math.log(p(g)) for g in x) / len(x) for x in grams]


def many(rng):
    texts = [" ".join("".join(rng.choices("абв ab7.", k=5)) for _ in range(30)) for _ in range(12)]
    return [*texts, texts[0], "", None, "A  b\n\nЖ", "".join(chr(0x4E00 + rng.randrange(1200)) for _ in range(1500))]


def test_scores_by_formulas(spark, monkeypatch):
    texts = many(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS lang")
    spelling = quality.Spelling(quality.characters(docs))
    assert not spelling.short
    want = plain_model(texts, spelling)
    for rows, chunk in ((docs, 1 << 25), (docs.repartition(3), 1)):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        got = {r.doc_id: r.log_ppl for r in quality.measured(rows).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-5)


def test_characters_stay_apart():
    ranked = np.delete(np.arange(0x110000), np.flatnonzero(quality.alphabet() == 0))
    table = quality.Spelling(ranked).table[ranked].astype(np.int64) + 1
    assert len(np.unique(table @ [1 << 22, 1 << 11, 1])) == len(ranked)
    assert table.max() <= 1024


@pytest.mark.parametrize("words", ["ба да га ла ма на", "漢字 亂中 有序 人人 生而 自由"])
def test_shuffled_letters_of_any_script_are_less_likely(spark, words):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices(words.split(), k=rng.randint(1, 3))) for _ in range(80)) for _ in range(60)]
    shuffled = ["".join(rng.sample(t, len(t))) for t in texts[:6]]
    docs = spark.createDataFrame(list(enumerate(texts + shuffled)), "doc_id long, text string").selectExpr("*", "'x' AS lang")
    got = {r.doc_id: r.log_ppl for r in quality.measured(docs).collect()}
    assert min(got[60 + i] for i in range(6)) > max(got[i] for i in range(60))
    spelling = quality.Spelling(quality.characters(docs))
    assert len({int(spelling.table[ord(c), 0]) for c in words if c != " "}) == len(set(words) - {" "})


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("ба да la lo".split(), k=3)) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long), (2, long[:300]), (3, None)], "doc_id long, text string").selectExpr("*", "'x' AS lang")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert got[1].n_words == 60_000 and got[3].n_words == 0 and got[3].base_failed


def test_model_grows_and_sees_letters(spark):
    rng = random.Random(4)
    word = lambda s: "".join(rng.choices(s, k=rng.randint(1, 4)))
    # The letters of the odd text are of the same classes in the base: those of Latin letters are told apart, others aren't.
    rows = [(i, " ".join(word("ба да га ла".split()) for _ in range(rng.randint(60, 150))), "xa") for i in range(200)]
    rows.append((900, " ".join(word("ср фр ур ыр".split()) for _ in range(90)), "xa"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert not kept[900] and sum(kept[i] for i in range(200)) >= 196
    size = lambda d: quality.gathered(d, quality.characters(d), 8).where("part >= 0").selectExpr("sum(size)").first()[0]
    more = spark.createDataFrame([(i, "".join(rng.choices("бвгдежзик ", k=4000)), "x") for i in range(32)], "doc_id long, text string, lang string").coalesce(1)
    assert size(more) > 3 * size(more.where("doc_id < 8"))
