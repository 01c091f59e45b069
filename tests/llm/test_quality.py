import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


TEXTS = [None, "", " \n\n ", "a", "a b c a b c", "x x x x", "one | two #\none | two #\n\n\n é\x1cü b\x0bc", "a\nb\na\nb\n a", "z z z", "q w e r t y q w e"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert quality.basics(text) == plain(text)


def test_codes_of_each_text_alone():
    together, sizes = quality.codes(TEXTS)
    assert together.tolist() == [c for t in TEXTS for c in quality.codes([t])[0].tolist()] and sizes.tolist() == [len(quality.codes([t])[0]) for t in TEXTS]
    # a, space, b: from three blanks on.
    assert quality.codes(["a  b"])[0].tolist() == [1, 32, 1 << 10 | 2, 1 << 15 | 2 << 5]


def slow(counts, order, base):
    """Modified Kneser-Ney by its formulas, n-gram by n-gram: a function of (context, symbol)."""
    tables = {order: dict(counts)}
    for k in range(order - 1, 0, -1):
        t = Counter()
        for g in tables[k + 1]:
            t[g[1:]] += 1
        tables[k] = dict(t)

    def p(context, w):
        k = len(context) + 1
        t = tables[k]
        d = quality.discounts(np.array(list(t.values())))
        mine = [(g[-1], c) for g, c in t.items() if g[:-1] == context]
        total = sum(c for _, c in mine)
        low = p(context[1:], w) if context else 1 / base
        if not total:
            return low
        return (t.get((*context, w), 0) - d[min(t.get((*context, w), 0), 3)]) / total + sum(d[min(c, 3)] for _, c in mine) / total * low

    return p


def test_model_by_its_formulas():
    rng = random.Random(12)
    texts = ["".join(rng.choices("aabc e", k=200)) for _ in range(6)]
    codes, _ = quality.codes(texts)
    seen, n = np.unique(codes, return_counts=True)
    logp = quality.every(quality.estimate(seen, n))
    split = lambda c: tuple(int(c) >> 5 * k & 31 for k in (3, 2, 1, 0))
    p = slow({split(c): int(k) for c, k in zip(seen, n, strict=True)}, 4, 32)
    for c in [*seen[:60].tolist(), *(rng.randrange(1 << 20) for _ in range(60)), 0, 1 << 15 | 3]:
        g = split(c)
        assert logp[c] == pytest.approx(math.log(p(g[:3], g[3])), abs=1e-5)
    for context in (0, 33, 5 << 10 | 1 << 5 | 2):
        assert np.exp(logp[context * 32 : context * 32 + 32]).sum() == pytest.approx(1, abs=1e-5)


def test_bands_reject_odd_texts(spark):
    rng = random.Random(13)
    word = lambda s: "".join(rng.choices(s, k=rng.randint(1, 4)))
    rows = [(i, " ".join(word(s) for _ in range(rng.randint(60, 150))), lang) for i in range(240) for lang, s in [[("xa", "ba da ga la".split()), ("xo", "mo no ro to so".split())][i % 2]]]
    rows += [(900, " ".join("".join(rng.choices("qxzjkv%&", k=5)) for _ in range(90)), "xa"), (901, "da " * 200, "xa"), (902, "ba da", "xa"), (903, None, None), (904, "", "xo"), (None, rows[0][1], None), (0, rows[0][1], "xa")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, kept int")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.n_words)), sorted(rows, key=lambda r: (repr(r[0]), plain(r[1])[0])), strict=True):
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (i, *plain(t))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in range(900, 905)) and sum(kept[i] for i in range(240)) >= 238
    assert quality.judge(docs.limit(0)).collect() == []
