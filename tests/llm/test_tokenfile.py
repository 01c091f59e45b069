import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from graphloom.llm import tokenfile, wordbpe

PATH = P.path("word_bpe_49k.json")


def slow_crc32c(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert tokenfile.crc32c(b"123456789") == 0xE3069283
    rng = random.Random(2)
    for n in [0, 1, 63, 64, 65, 100, 127, 128, 1000, 5001]:
        data = rng.randbytes(n)
        assert tokenfile.crc32c(data) == slow_crc32c(data)


def test_many_checksums():
    rng = random.Random(3)
    items = [rng.randbytes(n) for n in [0, 1, 5, 9] * 9 + [8] * 40 + list(range(20, 400, 3)) + [70_000, 66_001]]
    assert tokenfile.crc32c_many(items) == [slow_crc32c(x) for x in items] and tokenfile.crc32c_many([]) == []


def test_frames_notice_damage():
    data = tokenfile.framed([b"x" * 90])[0]
    assert tokenfile.unframed(b"??" + data, [2]) == [b"x" * 90]
    for i in (0, 9, 40, len(data) - 1):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            tokenfile.unframed(bytes(bad), [0])


TEXTS = [None, "", "Hello, World. it's  DON'T\n\nstop... 3.5", "naïve Ça Σίσυφος ΟΔΟΣ Ȧ́", "a.b, c.\t., .", "<|endoftext|> x", "İstanbul ﬁ ½ 12ab", "日本語 text. end", "word " * 2000, "\x1c a\x0bb"]


def test_words_equal_whole_texts():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    texts = TEXTS + ["x's, it's. 'tis (don't!) über, \u00c9T\u00c9... \u0132. e\u0301, a\u0338= \u1e9e! ab\u00b2 x_y, a-b; q~ \ufb01,", " lead", "tail \x0b\x1f\x85\xa0 \u2028end", "MARKS!!?? '' 's 's, a's b've", "\U0001f600, \u0130. \u00df?"]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    for more, tail in ((None, []), (7, [7])):
        ids, ends = wordbpe.encode_words(texts, PATH, more)
        assert [g.tolist() for g in np.split(ids, ends[:-1])] == [w + tail for w in want] and ends[-1] == len(ids)
    assert [len(x) for x in wordbpe.encode_words([], PATH, 7)] == [0, 0]


def test_words_are_forgotten_without_a_change(monkeypatch):
    ids, ends = wordbpe.encode_words(TEXTS, PATH)
    monkeypatch.setattr(wordbpe, "WORDS", 5)
    for texts in ([x] for x in TEXTS):
        wordbpe.encode_words(texts, PATH)
    again = wordbpe.encode_words(TEXTS, PATH)
    assert ids.tolist() == again[0].tolist() and ends.tolist() == again[1].tolist()


@pytest.mark.parametrize("files,span", [(None, 1 << 20), (5, 300)])
def test_round_trip(spark, tmp_path, files, span):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    rows = [(3 * i % 61, TEXTS[i % len(TEXTS)]) for i in range(61)] + [(None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(i, x, "c") for i, x in rows], "doc_id long, text string, start string")
    written = tokenfile.write(docs, str(tmp_path / "out"), PATH, 2, files=files)
    got = sorted(tokenfile.read(spark, str(tmp_path / "out"), written, span=span).collect(), key=lambda r: r.start)
    want = sorted(((-1 if i is None else i), t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    key = lambda i, ids: (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(key(*w) for w in want)
    mixed = list(tokenfile.shuffled(str(tmp_path / "out"), [w[0] for w in written], 5))
    assert sorted((-1 if i is None else i, ids.tolist()) for i, ids in mixed) == want and [i for i, _ in mixed] != [i for i, _ in want]


def test_nothing(spark, tmp_path):
    written = tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "out"), PATH, 2)
    assert written == [] and tokenfile.read(spark, str(tmp_path / "out"), written).collect() == []
