import hashlib
import random
import struct
import zlib

import pytest

from graphloom.llm import gif


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_codes_round_trip(bits):
    rng = random.Random(bits)
    for n in [0, 1, 2, 5, 300, 4000, 9000, 60_000]:
        for pool in (range(1 << bits), [0, 1], [1]):
            data = bytes(rng.choices(pool, k=n))
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def test_a_known_stream():
    # 10 x 10 pixels in four colours, as given in a public description of the format.
    codes = bytes([0x8C, 0x2D, 0x99, 0x87, 0x2A, 0x1C, 0xDC, 0x33, 0xA0, 0x02, 0x75, 0xEC, 0x95, 0xFA, 0xA8, 0xDE, 0x60, 0x8C, 0x04, 0x91, 0x4C, 0x01])
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert gif.lzw_decode(codes, 2, 100) == bytes(map(int, "".join(rows)))


def test_full_table_without_a_clear_code():
    rng = random.Random(9)
    data = rng.randbytes(30_000)
    # A table that is full stays as it is, with codes of 12 bits, until it is cleared.
    known, codes, word = {bytes([i]): i for i in range(256)}, [256], b""
    for b in data:
        if word + bytes([b]) in known:
            word += bytes([b])
            continue
        codes.append(known[word])
        if len(known) + 2 < 4096:
            known[word + bytes([b])] = len(known) + 2
        word = bytes([b])
    codes += [known[word], 257]
    bits, size = "", 258
    for i, c in enumerate(codes):
        width = 9 if i == 0 else int(gif._widths(8, i - 1, 1)[0])
        bits = f"{c:0{width}b}" + bits
    stream = int(bits, 2).to_bytes(-(-len(bits) // 8), "little")
    assert gif.lzw_decode(stream, 8, len(data)) == data and size == 258


def picture(w, h, pictures, background=b""):
    """pictures: (left, top, width, height, indexes, disposal, transparent index or None, delay, interlaced, own palette)."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette + b"\x21\xfe\x03abc\0"
    for x, y, pw, ph, data, disposal, clear, delay, laced, own in pictures:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", x, y, pw, ph, (0x40 if laced else 0) | (0x81 if own else 0)) + (own or b"") + b"\x02" + gif.blocked(gif.lzw_encode(bytes(data), 2))
    return out + b"\x3b"


def test_disposal_transparency_palettes_and_time():
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    data = picture(2, 2, [(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 10, False, None), (0, 0, 1, 1, [2], 3, None, 5, False, None), (1, 1, 1, 1, [3], 2, None, 7, False, None), (0, 0, 2, 2, [0, 2, 0, 0], 0, 0, 0, False, None), (1, 0, 1, 2, [1, 2], 0, None, 1, False, own)])
    f = list(gif.decode(data))
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].rgba.tolist() == [[red, red], [red, red]] and f[1].rgba.tolist() == [[green, red], [red, red]]
    assert f[2].rgba.tolist() == [[red, red], [red, blue]]
    assert f[3].rgba.tolist() == [[red, green], [red, none]]
    assert f[4].rgba.tolist() == [[red, [8, 8, 8, 255]], [red, [7, 7, 7, 255]]]
    assert [(x.start_ms, x.delay_ms, x.disposal) for x in f] == [(0, 100, 1), (100, 50, 3), (150, 70, 2), (220, 0, 0), (220, 10, 0)]
    assert gif.histogram(f[3].rgba) == [1, 0, 0, 0, 0, 0, 0, 2, 2, 0, 0, 0, 0, 0, 0, 1, 3, 0, 0, 0, 0, 0, 0, 0]


def plain(data):
    """(width, height, [indexes of each picture]) of a GIF with a shared palette, read bit by bit."""
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at, out = 13 + 3 * (2 << (flags & 7)), []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
            continue
        bits, at, stream = data[at + 10], at + 11, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        whole, place, table, last, samples, width = int.from_bytes(stream, "little"), 0, {}, None, [], bits + 1
        while True:
            code = whole >> place & (1 << width) - 1
            place += width
            if code == (1 << bits) + 1:
                break
            if code == 1 << bits:
                table, last, width = {i: [i] for i in range(1 << bits)}, None, bits + 1
                continue
            word = table[code] if code in table else last + last[:1]
            if last is not None and len(table) + 2 < 4096:
                table[len(table) + 2] = last + word[:1]
                width = min(12, max(width, (len(table) + 2).bit_length()))
            samples += word
            last = word
        out.append(bytes(samples))
    return w, h, out


@pytest.mark.parametrize("size", [64, 6400, 64 * 5000])
def test_another_decoder_reads_what_is_stored(size):
    rng = random.Random(size)
    payload = bytes(rng.choices(b"the quick \xff\x00brown fox", k=size)) if size < 10_000 else rng.randbytes(20_000) * (size // 20_000)
    w, h, pictures = plain(gif.pack(payload))
    assert b"".join(pictures) == payload and w == 64 and h == min(4096, size // 64) and len(pictures) == -(-size // (64 * 4096))


def test_a_canvas_is_bounded(spark):
    huge = picture(65535, 65535, [])
    wide = picture(2, 2, [(0, 0, 2, 2, [1, 2, 3, 0], 0, None, 4, False, None)])
    bad = wide[: wide.index(b"\x2c")] + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + wide[wide.index(b"\x2c") + 10 :]
    for data in (huge, bad):
        with pytest.raises(ValueError, match="65535"):
            list(gif.decode(data))
    media = spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(bad)), (3, bytearray(wide))], "id long, data binary")
    got = {(r.id, r.frame): r.error for r in gif.frames(media, "id", "data").collect()}
    assert got[3, 0] is None and "65535" in got[1, None] and "65535" in got[2, None] and len(got) == 3
    assert [r.error for r in gif.frames(media.where("id = 3"), "id", "data", most=3).collect()] == ["a canvas of 2 x 2"]


def test_interlaced_rows():
    rows = list(range(4)) * 3
    stored = [rows[y] for y in [0, 8, 4, 2, 6, 10, 1, 3, 5, 7, 9, 11]]
    f = next(gif.decode(picture(1, 12, [(0, 0, 1, 12, stored, 0, None, 0, True, None)])))
    assert list(f.samples) == rows


def test_frames_in_columns(spark):
    good = picture(2, 2, [(0, 0, 2, 2, [1, 2, 3, 0], 0, None, 4, False, None)] * 2)
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, good[:-20]), (5, b"PNG"), (None, good)]
    media = spark.createDataFrame([(i, None if d is None else bytearray(d), "x") for i, d in rows], "key long, data binary, frame string")
    got = gif.frames(media, "key", "data").collect()
    assert sorted((repr(r.id), r.frame, r.start_ms) for r in got if r.error is None) == sorted([("1", 0, 0), ("1", 0, 0), ("1", 1, 40), ("1", 1, 40), ("None", 0, 0), ("None", 1, 40), ("4", 0, 0)])
    assert sorted(r.id for r in got if r.error) == [2, 3, 4, 5]
    assert {sum(r.histogram) for r in got if r.histogram} == {12}
    assert gif.frames(media.limit(0), "key", "data").collect() == []


@pytest.mark.parametrize("height", [4, gif.HEIGHT])
def test_payloads_come_back(spark, monkeypatch, height):
    texts = [None, "", "a", "x" * 64, "ü" * 100, "lorem ipsum " * 500]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(2, "a", "m"), (None, "b", "m")], "doc_id long, text string, media string")
    for t in texts:
        data = (t or "").encode()
        data = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        with monkeypatch.context() as m:
            m.setattr(gif, "HEIGHT", height)
            assert b"".join(f.samples for f in gif.decode(gif.pack(data))) == data
    got = gif.features(gif.stored(docs)).collect()
    assert len(got) == 8
    for r in got:
        data = ((texts[r.doc_id] if r.doc_id is not None else "b") or "").encode()
        full = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.pack(full)).hexdigest() and r.media_bytes == len(gif.pack(full))
        pictures = plain(gif.pack(full))[2]
        grey = [sum(b * 8 // 256 == k for b in full) for k in range(8)]
        assert r.feature == f"64x{len(pictures[0]) // 64} frames={len(pictures)} ms={100 * len(pictures)} grey={','.join(map(str, grey))}"


def test_a_payload_of_several_frames_through_the_tables(spark):
    text = "0123456789abcdef" * 40_000
    r = gif.features(gif.stored(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (640_000, 640_000, hashlib.sha256(text.encode()).hexdigest()) and "frames=3 " in r.feature


def test_nothing(spark):
    assert gif.features(gif.stored(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
