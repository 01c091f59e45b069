"""GIF in columns: a decoder of frames, with colour histograms, and an encoder for lossless 8-bit samples."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bounded, by_batch, col, sliced

#: Codes have 12 bits at most.
_FULL = 4096


def _widths(bits: int, first: int, n: int) -> np.ndarray:
    """Bits of the codes number first, first + 1, ... after a clear code: as many as the table's size then needs."""
    size = (1 << bits) + 2 + np.maximum(np.arange(first, first + n) - 1, 0)
    return np.minimum(np.maximum(np.frexp(size.astype(np.float64))[1], bits + 1), 12)


def _codes(data: bytes, bits: int) -> Iterator[list[int]]:
    """The codes between clear codes, in runs of up to _FULL; an empty list is a clear code. Ends with the end code or the data."""
    clear, end = 1 << bits, (1 << bits) + 1
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    windows = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16
    at, first, total = 0, 0, 8 * len(data)
    while True:
        widths = _widths(bits, first, min(_FULL, (total - at) // (bits + 1) + 1))
        starts = at + np.concatenate([[0], widths.cumsum()])
        n = int(np.searchsorted(starts, total, "right")) - 1
        if n <= 0:
            return
        n = min(n, len(widths))
        codes = windows[starts[:n] >> 3] >> (starts[:n] & 7).astype(np.uint32) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stops = np.nonzero((codes == clear) | (codes == end))[0]
        if not len(stops):
            yield codes.tolist()
            at, first = int(starts[n]), first + n
            continue
        if stops[0]:
            yield codes[: stops[0]].tolist()
        if codes[stops[0]] == end:
            return
        yield []
        at, first = int(starts[stops[0] + 1]), 0


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """Palette indexes of a code stream that begins with codes of bits + 1; at most `most`, and what there is if it breaks off."""
    roots = [bytes([i]) for i in range(1 << bits)] + [b"", b""]
    table, last, out, total = list(roots), b"", [], 0
    for codes in _codes(data, bits):
        if not codes:
            table, last = list(roots), b""
            continue
        words = []
        size, add, emit = len(table), table.append, words.append
        for code in codes:
            if code < size:
                word = table[code]
                if last and size < _FULL:
                    add(last + word[:1])
                    size += 1
            elif last and code == size < _FULL:
                word = last + last[:1]
                add(word)
                size += 1
            else:
                raise ValueError("a code that is not in the table yet")
            emit(word)
            last = word
        out.append(b"".join(words))
        total += len(out[-1])
        if total >= most:
            break
    return b"".join(out)[:most]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of palette indexes, with a clear code first and whenever the table is full."""
    clear = 1 << bits
    first = clear + 2
    runs: list[list[int]] = []
    codes: list[int] = []
    known: dict[int, int] = {}
    # Bound once a table, as this loop runs for every sample.
    get, add, new = known.get, codes.append, first
    rest = iter(data)
    code = next(rest, -1)
    for sample in rest:
        pair = code << 8 | sample
        longer = get(pair)
        if longer is not None:
            code = longer
            continue
        add(code)
        code = sample
        if new < _FULL:
            known[pair] = new
            new += 1
        else:
            runs.append(codes)
            known, codes = {}, []
            get, add, new = known.get, codes.append, first
    if code >= 0:
        codes.append(code)
    runs.append(codes)
    parts, widths = [], []
    for k, run in enumerate(runs):
        # The clear code that comes first has the width that the run before it has come to.
        before = len(runs[k - 1]) if k else 0
        tail = [clear + 1] if k == len(runs) - 1 else []
        parts += [[clear], run, tail]
        widths += [_widths(bits, before, 1), _widths(bits, 0, len(run) + len(tail))]
    values, width = np.array([c for p in parts for c in p], np.uint16), np.concatenate(widths)
    grid = (values[:, None] >> np.arange(12, dtype=np.uint16) & 1).astype(np.uint8)
    return np.packbits(grid[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def blocked(data: bytes) -> bytes:
    """Data as sub-blocks of up to 255 bytes, with the end mark."""
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


@dataclass
class Frame:
    """One picture as it is shown: RGBA of the whole canvas, its time, and the indexes that it stores itself."""

    index: int
    start_ms: int
    delay_ms: int
    disposal: int
    rgba: np.ndarray
    samples: bytes


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    table = np.zeros((256, 3), np.uint8)
    table[:n] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return table, at + 3 * n


def _rows(height: int) -> list[int]:
    """The order in which an interlaced picture stores its rows. The four passes' starts and steps."""
    return [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]


#: Pixels of a canvas or picture at most: larger ones are an error, as a few bytes may claim gigabytes.
PIXELS = 1 << 26


def decode(data: bytes, most: int = PIXELS) -> Iterator[Frame]:
    """The frames of a GIF in order, composed as a player shows them. ValueError if it isn't one, breaks off, or has over `most` pixels.

    A transparent index leaves what is below. Before the next frame, disposal 2 clears the frame's rectangle to
    transparent, 3 brings back what was there before the frame, and others leave it.
    """
    try:
        yield from _decode(data, most)
    except (IndexError, struct.error) as e:
        raise ValueError("the data break off") from e


def _decode(data: bytes, most: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    if wide * high > most:
        raise ValueError(f"a canvas of {wide} x {high}")
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    index = clock = 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, transparent = struct.unpack_from("<BHB", body)
                delay, disposal = 10 * hundredths, packed >> 2 & 7
                clear_index = transparent if packed & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            own, at = _palette(data, at + 10, flags)
            palette = own if own is not None else shared
            bits = data[at]
            if w * h > most:
                raise ValueError(f"a picture of {w} x {h}")
            if palette is None or not 1 <= bits <= 8:
                raise ValueError("no palette or no code size")
            codes, at = _blocks(data, at + 1)
            samples = lzw_decode(codes, bits, w * h)
            if len(samples) < w * h:
                raise ValueError("a picture breaks off")
            picture = np.frombuffer(samples, np.uint8).reshape(h, w)
            if flags & 0x40:
                stored, picture = picture, np.empty_like(picture)
                picture[_rows(h)] = stored
            before = canvas.copy() if disposal == 3 else None
            shown = picture[: max(0, high - top), : max(0, wide - left)]
            place = canvas[top : top + h, left : left + w]
            seen = np.ones(shown.shape, bool) if clear_index is None else shown != clear_index
            place[seen, :3] = palette[shown[seen]]
            place[seen, 3] = 255
            yield Frame(index, clock, delay, disposal, canvas.copy(), picture.tobytes())
            if disposal == 2:
                place[:] = 0
            elif before is not None:
                canvas = before
            index, clock = index + 1, clock + delay
            delay, disposal, clear_index = 0, 0, None
        else:
            raise ValueError(f"unknown block at {at}")


def encode(frames: list[tuple[int, int, bytes]], delay_ms: int = 100, palette: bytes | None = None) -> bytes:
    """A GIF of pictures (width, height, palette indexes), each shown for delay_ms; the palette is grey unless given."""
    palette = palette or bytes(i // 3 for i in range(768))
    wide, high = max((f[0] for f in frames), default=1), max((f[1] for f in frames), default=1)
    out = [b"GIF89a", struct.pack("<HHBBB", wide, high, 0xF7, 0, 0), palette]
    for w, h, samples in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_ms // 10, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, w, h, 0), b"\x08", blocked(lzw_encode(samples))]
    return b"".join(out) + b"\x3b"


#: Samples of a row and rows of a frame when bytes are stored as pictures.
WIDTH, HEIGHT = 64, 4096


def pack(payload: bytes) -> bytes:
    """A payload of a multiple of WIDTH bytes as frames of grey samples, the last as high as is left."""
    size = WIDTH * HEIGHT
    return encode([(WIDTH, len(p) // WIDTH, p) for p in (payload[i : i + size] for i in range(0, len(payload), size))])


def histogram(rgba: np.ndarray, bins: int = 8) -> list[int]:
    """Visible pixels by red, then green, then blue, in equal bins of each."""
    seen = rgba[rgba[..., 3] > 0]
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c].astype(np.int64) * bins // 256, minlength=bins)]


def frames(media: DataFrame, id_col: str, data_col: str, most: int = PIXELS) -> DataFrame:
    """One row (id, frame, start_ms, delay_ms, width, height, rgba, histogram, error) for each frame of each GIF.

    What is null, empty, not a whole GIF, or larger than `most` pixels gives one row with the error and nulls, after the
    frames before the fault. Frames are returned one by one, so a task holds one, however many a file has. Repeated rows
    give theirs each; other columns are not read; an empty table gives none.
    """
    named = media.select(col(id_col).alias("id"), col(data_col).alias("data"))
    schema = f"id {named.schema['id'].dataType.simpleString()}, frame int, start_ms int, delay_ms int, width int, height int, rgba binary, histogram array<int>, error string"
    types = arrow_schema(schema)

    def run(batches):
        for b in sliced(batches):
            for k in range(b.num_rows):
                row = lambda *values, key=b.column(0).slice(k, 1): pa.RecordBatch.from_arrays([key, *(pa.array([v], t.type) for v, t in zip(values, list(types)[1:], strict=True))], schema=types)
                try:
                    for f in decode(b.column(1)[k].as_py() or b"", most):
                        yield row(f.index, f.start_ms, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), histogram(f.rgba), None)
                except ValueError as e:
                    yield row(*[None] * 7, str(e))

    bounded(media.sparkSession)
    return named.mapInArrow(run, schema)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's bytes, zero bytes up to a positive multiple of 64 after them, as a GIF. Null texts are empty."""
    rows = docs.select(col(id_col).alias("doc_id"), F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8").alias("data"))

    def run(doc_id, data):
        return doc_id, [len(d) for d in data], [pack(d.ljust(max(1, -(-len(d) // WIDTH)) * WIDTH, b"\0")) for d in data]

    return by_batch(rows, ["doc_id", "data"], run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """From (doc_id, n_bytes, media): the payload read back from the frames, its digests, and what the frames are like."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(doc_id, n_bytes, data):
        payload, said = [], []
        for d in data:
            parts, total, clock, size = [], np.zeros(24, np.int64), 0, (0, 0)
            for f in decode(d):
                # Frames store rows of their own height; the grey level shown is the sample.
                rows = len(f.samples) // WIDTH
                shown = f.rgba[:rows, :, 0].tobytes()
                parts.append(shown)
                total += np.array(histogram(f.rgba[:rows]))
                clock, size = f.start_ms + f.delay_ms, (f.rgba.shape[1], f.rgba.shape[0])
            payload.append(b"".join(parts))
            said.append(f"{size[0]}x{size[1]} frames={len(parts)} ms={clock} grey={','.join(map(str, total[:8].tolist()))}")
        return doc_id, n_bytes, payload, data, said

    full = by_batch(media, ["doc_id", "n_bytes", "media"], run, f"doc_id {kind}, n_bytes long, payload binary, media binary, feature string")
    return full.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
