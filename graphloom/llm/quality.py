"""Quality rules: counts of words, symbols and repeats, and perplexity within bands of the document's language.

The language model is interpolated Kneser-Ney over the letters of all texts. Its n-grams, as many as the corpus has, stay
spread over parts by the three symbols before the last one, so all orders above the base meet in one part. The base is a
model of classes of symbols, of bounded size.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import store
from .common import bounded, col, cut, partitions, sliced
from .tokenfile import opened

#: The base: n-grams are of ORDER classes out of 2^BITS, so it has 2^(ORDER * BITS) entries at most, whatever the corpus.
ORDER, BITS = 4, 5
#: The model over it: LONG symbols of WIDE bits. The SINGLE most frequent characters are one symbol each, others two or three.
LONG, WIDE, SINGLE = 6, 10, 767
#: Bytes of text whose n-grams are counted together before they are dealt out.
CHUNK = 32 << 20
#: Width of a bin of log-perplexity; a band reaches REACH times the spread of the middle half beyond the quartiles, and LEAST at least.
BIN, REACH, LEAST = 0.002, 4.0, 0.1
SYMBOLS = "#*$%&|<>"
_PUNCTUATION = ".,;:!?'\"()-"


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """The symbol of each code point: 0 white space, 1 to 26 the base letter, 27 and 28 other letters, 29 digits, 30 punctuation, 31 the rest."""
    out = np.full(0x110000, 31, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            base = unicodedata.normalize("NFD", c.lower())[0]
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 27 + (i & 1)
        elif c.isspace():
            out[i] = 0
        elif c.isdigit():
            out[i] = 29
        elif c in _PUNCTUATION:
            out[i] = 30
    return out


def pieces(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and how many each text has. White space is one space however long; each text ends with one."""
    parts = [t or "" for t in texts]
    points = np.frombuffer("".join(p + "\n" for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    full = alphabet()[points] != 0
    ends = np.cumsum([len(p) + 1 for p in parts])
    keep = full.copy()
    keep[1:] |= full[:-1]
    keep[ends - 1] = True
    sizes = np.add.reduceat(keep.astype(np.int64), np.concatenate([[0], ends[:-1]])) if parts else np.zeros(0, np.int64)
    return np.where(full, points, 32)[keep], sizes


def windows(symbols: np.ndarray, sizes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """For each symbol the number made of it and the order - 1 before it in its text, before which there are zeros."""
    place = np.arange(len(symbols)) + np.repeat(np.arange(1, len(sizes) + 1) * (order - 1), sizes)
    row = np.zeros(len(symbols) + len(sizes) * (order - 1), np.int64)
    row[place] = symbols
    out = row.copy()
    for k in range(1, order):
        out[k:] |= row[:-k] << bits * k
    return out[place]


def codes(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of classes of all texts in a row, as numbers, and how many each text has: one for each symbol and one for its end."""
    points, sizes = pieces(texts)
    return windows(alphabet()[points], sizes, order, BITS), sizes


def characters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """All characters of the lower-case texts but white space, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in sliced(batches):
            seen = np.bincount(np.frombuffer("".join(t for t in b.column(0).to_pylist() if t).lower().encode("utf-32-le", "surrogatepass"), np.uint32))
            total[: len(seen)] += seen
        seen = np.nonzero((alphabet() != 0) & (total > 0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["point", "n"])

    bounded(docs.sparkSession)
    found = docs.select(col(text_col).alias("text")).mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).toArrow()
    point, n = found["point"].to_numpy().astype(np.int64), found["n"].to_numpy()
    return point[np.lexsort((point, -n))]


class Spelling:
    """Writes characters as symbols, different ones differently: 0 is white space, then SINGLE characters by one symbol, the rest by a lead and one or two more."""

    def __init__(self, ranked: np.ndarray):
        rank = np.arange(len(ranked))
        table, rest = np.full((0x110000, 3), -1, np.int16), rank - SINGLE
        table[32, 0] = 0
        mask, leads = (1 << WIDE) - 1, (1 << WIDE) - SINGLE - 2
        two = (rest >= 0) & (rest < leads << WIDE)
        three = rest >= leads << WIDE
        table[ranked, 0] = np.where(rest < 0, rank + 1, np.where(two, SINGLE + 1 + (rest >> WIDE), mask))
        last = rest - (leads << WIDE)
        table[ranked[two], 1] = rest[two] & mask
        table[ranked[three], 1], table[ranked[three], 2] = last[three] >> WIDE, last[three] & mask
        self.table, self.short = table, len(ranked) <= SINGLE
        #: The class of each symbol in the base.
        self.classes = np.full(1 << WIDE, 31, np.int64)
        self.classes[0] = 0
        self.classes[1 : 1 + min(SINGLE, len(ranked))] = alphabet()[ranked[:SINGLE]]

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of LONG symbols of all texts in a row, as numbers by `turned`, and how many each text has."""
        points, sizes = pieces([(t or "").lower() for t in texts])
        if self.short:
            symbols = self.table[points, 0]
        else:
            spelled = self.table[points]
            sizes = np.add.reduceat((spelled >= 0).sum(axis=1), np.concatenate([[0], sizes.cumsum()[:-1]])) if texts else sizes
            symbols = spelled[spelled >= 0]
        return turned(windows(symbols, sizes, LONG, WIDE)), sizes


def turned(x: np.ndarray) -> np.ndarray:
    """n-grams a b c d e w as c d e a b w: sorted, those of one context stand together, and so do those of its last three symbols."""
    return (x >> WIDE & CORE) << 3 * WIDE | (x >> 4 * WIDE) << WIDE | x & (1 << WIDE) - 1


CORE = (1 << 3 * WIDE) - 1


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of the counts of each."""
    key, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    at = np.argsort(key)
    key, n = key[at], n[at]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return key[starts], np.add.reduceat(n, starts) if len(key) else n


class Tally:
    """Counts of n-grams; what is added is merged when it is as much as what is there."""

    def __init__(self):
        self.keys, self.counts, self.loose = [], [], 0

    def add(self, grams: np.ndarray) -> None:
        key, n = np.unique(grams, return_counts=True)
        self.keys.append(key)
        self.counts.append(n)
        self.loose += len(key)
        if self.loose > 1 << 21 and self.loose > 2 * len(self.keys[0]):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = summed(self.keys, self.counts)
        self.keys, self.counts, self.loose = [key], [n], 0
        return key, n


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a task in parts of about CHUNK bytes, the same ones each time."""
    held, size = [], 0
    for b in sliced(batches):
        held.append(b)
        size += b.nbytes
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def numbered(batches: Iterator[pa.RecordBatch], spelling: Spelling) -> Iterator[tuple[int, list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(number, rows, n-grams, counts) of each chunk of this task."""
    for k, held in enumerate(chunks(batches)):
        tally = Tally()
        for b in held:
            tally.add(spelling.grams(b.column("text").to_pylist())[0])
        yield TaskContext.get().partitionId() << 24 | k, held, *tally.merge()


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order in which n-grams of one part stand together, sorted, and where each part starts and the last ends."""
    h = hashed(keys >> 3 * WIDE, 3)
    part = (h % np.uint64(parts)).astype(np.int64)
    at = np.argsort(part, kind="stable")
    return at, np.searchsorted(part[at], np.arange(parts + 1))


def packed(x: np.ndarray, width: int) -> bytes:
    """Numbers byte by byte of their `width` lowest bytes, all lowest first, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<i8").astype(np.int64)


#: A chunk's n-grams of one part; part -1 has those of classes, and single symbols from 2^(ORDER * BITS) on.
GRAMS = "part int, chunk long, size long, grams binary, counts binary"


def gathered(rows: DataFrame, ranked: np.ndarray, parts: int) -> DataFrame:
    """GRAMS of all texts, counted in each chunk first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(ranked)
        for chunk, _, keys, n in numbered(batches, spelling):
            at, ends = dealt(keys, parts)
            out = [(p, keys[at[i:j]], n[at[i:j]]) for p, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if i < j]
            out.append((-1, *summed([classed(keys, spelling.classes), (keys & (1 << WIDE) - 1) + (1 << ORDER * BITS)], [n, n])))
            columns = [[p for p, _, _ in out], [chunk] * len(out), [len(k) for _, k, _ in out], [packed(k, 8) for _, k, _ in out], [packed(c, 5) for _, _, c in out]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["part", "chunk", "size", "grams", "counts"])

    return rows.mapInArrow(run, GRAMS)


def classed(keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The n-grams of classes of the last ORDER symbols."""
    out = classes[keys & (1 << WIDE) - 1]
    for k in range(1, ORDER):
        out = out | classes[keys >> (2 + k) * WIDE & (1 << WIDE) - 1] << BITS * k
    return out


def base_of(grams: DataFrame, spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of each n-gram of classes, and of each symbol in its class: their sum is that of a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(r["grams"], r["size"], 8)), pa.array(unpacked(r["counts"], r["size"], 5))], names=["code", "n"])

    table = grams.where("part = -1").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = table["code"].to_numpy().astype(np.int64), table["n"].to_numpy().astype(np.int64)
    low = code < 1 << ORDER * BITS
    single = np.ones(1 << WIDE)
    single[code[~low] - (1 << ORDER * BITS)] += n[~low]
    return every(estimate(code[low], n[low])), np.log(single / np.bincount(spelling.classes, single, 1 << BITS)[spelling.classes])


def shorter(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams without their first symbol, in order; each one's place among these; and how many different first symbols these have."""
    between = order - 5  # Symbols between the first one and the last: those before it, without the three by which they are sorted.
    rest = keys & (1 << (between + 1) * WIDE) - 1
    return np.unique((keys >> (between + 2) * WIDE) << (between + 1) * WIDE | rest, return_inverse=True, return_counts=True)


def levels_of(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, counts, places among the next lower ones), from the highest order to ORDER; lower counts are of the different symbols before."""
    out = []
    for order in range(LONG, ORDER, -1):
        low, place, before = shorter(keys, order)
        out.append((keys, n, place))
        keys, n = low, before
    return [*out, (keys, n, np.zeros(0, np.int64))]


def probabilities(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], taken_by_order: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The interpolated probabilities of the highest order's n-grams, from the base's of the lowest order's."""
    lower = base
    for k in range(len(levels) - 1, -1, -1):
        keys, n, place = levels[k]
        if k < len(levels) - 1:
            lower = lower[place]
        context = keys >> WIDE
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        taken = taken_by_order[k][np.minimum(n, 3)]
        total = np.add.reduceat(n, starts)
        lower = (n - taken) / total[of] + (np.add.reduceat(taken, starts) / total)[of] * lower
    return lower


def merged(rows: pa.Table) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """Each chunk's n-grams, and all different ones with their counts."""
    rows = rows.to_pylist()
    mine = [(r["chunk"], unpacked(r["grams"], r["size"], 8)) for r in rows]
    return mine, *summed([k for _, k in mine], [unpacked(r["counts"], r["size"], 5) for r in rows])


def answered(grams: DataFrame, spelling: Spelling, folder: str) -> dict[int, str]:
    """Writes log-probabilities of each part's n-grams for each chunk that has them, one file a part; returns the file of each part."""
    base, single = base_of(grams, spelling)
    classes, real = spelling.classes, grams.where("part >= 0").groupBy("part")

    def few(rows: pa.Table) -> pa.Table:
        found = [np.bincount(np.minimum(n, 5), minlength=6)[1:5] for _, n, _ in levels_of(*merged(rows)[1:])]
        return pa.table({f"n{k}": pa.array([[int(x) for x in f] for f in found][k : k + 1], pa.list_(pa.int64())) for k in range(len(found))})

    depth = LONG - ORDER + 1
    sums = real.applyInArrow(few, ", ".join(f"n{k} array<long>" for k in range(depth)))
    row = sums.agg(*(F.sum(F.col(f"n{k}")[j]).alias(f"s{k}_{j}") for k in range(depth) for j in range(4))).first()
    taken = np.array([taken_from(*(float(row[f"s{k}_{j}"] or 0) for j in range(4))) for k in range(depth)])

    def write(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        mine, keys, n = merged(rows)
        levels = levels_of(keys, n)
        least = levels[-1][0]
        # The lowest order's n-grams have no symbols between: three and the last.
        wide = least >> WIDE << 3 * WIDE | least & (1 << WIDE) - 1
        logp = np.log(probabilities(levels, taken, np.exp(base[classed(wide, classes)] + single[least & (1 << WIDE) - 1]))).astype("<f4")
        at = np.array([len(k) for _, k in mine], "<i8").cumsum()
        fs, root = opened(folder)
        name = f"{part}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{name}") as out:
            out.write(np.concatenate([[len(mine)], [c for c, _ in mine], at]).astype("<i8").tobytes())
            for _, k in mine:
                out.write(logp[np.searchsorted(keys, k)].tobytes())
        return pa.table({"part": pa.array([part], pa.int32()), "name": [name]})

    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    return {r.part: r.name for r in real.applyInArrow(write, "part int, name string").collect()}


def fetched(folder: str, name: str, chunk: int, n: int) -> np.ndarray:
    """The n log-probabilities that a part's file has for a chunk."""
    fs, root = opened(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        size = int(np.frombuffer(f.read_at(8, 0), "<i8")[0])
        head = np.frombuffer(f.read_at(16 * size, 8), "<i8")
        k = np.flatnonzero(head[:size] == chunk)
        start, end = (int(np.append(0, head[size:])[k[0] + x]) for x in (0, 1)) if len(k) else (0, -1)
        if end - start != n:
            raise RuntimeError("the documents came otherwise than at first: store them before they are judged")
        return np.frombuffer(f.read_at(4 * n, 8 + 16 * size + 4 * start), "<f4")


class Lookup:
    """Values by keys, in a table of twice as many places or more, probed one after the other."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (1 << self.bits) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        off = np.flatnonzero(self.keys[slot] != keys)
        while len(off):
            slot[off] = (slot[off] + 1) & (1 << self.bits) - 1
            found = self.keys[slot[off]]
            if (found < 0).any():
                raise RuntimeError("the documents came otherwise than at first: store them before they are judged")
            off = off[found != keys[off]]
        return self.values[slot]


def hashed(codes_: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of an n-gram of that order; different n-grams have different ones, as every step can be undone."""
    x = codes_.astype(np.uint64) | np.uint64(order << 56)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


@dataclass(frozen=True)
class Level:
    """The n-grams of one order that occur, by themselves or as contexts: sorted hashes, log-probabilities; and their log-weights as contexts of the next order."""

    hashes: np.ndarray
    logp: np.ndarray
    weight: np.ndarray

    def find(self, codes_: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        h = hashed(codes_, order)
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return at, (self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool))


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and from 3 on, from the numbers of n-grams with counts 1 to 4."""
    return taken_from(*(float((n == k).sum()) for k in (1, 2, 3, 4)))


def taken_from(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.clip(d, 0, [0, 1, 2, 3])


def estimate(code: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[Level]:
    """The interpolated modified Kneser-Ney model of all n-gram counts, as sorted hash arrays, lowest order first.

    Counts of the highest order are as counted; those of a lower one are how many different symbols stand before it.
    """
    base = 1 << BITS
    tables = [np.zeros(base**order, np.int64)]
    tables[0][code] = n
    for k in range(order - 1, 0, -1):
        tables.insert(0, (tables[0] > 0).reshape(base, base**k).sum(axis=0))
    lower, levels = np.full(base, 1.0 / base), []
    weights: list[np.ndarray] = []
    for k, table in enumerate(tables, 1):
        c = table.reshape(-1, base).astype(np.float64)
        d = discounts(table)
        taken = d[np.minimum(table, 3)].reshape(-1, base)
        total = c.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(total > 0, taken.sum(axis=1, keepdims=True) / total, 1.0)
            own = np.where(total > 0, (c - taken) / total, 0.0)
        # The next lower order's probabilities repeat for each first symbol of the context.
        p = own + rest * (lower if k == 1 else np.resize(lower.reshape(-1, base), c.shape))
        lower = p.reshape(-1)
        weights.append(np.log(rest[:, 0]))
        # Besides what occurs: all single symbols, as there is no lower order, and what occurs as a context alone (a text's start).
        stored = table > 0 if k > 1 else np.ones(base, bool)
        if k < order:
            stored |= tables[k].reshape(-1, base).any(axis=1)
        levels.append((np.nonzero(stored)[0], np.log(np.maximum(lower, 1e-300))))
    out = []
    for k, (seen, logp) in enumerate(levels, 1):
        h = hashed(seen, k)
        at = np.argsort(h)
        weight = weights[k][seen] if k < order else np.zeros(len(seen))
        out.append(Level(h[at], logp[seen][at].astype(np.float32), weight[at].astype(np.float32)))
    return out


def every(levels: list[Level]) -> np.ndarray:
    """The log-probability of each possible n-gram of the highest order: its own, or the next lower one's with the context's weight."""
    base = 1 << BITS
    logp = np.full(base, -np.log(base))
    for k, level in enumerate(levels, 1):
        all_codes = np.arange(base**k)
        at, seen = level.find(all_codes, k)
        if k == 1:
            fallback = logp
        else:
            context, known = levels[k - 2].find(all_codes >> BITS, k - 1)
            weight = np.where(known, levels[k - 2].weight[context], 0.0) if len(levels[k - 2].weight) else 0.0
            fallback = logp[all_codes % base ** (k - 1)] + weight
        logp = np.where(seen, level.logp[at], fallback) if len(level.logp) else fallback
    return logp


def basics(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.encode().split():
            seen.add(line)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), again, repeated(words)


def repeated(words: list[bytes], size: int = 3) -> int:
    """How many words lie in a window of `size` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    m = len(ids) - size + 1
    key = ids[:m]
    for k in range(1, size):
        # Numbered anew after each step, so that keys stay small however many words there are.
        key = np.unique(key * len(number) + ids[k : k + m], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[k : k + m] |= twice
    return int(covered.sum())


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl) of each whole text, under the model of all texts.

    Texts are read three times: for their characters, for their n-grams, and for their scores. The same task must get the
    same rows in the last two, so what comes out of a shuffle is stored first; rows that still differ raise an error.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = cut(rows)
    bounded(spark)
    ranked = characters(rows)
    parts = max(partitions(spark), rows._jdf.rdd().getNumPartitions() // 4)
    folder = store.folder(spark, "quality")
    files = answered(cut(gathered(rows, ranked, parts)), Spelling(ranked), folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(ranked)
        for chunk, held, keys, _ in numbered(batches, spelling):
            at, ends = dealt(keys, parts)
            logp = np.zeros(len(keys), np.float32)
            for p, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if i < j:
                    logp[at[i:j]] = fetched(folder, files[p], chunk, j - i)
            known = Lookup(keys, logp)
            for b in held:
                texts = b.column("text").to_pylist()
                grams, sizes = spelling.grams(texts)
                total = np.add.reduceat(known.find(grams).astype(np.float64), np.concatenate([[0], sizes.cumsum()[:-1]]))
                found = [pa.array(c, pa.int64()) for c in zip(*map(basics, texts), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *found, pa.array(-total / sizes)], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["doc_id", "lang", *counted, "log_ppl"]
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in counted)}, log_ppl double")


def failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(scores: DataFrame) -> DataFrame:
    """(lang, low, high): for each language, the log-perplexities to keep, from all its documents that pass the counts.

    Quartiles are read from counts by language and bin, whose number doesn't depend on the number of documents.
    """
    bins = scores.where(~failed()).groupBy("lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * BIN))
    quartiles = bins.groupBy("lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    reach = F.greatest(REACH * (F.col("q3") - F.col("q1")), F.lit(LEAST))
    return quartiles.select("lang", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row (doc_id, counts, base_failed, kept, perplexity, low, high) for each row of docs.

    A document is kept if it passes the counts and its perplexity under the model of all texts lies in the band of its
    language. Null languages form one. Null and empty texts have no words, so they fail. Repeated rows count as often
    as they occur and give a row each. Other columns are not read; an empty table gives none. The model grows with the
    texts and is never held in one place; counting and scoring read all texts.
    """
    scores = cut(measured(docs, id_col, text_col, lang_col))
    band = bands(scores).withColumnRenamed("lang", "band_lang")
    found = scores.join(band, F.col("lang").eqNullSafe(F.col("band_lang")), "left").withColumn("base_failed", failed())
    kept = ~F.col("base_failed") & F.col("log_ppl").between(F.col("low"), F.col("high"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"),
        F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"),
    )
