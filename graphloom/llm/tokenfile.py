"""Token ids in files of length-delimited records, with an index of offsets.

A record is its length (8 bytes, little-endian), the masked CRC-32C of those 8 bytes, the data, and the masked CRC-32C
of the data. The data is a header (id of the document, number of tokens) and the ids as unsigned 16- or 32-bit numbers.
Beside part-k.rec lies part-k.idx: for each record its place in the file, the tokens before it in the file, and its
length in tokens, 24 bytes each, so that a reader can take any record of any file on its own.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import store
from .common import BATCH_BYTES, bounded, col, partitions, sliced
from .wordbpe import encode_words

_HEAD = struct.Struct("<qqB")
_INDEX = np.dtype([("at", "<u8"), ("before", "<u8"), ("n", "<u8")])
#: Castagnoli's polynomial, reflected, and the constant by which checksums are masked.
_POLY, _MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of text that one file's records come from, about, where there is more text than the session's partitions take. Tasks stream it.
FILE_BYTES = 512 << 20


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1)
    return c


_T = _table()
_T2 = np.arange(1 << 16, dtype=np.uint32)
for _ in range(2):
    _T2 = _T[_T2 & 255] ^ (_T2 >> 8)


def _shift(n: int) -> list[int]:
    """The columns of the matrix that carries a checksum state over n zero bytes."""
    cols = [1 << i for i in range(32)]
    square = [int(_T[x & 255]) ^ (x >> 8) for x in cols]
    while n:
        if n & 1:
            cols = [_apply(square, x) for x in cols]
        square, n = [_apply(square, x) for x in square], n >> 1
    return cols


def _apply(matrix: list[int], x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= matrix[low.bit_length() - 1]
        x ^= low
    return out


def _wide(n: int) -> np.ndarray:
    """The same matrix as four tables of 256 entries, one for each byte of the state."""
    cols = np.array(_shift(n), np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(np.arange(256) >> bit & 1, cols[8 * byte + bit], np.uint32(0))
    return out


_FOLDS: dict[int, np.ndarray] = {}
#: Bytes of data that one lane of the checksums takes.
BLOCK = 64


def crc32c(data: bytes) -> int:
    return crc32c_many([data])[0]


def crc32c_many(items: list[bytes]) -> list[int]:
    """CRC-32C of each item. All are cut into blocks that go through numpy side by side, two bytes a step; then the states of neighbours are folded in pairs."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    count = np.maximum(-(-sizes // BLOCK), 1)
    # Zero bytes in front leave a zero state as it is; the state's start is laid over the first four bytes instead.
    grid = np.frombuffer(bytearray().join([d.rjust(n, b"\0") for d, n in zip(items, (count * BLOCK).tolist(), strict=True)]), np.uint8)
    at = count.cumsum() * BLOCK - sizes
    for k in range(4):
        grid[(at + k)[sizes >= 4]] ^= 255
    c = np.zeros(len(grid) // BLOCK, np.uint32)
    for step in np.ascontiguousarray(grid.view("<u2").reshape(-1, BLOCK // 2).T):
        c = _T2[(c ^ step) & 0xFFFF] ^ (c >> 16)
    width = BLOCK
    while len(c) > len(items):
        half = (count + 1) // 2
        # An odd number of lanes gets a zero one in front.
        row = np.zeros(2 * int(half.sum()), np.uint32)
        row[np.arange(len(c)) + np.repeat((2 * half - count).cumsum(), count)] = c
        if width not in _FOLDS:
            _FOLDS[width] = _wide(width)
        t, a = _FOLDS[width], row[0::2]
        c = t[0][a & 255] ^ t[1][a >> 8 & 255] ^ t[2][a >> 16 & 255] ^ t[3][a >> 24] ^ row[1::2]
        count, width = half, 2 * width
    out = (c ^ np.uint32(0xFFFFFFFF)).tolist()
    for i in np.flatnonzero(sizes < 4).tolist():
        state = 0xFFFFFFFF
        for b in items[i]:
            state = int(_T[(state ^ b) & 255]) ^ (state >> 8)
        out[i] = state ^ 0xFFFFFFFF
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def framed(data: list[bytes]) -> list[bytes]:
    """Each item as a record."""
    heads = [struct.pack("<Q", len(d)) for d in data]
    sums = zip(heads, data, crc32c_many(heads), crc32c_many(data), strict=True)
    return [h + struct.pack("<I", masked(a)) + d + struct.pack("<I", masked(b)) for h, d, a, b in sums]


def unframed(buffer: bytes, places: list[int]) -> list[bytes]:
    """The data of the records that start at these places; ValueError if a length or checksum doesn't fit."""
    heads, data, sums = [], [], []
    for at in places:
        head = buffer[at : at + 12]
        if len(head) < 12:
            raise ValueError(f"no record at {at}")
        n = struct.unpack_from("<Q", head)[0]
        end = at + 12 + n
        if end + 4 > len(buffer):
            raise ValueError(f"bad record length at {at}")
        heads.append(head[:8])
        data.append(buffer[at + 12 : end])
        sums.append((struct.unpack_from("<I", head, 8)[0], struct.unpack_from("<I", buffer, end)[0]))
    for at, (a, b), x, y in zip(places, sums, crc32c_many(heads), crc32c_many(data), strict=True):
        if a != masked(x) or b != masked(y):
            raise ValueError(f"bad record at {at}")
    return data


def packed(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    return _HEAD.pack(-1 if doc_id is None else doc_id, len(ids), doc_id is None) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(data: bytes, wide: bool) -> tuple[int | None, np.ndarray]:
    doc_id, n, null = _HEAD.unpack_from(data)
    return (None if null else doc_id), np.frombuffer(data, "<u4" if wide else "<u2", n, _HEAD.size)


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system that the folder is on, in any task: what pyarrow can open, which includes Hadoop's and local paths."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", wide: bool = False, files: int | None = None) -> list[tuple[int, int, int]]:
    """Encodes every whole text, appends end_id, and writes the records in ascending id order; (file, documents, tokens) of each file.

    Documents are range-partitioned by id (the hash of the text and the row break ties, so that a much repeated id
    is spread too), sorted, and each partition is written as one file: file k's ids come before file k + 1's. A file
    is written under another name and then moved, so an attempt that is lost or runs twice leaves whole files only,
    all the same. What comes back to the driver is three numbers a file of about FILE_BYTES of text.

    Null texts are empty and give a record with end_id alone. Null ids come first; ids are whole numbers (records have 8
    bytes for them). Other columns are not read.
    """
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    if files is None:
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(total // FILE_BYTES, min(partitions(docs.sparkSession), total // (1 << 20) + 1)) + 1
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("_row").asc()]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(int(files), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, base = opened(folder)
        temp = f"{base}/_{part}-{uuid.uuid4().hex}"
        n, at, before = 0, 0, 0
        with fs.open_output_stream(temp) as out, fs.open_output_stream(f"{temp}.idx") as marks:
            # The more text at once, the fewer distinct words are looked up.
            for b in sliced(batches, BATCH_BYTES):
                ids, ends = encode_words(b.column(1), tokenizer_path, end_id)
                starts = np.concatenate([[0], ends[:-1]])
                records = framed([packed(k, ids[i:j], wide) for k, i, j in zip(b.column(0).to_pylist(), starts.tolist(), ends.tolist(), strict=True)])
                stops = np.fromiter(map(len, records), np.int64, len(records)).cumsum()
                index = np.zeros(len(records), _INDEX)
                index["at"][0], index["at"][1:] = at, at + stops[:-1]
                index["before"], index["n"] = before + starts, ends - starts
                marks.write(index.tobytes())
                out.write(b"".join(records))
                n, at, before = n + len(records), at + int(stops[-1]), before + len(ids)
        if n:
            fs.move(f"{temp}.idx", f"{base}/part-{part:06d}.idx")
            fs.move(temp, f"{base}/part-{part:06d}.rec")
            yield pa.RecordBatch.from_pydict({"file": pa.array([part], pa.int32()), "docs": [n], "tokens": [before]})
        else:
            fs.delete_file(temp)
            fs.delete_file(f"{temp}.idx")

    bounded(docs.sparkSession)
    fs, base = opened(folder)
    fs.create_dir(base, recursive=True)
    return sorted(tuple(r) for r in rows.mapInArrow(save, "file int, docs long, tokens long").collect())


#: Tokens that one task reads from files.
SPAN = 8 << 20


def read(spark, folder: str, written: list[tuple[int, int, int]], wide: bool = False, span: int = SPAN) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the files; start counts all tokens before it.

    Each task takes some consecutive records of a file, found by the index, and checks both checksums of each.
    """
    starts = np.cumsum([0, *(tokens for _, _, tokens in written)]).tolist()
    files = spark.createDataFrame([(f, s, d, n) for (f, d, n), s in zip(written, starts, strict=False)], "file int, start long, docs long, tokens long")
    step = F.greatest(F.lit(1), F.floor(F.col("docs") * span / F.greatest("tokens", F.lit(1)))).cast("long")
    jobs = files.withColumn("step", step).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.col("step"))))
    jobs = jobs.select("file", "start", "first", F.least(F.col("docs"), F.col("first") + F.col("step")).alias("last"))

    def load(batches):
        for b in batches:
            for file, start, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, base = opened(folder)
                with fs.open_input_file(f"{base}/part-{file:06d}.idx") as f:
                    f.seek(first * _INDEX.itemsize)
                    index = np.frombuffer(f.read((last - first + 1) * _INDEX.itemsize), _INDEX)
                with fs.open_input_file(f"{base}/part-{file:06d}.rec") as f:
                    here = int(index["at"][0])
                    f.seek(here)
                    records = f.read(int(index["at"][last - first]) - here if len(index) > last - first else None)
                rows, index = [], index[: last - first]
                for (at, before, n), data in zip(index.tolist(), unframed(records, (index["at"].astype(np.int64) - here).tolist()), strict=True):
                    doc_id, ids = unpacked(data, wide)
                    if n != len(ids):
                        raise ValueError(f"index and record differ at {at} of file {file}")
                    rows.append((doc_id, start + before, n, zlib.crc32(ids.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(partitions(spark), min(len(written), 4 * partitions(spark)))
    return jobs.repartition(tasks, "file", "first").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled(folder: str, files: list[int], seed: int, wide: bool = False) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every record of the files once, in an order fixed by the seed: a reader for training on one machine."""
    fs, base = opened(folder)
    sizes = [fs.get_file_info(f"{base}/part-{k:06d}.idx").size // _INDEX.itemsize for k in files]
    ends = np.cumsum([0, *sizes]).tolist()
    for i in np.random.default_rng(seed).permutation(ends[-1]).tolist():
        k = bisect_right(ends, i) - 1
        with fs.open_input_file(f"{base}/part-{files[k]:06d}.idx") as f:
            f.seek((i - ends[k]) * _INDEX.itemsize)
            at = np.frombuffer(f.read(2 * _INDEX.itemsize), _INDEX)["at"].tolist()
        with fs.open_input_file(f"{base}/part-{files[k]:06d}.rec") as f:
            f.seek(at[0])
            yield unpacked(unframed(f.read(at[1] - at[0] if len(at) > 1 else None), [0])[0], wide)


def new_folder(spark) -> str:
    """A folder of its own in the one that all machines share."""
    return store.folder(spark, "tokens")
