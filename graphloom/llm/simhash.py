"""SimHash near-duplicates: fingerprints of word shingles, joined on blocks of bits, verified, and grouped."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected
from .common import bounded, by_batch, col, cut, few, fresh, partitions, row_hash

#: Words of a shingle, and the differing bits up to which fingerprints link.
WORDS, BITS, SEED = 4, 4, 42
#: The 64 bits are split into BLOCKS blocks; BLOCKS - BITS of them agree in any pair that links.
BLOCKS = 7
#: Fingerprints of one tile: two tiles at most are compared in one piece.
TILE = 1024


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of the text, A-Z lower-cased; of all words if they are fewer; none if there is no word."""
    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.fromiter(map(len, parts), np.int64, len(parts)).cumsum() + np.arange(len(parts))
    k = min(words, len(parts))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(parts) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], np.uint64, len(stops))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, whole: bool = False) -> DataFrame:
    """(doc_id, fp) of every row: the fingerprint of the whole text as a signed long, zero without a word; whole adds row_hash and text_hash."""
    hashes = {"text_hash": F.xxhash64(col(text_col)), "row_hash": row_hash(docs)} if whole else {}
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), *(c.alias(n) for n, c in hashes.items()))

    def run(doc_id, text, *more):
        return doc_id, [signed(majority(shingle_hashes(t, words))) for t in text], *more

    return by_batch(rows, ["doc_id", "text", *hashes], run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long" + "".join(f", {n} long" for n in hashes))


def masks(blocks: int, agree: int) -> list[int]:
    """The bits of every choice of `agree` blocks out of near-equal ones."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), agree)]


def spanning(fps: np.ndarray, others: np.ndarray | None, bits: int) -> Iterator[tuple[int, int]]:
    """Links among fps (or between them and others) that connect all that is connected by pairs within `bits`.

    All pairs are compared, in blocks, but only those links are returned that join two groups.
    """
    both = fps if others is None else np.concatenate([fps, others])
    parent = np.arange(len(both))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for i in range(0, len(fps), 256):
        right, offset = (both[i:], i) if others is None else (others, len(fps))
        near = np.bitwise_count(fps[i : i + 256, None] ^ right[None, :]) <= bits
        for row in range(near.shape[0]):
            a = i + row
            hits = np.nonzero(near[row])[0] + offset
            hits = hits[hits > a] if others is None else hits
            # Most hits of a dense group are joined already: those are seen at once.
            ra = root(a)
            for b in hits[parent[hits] != ra].tolist():
                rb = root(b)
                if rb != root(a):
                    yield a, b
                    parent[rb] = root(a)


def links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(a, b) with a < b: enough pairs of distinct fingerprints within `bits` to connect all that such pairs connect.

    A pair within `bits` agrees in at least blocks - bits blocks, so it shares one of the masked values below, and
    fingerprints meet on these. Per masked value the fingerprints form a group. Every group is compared in full: one
    of more than `tile` is dealt into tiles, and each pair of tiles is a piece of its own, so no task holds a group.
    Pieces return links that span what they found rather than all pairs, so a dense group gives few rows.
    """
    keys = masks(blocks, blocks - bits)
    # Each fingerprint goes under each mask; the value with the mask's number names the group.
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(keys))))
    spread = fps.select("fp", each.alias("k")).select("fp", "k.mask", "k.value")
    sizes = spread.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    # Merged always: Spark takes spread, of one row a mask, for as small as fps, and would broadcast many times what it allows.
    grouped = spread.hint("merge").join(sizes, ["mask", "value"]).withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    tiled = grouped.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("mask", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    pieces = tiled.repartition(partitions(fps.sparkSession), "mask", "value", "i", "j").sortWithinPartitions("mask", "value", "i", "j", "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own, fp in pieces_of(batches):
            first = own == key[2]
            found = np.array(list(spanning(fp, None, bits) if key[2] == key[3] else spanning(fp[first], fp[~first], bits)), np.int64).reshape(-1, 2)
            if len(found):
                ordered = fp if key[2] == key[3] else np.concatenate([fp[first], fp[~first]])
                pair = np.sort(ordered.view(np.int64)[found], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    bounded(fps.sparkSession)
    return pieces.mapInArrow(compare, "a long, b long").distinct()


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, own, fingerprints) of each run of rows with the same first four columns, across batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.nonzero(new)[0].tolist(), b.num_rows]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(int(c[i]) for c in cols[:4])
            if held and key != last:
                yield last, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held = []
            held.append([cols[4][i:j], cols[5][i:j].view(np.uint64)])
            last = key
    if held:
        yield last, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def classes(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(fp, group, component_id): for each distinct fingerprint, the smallest fingerprint and the smallest doc_id linked to it, directly or not.

    prints must be stored, as it is read several times. Documents of one fingerprint are one node, whose number of
    documents plays no part, so a third of all rows may be copies. Null ids count only where there is no other.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = connected(cut(links(nodes.select("fp"), bits, blocks, tile)))
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    return named.join(named.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "group", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row of docs.

    Texts without a word (null and empty ones too) have the fingerprint zero and link like any other. Repeated rows
    and ids keep their rows. A null id is never the smallest unless its component has no other; other columns are not
    read; an empty table gives none.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    found = classes(prints, bits, blocks, tile)
    return prints.join(found, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, **how) -> DataFrame:
    """docs with one row of each component, all columns as they are: that with the smallest id, null ids last.

    Ties among rows of one id go to the smallest hash of the text, then of the whole row, so reruns agree; of rows alike
    in every column one stays. Texts without a word are one component, so one of them stays. Other columns may have any
    name and type. An empty table stays empty. Decisions are made on ids and hashes; rows that go are usually few, and
    then no text is shuffled: their keys are broadcast if they are FEW at most, else joined.
    """
    prints = fingerprints(docs, id_col, text_col, words, whole=True)
    # Rows alike in every column are one key here, so that a third of all rows may be the same.
    keys = cut(prints.groupBy("doc_id", "text_hash", "row_hash").agg(F.any_value("fp").alias("fp"), F.count("*").alias("n")))
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row_hash")
    least = keys.groupBy("fp").agg(F.min(one).alias("k")).join(classes(keys, **how), "fp").groupBy("group").agg(F.min("k").alias("k"))
    best = least.select(F.col("k.doc_id").alias("_id"), F.col("k.row_hash").alias("_row"), F.lit(True).alias("stays"))
    judged = keys.join(best, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_row")), "left")
    names = [fresh(docs, k) for k in ("id", "row", "stays")]
    others = cut(judged.where("stays is null or n > 1").select("doc_id", "row_hash", "stays").toDF(*names))
    hashed = fresh(docs, "of")
    rows, on = docs.withColumn(hashed, row_hash(docs)), col(id_col).eqNullSafe(F.col(names[0])) & (F.col(hashed) == F.col(names[1]))
    single, several = rows.join(few(others), on, "left_anti"), others.where(F.col(names[2]))
    if not several.isEmpty():
        single = single.unionByName(rows.join(few(several), on, "left_semi").dropDuplicates([hashed]))
    return single.drop(hashed)
