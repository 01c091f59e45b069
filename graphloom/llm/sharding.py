"""Shards of nearly equal bytes: records range-partitioned by sampled, size-weighted splitters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, col, cut

#: Ranges to start with, sample keys a range, the times the mean at which a range is overfull, and rounds of subdividing.
RANGES, SAMPLES, OVERFULL, ROUNDS = 512, 16, 4.0, 6


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, hi, lo, row): sorted by the rest, equal texts are neighbours."""
    text = F.coalesce(col(text_col), F.lit(""))
    data = F.encode(text, "UTF-8")
    digest = F.md5(data)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return docs.select(
        col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        half(1).alias("hi"), half(16).alias("lo"), F.monotonically_increasing_id().alias("row"),
    )


def sampled(rows: DataFrame, rate: Column | float) -> DataFrame:
    """Keys, each row drawn with a chance of its size times the rate, by a number that hashes its key."""
    draw = F.pmod(F.xxhash64("hi", "lo", "doc_id", "row"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return rows.where(draw < F.col("size") * rate).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))


def tuples(keys: DataFrame) -> list[tuple]:
    return [tuple(r) for r in keys.select("hi", "lo", "id", "row").collect()]


def quantiles(keys: list[tuple], ranges: int) -> list[tuple]:
    """Up to ranges - 1 distinct keys that cut the sample into equal parts."""
    keys = sorted(keys)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def place(rows: DataFrame, splitters: list[tuple]) -> DataFrame:
    """rows with `range`: how many splitters are at or below the key. The splitters are a bounded list."""
    marks = [np.array(c, np.int64) for c in zip(*splitters, strict=True)] if splitters else [np.zeros(0, np.int64)] * 4

    def find(*cols):
        keys = [np.array([-(2**63) if x is None else x for x in cols[i]], np.int64) for i in (0, 1, 4, 5)]
        low, high = np.searchsorted(marks[0], keys[0], "left"), np.searchsorted(marks[0], keys[0], "right")
        # Equal first parts are rare but for hot texts: these few go on to the next parts of the key.
        for i in np.nonzero(low < high)[0]:
            a, b = int(low[i]), int(high[i])
            for mark, key in zip(marks[1:], keys[1:], strict=True):
                part = mark[a:b]
                a, b = a + int(np.searchsorted(part, key[i], "left")), a + int(np.searchsorted(part, key[i], "right"))
            high[i] = b
        return *cols, high.astype(np.int32).tolist()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return by_batch(rows, ["hi", "lo", "size", "text_crc32", "doc_id", "row"], find, f"hi long, lo long, size long, text_crc32 long, doc_id {kind}, row long, range int")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, samples: int = SAMPLES) -> DataFrame:
    """One row (doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs, under the law `bytes`.

    Records have a key, (hash of the text, id, row), and a size. Keys are drawn with a chance in proportion to the
    size, quantiles of the sample are the splitters, and records go to the ranges between them. The bytes and rows of
    each range are counted over all records; a range with more than OVERFULL times the mean is subdivided by splitters
    from a further sample of it, until none is, the keys end, or after ROUNDS rounds, which bounds the passes; what is
    overfull then stays so, with right results from a longer task. As a key goes on to the id and the row, the copies of
    a hot text, even repeated rows, are cut up like any others. Then each record's place among all bytes is known from
    its range's start and its place in the range, and a record belongs to the shard in which its middle byte lies: the
    sizes of two shards differ by less than twice the largest record. Slots count a shard's records from 0.

    Equal texts are neighbours in the order, so a group is on one shard unless a shard's end falls inside it. A null
    text has size 8. Null ids sort first. With fewer records than shards some stay empty; an empty table gives none.
    Other columns are not read. grown_shard is null under this law. Ids are integers.
    """
    rows = cut(keyed(docs, id_col, text_col))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    splitters = quantiles(tuples(sampled(rows, F.lit(ranges * samples / max(total, 1)))), ranges)
    for _ in range(ROUNDS):
        placed = place(rows, splitters)
        held = {r["range"]: r for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        overfull = {k: r for k, r in held.items() if r["bytes"] > OVERFULL * total / ranges and r["rows"] > 1}
        if not overfull:
            break
        # A pass draws from all of them; there are ranges / OVERFULL at most.
        rate = F.element_at(F.array(*(F.lit(samples * 64 / overfull[k]["bytes"] if k in overfull else 0.0) for k in range(len(splitters) + 1))), F.col("range") + 1)
        drawn: dict[int, list[tuple]] = {}
        for k, *key in sampled(placed, rate).select("range", "hi", "lo", "id", "row").collect():
            drawn.setdefault(k, []).append(tuple(key))
        more = {cut for k, keys in drawn.items() for cut in quantiles(keys, int(overfull[k]["bytes"] * ranges / total) + 2)}
        if not more - set(splitters):
            break
        splitters = sorted(set(splitters) | more)
    starts, at, rank = {}, 0, 0
    for k in sorted(held):
        starts[k] = (at, rank)
        at, rank = at + held[k]["bytes"], rank + held[k]["rows"]
    size = len(splitters) + 1
    of = lambda i: F.element_at(F.array(*(F.lit(starts.get(k, (0, 0))[i]).cast("long") for k in range(size))), F.col("range") + 1)
    order = Window.partitionBy("range").orderBy("hi", "lo", F.col("doc_id").asc_nulls_first(), "row")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = lambda before: F.least(F.lit(shards - 1).cast("long"), F.floor((before + F.col("size") / 2.0) * shards / F.lit(float(max(total, 1)))).cast("long")).cast("int")

    def ordered(placed: DataFrame) -> DataFrame:
        return placed.withColumn("rank", of(1) + F.row_number().over(order) - 1).withColumn("shard", mine(of(0) + F.sum("size").over(upto) - F.col("size")))

    # The first record of a shard lies in the range that holds the shard's first byte, or the one before or after.
    bounds, ends = [total * s / shards for s in range(1, shards)], sorted(starts)
    near: set[int] = set()
    for b in bounds:
        i = max([j for j, k in enumerate(ends) if starts[k][0] <= b], default=0)
        near |= set(ends[max(0, i - 1) : i + 2])
    firsts = {r["shard"]: r["first"] for r in ordered(placed.where(F.col("range").isin(*near))).groupBy("shard").agg(F.min("rank").alias("first")).collect()} if near else {}
    first = [0] + [firsts.get(s, 0) for s in range(1, shards)]
    return ordered(placed).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.element_at(F.array(*(F.lit(x).cast("long") for x in first)), F.col("shard") + 1)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


#: The same rows in DuckDB's SQL. It has no crc32: the table follows from the polynomial, the bytes are folded in order.
ORACLE = r"""
WITH RECURSIVE steps(n, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
h AS (SELECT text, hex(encode(text)) AS x FROM (SELECT DISTINCT text FROM d)),
crc AS (
  SELECT h.text, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST((instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM h, crc_table
), r AS (
  SELECT d.*, row_number() OVER w AS k, sum(size) OVER w - size AS before, sum(size) OVER () AS total
  FROM d WINDOW w AS (ORDER BY md5(text), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), s AS (SELECT *, least(23, CAST(floor((before + size / CAST(2 AS DOUBLE)) * 24 / total) AS INT)) AS shard FROM r)
SELECT s.doc_id, CAST(size AS BIGINT) AS size, crc.text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY k) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM s JOIN crc USING (text)
"""
