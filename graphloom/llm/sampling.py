"""Bounded samples of labelled rows to learn from, drawn label by label."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, fresh, sliced

#: How much more than asked is drawn, so that an estimate of the number of rows never leaves too few.
_MORE = 1.3


def key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text, by which rows are drawn: the same in every run, and different for rows that are not alike in both."""
    return F.xxhash64(col(id_col), col(text_col))


def draw(pool: DataFrame, rows: int, size: int, label: str = "label") -> list[tuple]:
    """(label, at) of up to `rows` different keys of each label, or fewer if their texts reach `size` bytes before; one at least.

    pool: (label, at, size), a row for each labelled text; no text is moved. Rows alike in id and text are one, so null
    and repeated ids don't swell the sample: of each label some keys come to the driver, `rows` times _MORE at most as
    far as their number was estimated well, and those with the smallest hashes are taken. A label with a few rows
    gives them all. The model that learns from them has a part for each label, so labels are few.
    """
    spark, mix = pool.sparkSession, F.pmod(F.xxhash64("at", F.lit("draw")), F.lit(1 << 32))
    counts = pool.where(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct("at", 0.02).alias("n")).collect()
    if not counts:
        return []
    limits = spark.createDataFrame([(r[label], int((1 << 32) * min(1.0, _MORE * rows / max(r["n"], 1)))) for r in counts], f"{label} {pool.schema[label].dataType.simpleString()}, upto long")
    # One row a label.
    found = pool.join(F.broadcast(limits), label).where(mix < F.col("upto")).select(label, "at", mix.alias("order"), "size").distinct().collect()
    out: list[tuple] = []
    had: dict = {}
    for r in sorted(found, key=lambda r: (r["order"], r["at"])):
        n, total = had.get(r[label], (0, 0))
        if n < rows and (not n or total + r["size"] <= size):
            out.append((r[label], r["at"]))
            had[r[label]] = n + 1, total + r["size"]
    return out


def taken(docs: DataFrame, drawn: list[tuple], label_type: str, make: Callable[[list, list[str], list[int]], list], schema: str, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """What make gives for the drawn rows' (labels, texts, keys), once for each, in the order of keys. Its columns begin with label and at."""
    spark = docs.sparkSession
    mine = spark.createDataFrame(drawn, f"label {label_type}, at long")
    # As many rows as were drawn, which has a bound.
    at = fresh(docs, "at")
    rows = docs.select(col(text_col).alias("text"), key(id_col, text_col).alias(at)).join(F.broadcast(mine), F.col(at) == F.col("at")).select("label", "text", "at")

    def run(batches):
        # Copies of a row go no further than here; what other tasks have of them is dropped below.
        seen: set[tuple] = set()
        for b in sliced(batches):
            some = [r for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if (r[0], r[2]) not in seen and not seen.add((r[0], r[2]))]
            if some:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(*map(list, zip(*some, strict=True)))], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    bounded(spark)
    return rows.mapInArrow(run, schema).dropDuplicates(["label", "at"]).toArrow().sort_by([("at", "ascending"), ("label", "ascending")])


def piece(text: str, at: int, most: int) -> str:
    """The text, or of a longer one a run of `most` code points from a place that the key fixes."""
    return text if len(text) <= most else text[(start := at % (len(text) - most + 1)) : start + most]
