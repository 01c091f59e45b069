"""What the operators share: stored results, free column names and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.store import shared_dir
from ..plans.store import stored as cut

__all__ = ["arrow_schema", "bounded", "by_arrow", "by_batch", "col", "cut", "few", "fresh", "lists", "partitions", "released", "row_hash", "shared_dir", "sliced", "slices", "through", "unlisted"]

#: What counts as a word wherever an operator splits on white space: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (Spark's names ignore case)."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's columns, whatever their types; rows that differ in any column, or in where nulls are, differ in it."""
    nested = ("array", "map", "struct", "variant")
    whole = [F.to_json(F.struct(col(f.name).alias("v"))) if f.dataType.typeName() in nested else col(f.name) for f in df.schema.fields]
    return F.xxhash64(*whole, F.concat(*(col(c).isNull().cast("int").cast("string") for c in df.columns)))


#: Rows of ids and hashes that may be broadcast: about 32 MB in a table of hashes. Beyond, joins shuffle.
FEW = 500_000


def few(df: DataFrame) -> DataFrame:
    """df, a stored table of ids and hashes, marked to be broadcast if it has FEW rows at most."""
    return F.broadcast(df) if df.count() <= FEW else df


#: Bytes of an input column that one call of a Python function gets at most, a longer value standing alone; Arrow batches from the JVM are bounded likewise.
SLICE_BYTES, BATCH_BYTES = 2 << 20, 8 << 20


def by_arrow(df: DataFrame, names: list[str], fn: Callable[..., Iterable], schema: str) -> DataFrame:
    """fn over Arrow arrays of the named columns, some rows at a time; it returns a list or array for each column of the schema.

    The rows of a call are bounded by the bytes of their values (SLICE_BYTES), so memory doesn't grow with the batch.
    """
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            cols = fn(*b.columns)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(cols, types, strict=True)], schema=types)

    bounded(df.sparkSession)
    return df.select(*names).mapInArrow(run, schema)


def by_batch(df: DataFrame, names: list[str], fn: Callable[..., Iterable], schema: str) -> DataFrame:
    """The same with fn over Python lists of values."""
    return by_arrow(df, names, lambda *cols: fn(*(c.to_pylist() for c in cols)), schema)


def lists(rows: list, kind: pa.DataType = pa.int32()) -> pa.ListArray:
    """Arrays of numbers as one column; a None is a null."""
    sizes = np.array([0] + [0 if r is None else len(r) for r in rows], np.int64).cumsum().astype(np.int32)
    full = [r for r in rows if r is not None and len(r)]
    values = pa.array(np.concatenate(full).astype(kind.to_pandas_dtype(), copy=False) if full else [], kind)
    mask = pa.array([r is None for r in rows], pa.bool_()) if len(full) < len(rows) else None
    return pa.ListArray.from_arrays(pa.array(sizes), values, mask=mask)


def unlisted(column: pa.ListArray) -> list:
    """The same column's arrays as views in numpy; None for a null."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    full = column.is_valid().to_pylist()
    return [values[i:j] if k else None for i, j, k in zip(at[:-1].tolist(), at[1:].tolist(), full, strict=True)]


def through(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with the columns that fn makes of each batch's, under the same names and types, whatever these names are."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays(fn(b), names=names)

    bounded(df.sparkSession)
    # Spark looks the columns up by name to send them, which fails for names with dots.
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, df.schema)


def bounded(spark: SparkSession) -> None:
    """Bounds the bytes of the Arrow batches that this session sends to Python, unless they are bounded closer already.

    The setting stays for the session, as what is returned runs later.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, "2147483647")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _bytes(size: str) -> int:
    number, unit = size.rstrip("bBkKmMgG"), size.lstrip("0123456789").lower()
    return int(number) << {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}[unit]


def sliced(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.full(b.num_rows, 16 * b.num_columns, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_list(c.type):
                width = 4 if pa.types.is_list(c.type) else 1
                sizes += np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)) * width if len(c) else 0
        for i, j in slices(sizes.tolist(), most):
            yield b.slice(i, j - i)


def released() -> None:
    """Gives memory that is free in this process back to the system: what a training has used would else stay with the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # The C library's heap, where there is such a function.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about `most` (a larger item stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
