"""FNV-1a over 64-bit numbers in columns, and the same in Python. Spark's long holds the bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The offset basis and prime of 64-bit FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_ALL, _HALF = (1 << 64) - 1, 0xFFFFFFFF


def signed(x: int) -> int:
    x &= _ALL
    return x - (1 << 64) if x >> 63 else x


def unsigned(x: int) -> int:
    return x & _ALL


@F.pandas_udf(LongType())
def _fnv1a(x: pd.Series) -> pd.Series:
    v, h = x.to_numpy(np.int64).view(np.uint64), np.full(len(x), OFFSET, np.uint64)
    for shift in range(0, 64, 8):
        h = (h ^ (v >> np.uint64(shift) & np.uint64(255))) * np.uint64(PRIME)
    return pd.Series(h.view(np.int64))


def fnv1a(x: Column) -> Column:
    """The hash of the 8 bytes of a long, lowest first; null for null.

    In numpy over Arrow batches: Spark has no multiplication modulo 2^64, and in halves a step refers to the one before
    three times, which the optimiser multiplies out over eight bytes.
    """
    return F.when(x.isNotNull(), _fnv1a(F.coalesce(x.cast("long"), F.lit(0).cast("long"))))


def fnv1a_int(x: int) -> int:
    h = OFFSET
    for b in (x & _ALL).to_bytes(8, "little"):
        h = (h ^ b) * PRIME & _ALL
    return h


def leading_zeros(x: Column) -> Column:
    return F.when(x == 0, 64).otherwise(64 - F.length(F.bin(x)))


def modulo(x: Column, width: int) -> Column:
    """x as an unsigned number modulo width."""
    if width & (width - 1) == 0:
        return x.bitwiseAND(F.lit(width - 1).cast("long"))
    high, low = F.shiftrightunsigned(x, 32) % width, x.bitwiseAND(F.lit(_HALF)) % width
    return (high * ((1 << 32) % width) + low) % width


def float_bits(x: Column) -> Column:
    """The 32 bits of a float as an int."""
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("int")


def bits_float(x: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("intBitsToFloat"), x.cast("int")).cast("float")
