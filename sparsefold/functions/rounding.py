"""Rounding of single-precision numbers to fewer mantissa bits, which makes them compress well."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_mantissa(values: np.ndarray, keep_bits: int) -> np.ndarray:
    """float32 values with keep_bits of 23 mantissa bits, rounded half to even; what isn't finite stays."""
    if not 0 < keep_bits <= 23:
        raise ValueError("a single-precision number keeps 1 to 23 mantissa bits")
    values = np.asarray(values, np.float32)
    drop = 23 - keep_bits
    if drop == 0:
        return values.copy()
    bits = values.view(np.uint32)
    half = np.uint32((1 << (drop - 1)) - 1) + ((bits >> np.uint32(drop)) & np.uint32(1))
    out = ((bits + half) & ~np.uint32((1 << drop) - 1)).view(np.float32)
    return np.where(np.isfinite(values), out, values)


def rounded(column: Column, keep_bits: int, keep_positive: bool = False) -> Column:
    """round_mantissa() of a FLOAT column. keep_positive: a stored value that rounds to 0 becomes the smallest subnormal."""

    @F.arrow_udf("float")
    def run(v: pa.Array) -> pa.Array:
        nulls = np.array(v.is_null())
        out = round_mantissa(v.fill_null(0).to_numpy(zero_copy_only=False), keep_bits)
        if keep_positive:
            out = np.where(out == 0, np.float32(1.4e-45), out)
        return pa.array(out, pa.float32(), mask=nulls)

    return run(column.cast("float"))
