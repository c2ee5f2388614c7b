"""Vector column expressions (ARRAY<DOUBLE>), all JVM-side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return _c(v).cast(T.ArrayType(T.DoubleType()))


def dot(a, b) -> Column:
    """Σ a_i·b_i (arrays of equal length)."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(v) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def per_element(v, scalar) -> Column:
    """The per-row scalar repeated to the array's length.  A lambda that
    referenced ``scalar`` directly would re-evaluate it for every element
    (O(d^2) per row); zipping with the repeated value evaluates it once."""
    return F.array_repeat(scalar, F.size(v))


def unit_norm(v) -> Column:
    """V / max(||v||, 1e-12)."""
    v = as_double(v)
    n = F.greatest(F.sqrt(sq_norm(v)), F.lit(1e-12))
    return F.zip_with(v, per_element(v, n), lambda x, d: x / d)


def remove_projection(h, v, alpha) -> Column:
    """H - alpha·(h·v)·v; alpha 0 leaves h unchanged."""
    h, v = as_double(h), as_double(v)
    a = _c(alpha) if not isinstance(alpha, (int, float)) else F.lit(float(alpha))
    sv = F.zip_with(v, per_element(v, dot(h, v) * a), lambda y, s: s * y)
    return F.zip_with(h, sv, lambda x, y: x - y)


def ends_with_tokens(ids, suffix) -> Column:
    """The id array ends with the (non-empty) suffix array."""
    ids, suffix = _c(ids), _c(suffix)
    n = F.size(suffix)
    return F.when((n == 0) | (n > F.size(ids)), F.lit(False)).otherwise(F.slice(ids, -n, n) == suffix)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def bf16_round(v: pa.Array) -> pa.Array:
    """Round float32 values to bfloat16 precision (nearest, ties to even).

    The rounding works on the 32-bit patterns of a whole Arrow batch, keeping
    the upper 16 bits after adding the rounding bias; NaN, null elements and
    null arrays stay.
    """
    inner = v.values.cast(pa.float32())
    flat = inner.fill_null(0).to_numpy(zero_copy_only=False)
    bits = flat.view(np.uint32).astype(np.uint64)
    up = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16) << 16
    rounded = np.where(np.isnan(flat), flat, up.astype(np.uint32).view(np.float32))
    values = pa.array(rounded, pa.float32(), mask=inner.is_null().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(v.offsets, values, mask=v.is_null() if v.null_count else None)
