"""Vector columns on array<float>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def binary_quantise(v: Column, dims: int) -> Column:
    """Sign bits (x > 0) packed into ceil(dims / 64) longs, low bit first."""
    words = [
        F.aggregate(
            F.transform(F.slice(v, w * 64 + 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
            F.lit(0).cast("bigint"),
            lambda a, x: a.bitwiseOR(x),
        )
        for w in range((dims + 63) // 64)
    ]
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def vector_fault(v: Column, model: Column, expected_model: str, dims: int, tolerance: float = 0.05) -> Column:
    """Why a vector is refused, or null. Finite components are checked before the norm, which NaN would pass."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        F.when(~model.eqNullSafe(expected_model), "model")
        .when(v.isNull(), "missing")
        .when(F.size(v) != dims, "length")
        .when(~finite, "non-finite")
        .when(F.abs(norm(v) - 1) > tolerance, "norm")
    )
