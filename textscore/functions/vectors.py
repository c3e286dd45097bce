"""Small dense-vector expressions on ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def log_sum_exp(z: Column) -> Column:
    top = F.array_max(z)
    return top + F.log(array_sum(F.transform(z, lambda v: F.exp(v - top))))


def argmax(z: Column) -> Column:
    """0-based position of the greatest value; the lowest position on a tie."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def sum_vectors(v: Column, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise sum of vectors as an array.

    One plain sum per dimension keeps the map-side combine of hash
    aggregation; exploding the vector would multiply the rows by ``dim``.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return F.array(*[F.sum(F.get(v, F.lit(d)).cast("double") * w) for d in range(dim)])
