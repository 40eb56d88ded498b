"""Vector functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - inner product: the cosine distance of unit vectors."""
    return F.lit(1.0) - dot(a, b)


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(vector, vector))


def quantize(vector: Column) -> Column:
    """Eight-bit integers, the largest magnitude as 127; halves are rounded away from zero."""
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return F.transform(vector, lambda x: F.when(largest == 0, 0).otherwise(F.round(x.cast("double") * 127.0 / largest)).cast("tinyint"))


def dequantize(vector: Column) -> Column:
    """A unit vector from eight-bit integers."""
    return F.transform(vector, lambda x: x.cast("double") / norm(vector))
