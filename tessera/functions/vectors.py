"""Expressions over vectors: dot product, norm, cosine. Accumulated in double precision inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0 for a zero vector or vectors of different lengths; null for a null one."""
    a, b = _col(a), _col(b)
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def cosine_to(a: str | Column, vector: Sequence[float]) -> Column:
    """Cosine to a constant, whose norm is taken once."""
    a, size = _col(a), sum(float(x) ** 2 for x in vector) ** 0.5
    n = norm(a)
    return F.when(a.isNull(), None).when((F.size(a) != len(vector)) | (n == 0) | F.lit(size == 0), 0.0).otherwise(dot(a, literal(vector)) / (n * F.lit(size)))
