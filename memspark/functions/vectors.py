"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def issue(vector: Column, dimension: int) -> Column:
    """Why a stored vector can't be used, else null."""
    return (
        F.when(vector.isNull(), "missing")
        .when(F.size(vector) != dimension, "dimension")
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), "nonfinite")
        .when(F.forall(vector, lambda x: x == 0), "zero")
    )


def hash_place(token: Column, size: int = 64) -> Column:
    """The place of a token in a hash embedding: its SHA-256's first four bytes."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % size


def hash_sign(token: Column) -> Column:
    """1 or -1 by the hash's fifth byte."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)
