"""Vector scalars as column expressions, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Of vectors of unequal length the common part counts."""
    return F.aggregate(F.arrays_zip(a.alias("x"), b.alias("y")), F.lit(0.0), lambda s, p: s + F.coalesce(p["x"].cast("double") * p["y"].cast("double"), F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, truncate: bool = False) -> Column:
    """FN-01: 0 for null, empty or zero vectors; vectors of unequal length are an error unless they may be truncated."""
    n = F.least(F.size(a), F.size(b))
    if truncate:
        a, b = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0)))
    length = norm(a) * norm(b)
    value = F.when(length == 0, F.lit(0.0)).otherwise(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x) / length)
    if not truncate:
        value = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double")).otherwise(value)
    return F.when(a.isNull() | b.isNull() | (n <= 0), F.lit(0.0)).otherwise(value)
