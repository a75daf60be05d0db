"""Vector similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when a vector is null or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def term_cosine(a: Column, b: Column) -> Column:
    """Cosine of two token arrays as 0/1 term vectors; 0 when one side is empty.

    It stands in for a sentence encoder, whose vectors would be an input column for ``cosine``.
    """
    left, right = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(a, b)).cast("double")
    sizes = F.size(left).cast("double") * F.size(right).cast("double")
    return F.coalesce(F.try_divide(shared, F.sqrt(sizes)), F.lit(0.0))
