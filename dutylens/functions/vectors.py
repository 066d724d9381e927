"""Similarities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sparse_dot(a: Column, b: Column) -> Column:
    """Of two (idx, val, sq) vectors, as a whole number."""
    other = F.map_from_arrays(b["idx"], b["val"])
    return F.aggregate(F.zip_with(a["idx"], a["val"], lambda i, v: F.coalesce(F.try_element_at(other, i), F.lit(0)) * v), F.lit(0).cast("long"), lambda acc, x: acc + x)


def sparse_cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; within -1 and 1."""
    length = F.sqrt(a["sq"].cast("double") * b["sq"].cast("double"))
    return F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sparse_dot(a, b).cast("double") / length)))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays: 0 if one is null, empty or zero; an error if their sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    none = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    return (
        F.when(none, F.lit(0.0))
        .when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension")).cast("double"))
        .when(length == 0, F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / length)))
    )
