"""Vector expressions over array<double> columns, evaluated by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, added from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector.

    The length is a lambda's variable: written into the inner lambda as an expression it is
    worked out again for each component.
    """
    return F.get(F.transform(F.array(norm(a)), lambda length: F.when(length > 0, F.transform(a, lambda x: x / length))), F.lit(0))
