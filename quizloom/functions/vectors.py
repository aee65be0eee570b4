"""Vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_normalise(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is.

    The length goes in as a second list, so that it is computed once and not per element.
    """
    length = F.array_repeat(F.sqrt(squared_norm(vector)), F.size(vector))
    return F.zip_with(vector, length, lambda x, n: F.when(n == 0, x).otherwise(x / n))
