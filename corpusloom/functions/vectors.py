"""Column functions over vectors (array<float>), computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine cut to [0, 1]; 0 for an empty or zero vector; null if either is null or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(n == 0, 0.0).when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / n)))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda s, x: s + x)


def distance_similarity(d: Column) -> Column:
    return 1 - d / 2
