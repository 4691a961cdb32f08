"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: Column, epsilon: float = EPSILON) -> Column:
    """Divided by its length, evaluated once, or by ``epsilon`` if that is greater."""
    scaled = F.transform(F.array(F.greatest(norm(a), F.lit(epsilon))), lambda n: F.transform(a, lambda x: x.cast("double") / n))
    return F.get(scaled, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPSILON)) * F.greatest(norm(b), F.lit(EPSILON)))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared elements by all elements of two sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
