"""Array-column vector expressions."""

from pyspark.sql import Column, functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns of one row; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def is_nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def has_dim(v: Column, dim: int) -> Column:
    return F.size(v) == dim


def weighted_sum(terms: list[tuple[Column, float]]) -> Column:
    """Sum of weighted vectors. The first term is required, a null later term
    adds nothing."""
    def scaled(vector: Column, weight: float) -> Column:
        return F.transform(as_doubles(vector), lambda x: x * weight)

    total = scaled(*terms[0])
    for vector, weight in terms[1:]:
        added = F.zip_with(total, scaled(vector, weight), lambda x, y: x + y)
        total = F.when(vector.isNull(), total).otherwise(added)
    return total
