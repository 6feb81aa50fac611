"""Dense vector arithmetic over array columns, always in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hybridq.functions.strings import let


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit-length copy; the zero vector stays zero."""
    unit = lambda x, n: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n)
    return let(l2_norm(v), lambda n: F.transform(v, lambda x: unit(x, n)))


def dot_product(a: Column, b: Column) -> Column:
    """Over the common length."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(
        F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors; 0 when either is zero."""
    return let(
        l2_norm(a) * l2_norm(b), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot_product(a, b) / n)
    )
