"""Vector expressions (VEC-1, VEC-3, VEC-4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Put before questions, never before passages.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def inner_product(a: Column, b: Column) -> Column:
    """Summed in component order, in doubles; on unit vectors the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    norm = F.sqrt(inner_product(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def prefixed(question: Column, prefix: str = QUERY_PREFIX) -> Column:
    return F.concat(F.lit(prefix), question)
