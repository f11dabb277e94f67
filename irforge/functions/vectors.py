"""Vector functions on ARRAY<DOUBLE> columns (F1, F2, P16) — JVM-side higher-order functions.

Only for one pair per row (doc vs its centroid, query vs its positive); bulk pairwise products
go through the blocked kernels in ``irforge.operators.similarity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b) -> Column:
    """a.b / (|a| |b|); 0 if either is a zero vector (or empty)."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def sq_l2(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def l2(a, b) -> Column:
    """Euclidean distance."""
    return F.sqrt(sq_l2(a, b))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def with_unit(df: DataFrame, vec: str, out: str = "unit", eps: float = 1e-12) -> DataFrame:
    """X / max(|x|, eps).  The norm is a separate column so it is computed once per row."""
    tmp = f"__norm_{out}"
    return (df.withColumn(tmp, F.greatest(norm(vec), F.lit(eps)))
              .withColumn(out, F.transform(F.col(vec), lambda x: x / F.col(tmp)))
              .drop(tmp))
