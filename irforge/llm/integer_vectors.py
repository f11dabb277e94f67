"""Vectors as exact integers, and exact aggregates over them, for the clustering and compression operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def largest(dims: int) -> int:
    """Components up to this size have squared distances that fit a long."""
    return math.isqrt((2**63 - 1) // (4 * max(dims, 1)))


def complete(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, fine)


def integers(vector: str, scale: int, dims: int) -> Column:
    """floor(scale * component) of every component; one beyond ``largest(dims)`` is an error, never a wrong distance."""
    most = largest(dims)

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) <= most, F.floor(y)).otherwise(F.raise_error(F.lit(f"{vector}: a component times {scale} is beyond {most}")).cast("long"))

    return F.transform(vector, whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def rows_of(m: np.ndarray) -> pa.Array:
    """The matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def summed(partial: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, n, s0, s1 ..: the total of partial(keys, n, s array) by key.  The sums can't overflow."""
    add = lambda c: F.sum(c.cast("decimal(38,0)"))
    return partial.groupBy(*keys).agg(add(F.col("n")).alias("n"), *[add(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
