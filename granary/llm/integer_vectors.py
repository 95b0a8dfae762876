"""Vectors of integers made from vectors of floats, and exact arithmetic on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Whether x is a vector without null or non-finite components (the empty vector is one)."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def integers(x: Column, scale: int) -> Column:
    """floor(scale * component) in doubles; what 64 bits cannot hold counts as the nearest integer that they can."""
    return F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)).cast("long"))


def integer_vectors(rows: DataFrame, scale: int, *columns: Column) -> DataFrame:
    """columns and x (array<long>) of the rows whose embedding is finite."""
    return rows.filter(finite(F.col("embedding"))).select(*columns, integers(F.col("embedding"), scale).alias("x"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """One row for each entry of a column of arrays of dims numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def clipped(x: np.ndarray) -> np.ndarray:
    """As 64-bit integers; larger ones count as the largest."""
    if x.dtype != object:
        return x.astype(np.int64)
    info = np.iinfo(np.int64)
    return np.array([min(max(int(v), info.min), info.max) for v in x.ravel()], np.int64).reshape(x.shape)
