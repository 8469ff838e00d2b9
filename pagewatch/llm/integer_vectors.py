"""Vectors as exact integers, for the operators that compare them without rounding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def integer_vector(vector: Column, scale: int, limit: int, dim: int | None = None) -> Column:
    """floor(scale * x) of each component x as double.

    Null for vectors that are null, hold null or non-finite components, are empty or have not ``dim`` components.
    A component of ``limit`` or more would overflow what is computed with it and raises.
    """
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    fine &= F.size(v) > 0 if dim is None else F.size(v) == dim
    too_large = F.raise_error(F.lit(f"vector component times {scale} is not under {limit}")).cast("int")
    whole = lambda x: F.when(F.abs(x * scale) < limit, F.floor(x * scale).cast("int")).otherwise(too_large)
    return F.when(fine, F.transform(v, whole))


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int, limit: int, dim: int | None = None) -> DataFrame:
    """(id, x) of the vectors that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                          integer_vector(F.col(f"`{vector_col}`"), scale, limit, dim).alias("x"))
    return rows.filter("x IS NOT NULL")


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
