"""Clean vectors and their distinct directions."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(table: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(id, v array<double>[, more]) of the rows with an id whose vector isn't null, empty or zero and has only finite components."""
    v = F.col("v")
    wide = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), *more)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return wide.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix; all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row cosine in double precision; the same two rows give the same value wherever they stand."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
