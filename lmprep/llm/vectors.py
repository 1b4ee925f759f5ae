"""Integer vectors of an embeddings table, and their columns as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantized(vector: Column, scale: float = 256.0) -> Column:
    """Each component x as the long ``floor(scale * x)``, x as double; null for a vector that is null or holds null or non-finite ones."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.when(finite, F.transform(vector, lambda e: F.floor(e.cast("double") * scale)))


def longest(rows: DataFrame, vector: str) -> int:
    """Components of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors without nulls as rows of ``width`` integers; shorter ones are filled up with zeros."""
    lengths = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, int)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
