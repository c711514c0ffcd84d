"""What the operators on embeddings share: which vectors take part, and their arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite numbers."""
    entries = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(column) > 0) & entries, F.lit(False))


def not_zero(column: str) -> Column:
    return F.exists(column, lambda c: c != 0)


def dimensions(vectors: DataFrame, column: str) -> int:
    """The most frequent length of a vector, of equally frequent ones the largest; 0 of an empty table."""
    lengths = vectors.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n"))
    most = lengths.agg(F.max(F.struct("n", "length")).alias("most")).first()["most"]
    return most["length"] if most else 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The rows of a list column whose lists all have this length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
