"""Vector columns as exact integer matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector with at least one entry and none that is null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def usable_rows(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, vec) of the rows with a usable vector, entries as doubles."""
    entries = F.col(vector).cast("array<double>")
    return df.select(F.col(vec_id).alias("id"), entries.alias("vec")).filter(usable(F.col("vec")))


def floored(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * entry) of every vector, as int64 (rows, entries)."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of {lengths.min()} and of {lengths.max()} entries in one table")
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(scale))
    if len(values) and not np.abs(values).max() < 2.0**62:
        raise ValueError(f"an entry times {scale} lies beyond 64-bit integers")
    return values.astype(np.int64).reshape(len(lengths), -1)
