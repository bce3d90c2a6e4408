"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component finite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def normalised(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` long, ``vector`` array<double>, whatever else the table holds."""
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))
