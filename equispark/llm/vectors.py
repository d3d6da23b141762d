"""Embedding rows that can be calculated with, as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scaled entries are held within this bound, so that they are longs.
REACH = 2.0**52


def gridded(rows: DataFrame, scale: int, shift: int = 0, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is whole, with a column `x`: floor(scale * entry) + shift as longs.

    Vectors that are null, empty, or hold null or non-finite entries go, and so
    do those of another length than most have (of equally frequent lengths the
    longest counts). Entries beyond 2^52 after scaling are held there. `vector`
    itself is dropped, other columns stay.
    """
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.least(c * F.lit(float(scale)), F.lit(REACH)), F.lit(-REACH))
    whole = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)
    sizes = whole.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("rows"))
    most = sizes.agg(F.max(F.struct("rows", "size")).alias("most")).first().most
    whole = whole.filter(F.size(vector) == (most.size if most else 0))
    return whole.withColumn("x", F.transform(entries, lambda c: F.floor(held(c)).cast("long") + F.lit(shift).cast("long"))).drop(
        *[vector] if vector != "x" else []
    )


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of an Arrow column as rows of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
