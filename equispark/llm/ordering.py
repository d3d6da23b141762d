"""Ranges of doc_id that part a table evenly, known before any row is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_bounds(rows: DataFrame, ranges: int, key: str = "doc_id") -> list[int]:
    """Increasing upper bounds of all ranges but the last; at most `ranges - 1` numbers.

    Reads the key column only. An empty table has no bounds.
    """
    shares = [i / ranges for i in range(1, ranges)]
    if not shares:
        return []
    found = rows.agg(F.percentile_approx(key, shares, max(10_000, 20 * ranges)).alias("b")).first().b
    return sorted(set(found or []))


def range_number(key: Column, bounds: list[int]) -> Column:
    """The range of a key, 0 first; null keys stand in range 0.

    Equal keys share a range. The bounds form a sorted array literal, searched
    by width_bucket-like counting only over the few bounds of this table.
    """
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(b).cast("long") for b in bounds])
    place = F.array_size(F.filter(steps, lambda b: b < key))
    return F.coalesce(place, F.lit(0))
