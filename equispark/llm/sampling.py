"""Bounded samples by the smallest hashes, without gathering candidates of every partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(draw: Column) -> Column:
    """The logarithm of a 64-bit hash in steps of 1/1024: at most 65,537 values, finest where hashes are small."""
    return F.floor(F.log2(draw.cast("double") + F.lit(2.0**63) + F.lit(1.0)) * 1024).cast("int")


def smallest(rows: DataFrame, n: int, draw: str = "draw") -> DataFrame:
    """Those of the rows that have the `n` smallest different hashes, one row of each hash.

    The different hashes are counted by their place, which is one shuffle of
    hashes and at most 65,537 counts. The place that the n-th falls into
    bounds the rows that are looked at again, to about n and a thousandth, so
    neither the number of partitions nor that of copies reaches one task. All
    rows of an empty table, and of one with fewer hashes, are taken.
    """
    counts = rows.select(draw).distinct().groupBy(place(F.col(draw)).alias("place")).count().collect()
    last, held = None, 0
    for row in sorted(counts):
        last, held = row["place"], held + row["count"]
        if held >= n:
            break
    near = rows.filter(place(F.col(draw)) <= F.lit(last).cast("int"))
    return near.dropDuplicates([draw]).orderBy(draw).limit(n)
