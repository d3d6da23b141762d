"""Guarded division, stable rounding and exact money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A rounding boundary that short decimals never hit: sums of doubles differ in
# the last bit with the order of addition, and a tie must not depend on that.
TIE_GUARD = 0.50001


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pos_div(num: Column | str, den: Column | str) -> Column:
    """num / den where den is positive, else NULL."""
    num, den = as_col(num), as_col(den)
    return F.when(den > 0, num / den)


def nonzero_div(num: Column | str, den: Column | str) -> Column:
    """num / den with a zero denominator treated as missing; signs are kept."""
    den = as_col(den)
    return as_col(num) / F.nullif(den, F.lit(0.0))


def pct_change(now: Column | str, before: Column | str) -> Column:
    """Change in percent over a positive base."""
    now, before = as_col(now), as_col(before)
    return F.when(before > 0, (now - before) / before * 100)


def stable_round(value: Column | str, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(as_col(value) * scale + TIE_GUARD) / scale


def cents(value: Column | str) -> Column:
    """Whole cents as BIGINT, so that sums are exact and order-free."""
    return F.floor(as_col(value) * 100 + 0.5).cast("bigint")


def from_cents(value: Column | str) -> Column:
    return as_col(value).cast("double") / 100


def missing_to_null(value: Column | str) -> Column:
    """NaN and infinities count as missing."""
    value = as_col(value).cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, value)


def decimal4(value: Column | str) -> Column:
    """Four places, half to even."""
    return F.bround(as_col(value), 4).cast("decimal(38,4)")
