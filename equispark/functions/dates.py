"""Date parsing and named periods."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(value: Column | str) -> Column:
    """DATE of a date, timestamp or ISO-8601 text in UTC; NULL when blank or bad.

    Text without an offset means UTC, as does a trailing Z.
    """
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    size = F.length(text)
    zoned = text.endswith("Z") | F.substring(text, -6, 1).isin("+", "-")
    zone = F.when(size == 10, "T00:00:00Z").when(zoned, "").otherwise("Z")
    dashed = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return utc_date(F.try_to_timestamp(F.when(dashed & (size >= 10), F.concat(text, zone))))


def utc_instant(value: str) -> Column:
    """TIMESTAMP of a zone-free UTC time, whatever the session's zone; event time has to be one."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(value)))


def utc_date(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(instant.cast("bigint") / 86400).cast("int"))


def in_year(column: Column | str, year: int) -> Column:
    """A range that scans and partitions can be pruned by, unlike the year of each row."""
    day = F.col(column) if isinstance(column, str) else column
    return (day >= F.lit(date(year, 1, 1))) & (day < F.lit(date(year + 1, 1, 1)))


def _month_shift(day: date, months: int) -> date:
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, monthrange(year, month + 1)[1]))


def _quarter(year: int, quarter: int) -> tuple[date, date]:
    last_month = quarter * 3
    return date(year, last_month - 2, 1), date(year, last_month, monthrange(year, last_month)[1])


def period_bounds(
    period: str,
    as_of: date,
    *,
    n: int | None = None,
    year: int | None = None,
    quarter: int | None = None,
    day: date | None = None,
) -> tuple[date, date]:
    """Inclusive bounds of a named period, relative to `as_of`."""
    match period:
        case "ytd":
            return date(as_of.year, 1, 1), as_of
        case "last_n_years" | "past_n_years":
            return _month_shift(as_of, 12 * n), as_of
        case "last_n_months":
            return _month_shift(as_of, n), as_of
        case "last_n_days":
            return as_of - timedelta(days=n), as_of
        case "last_year":
            return _month_shift(as_of, 12), as_of
        case "last_month":
            return _month_shift(as_of, 1), as_of
        case "last_week":
            return as_of - timedelta(days=7), as_of
        case "this_year":
            return date(as_of.year, 1, 1), date(as_of.year, 12, 31)
        case "this_quarter":
            return _quarter(as_of.year, (as_of.month + 2) // 3)
        case "quarter":
            return _quarter(year, quarter)
        case "last_quarter":
            this_start, _ = _quarter(as_of.year, (as_of.month + 2) // 3)
            before = this_start - timedelta(days=1)
            return _quarter(before.year, before.month // 3)
        case "fiscal_year" | "year":
            return date(year, 1, 1), date(year, 12, 31)
        case "iso_date":
            return day, day
        case "before_covid":
            return date(1900, 1, 1), date(2020, 3, 1)
    raise ValueError(f"unknown period: {period}")
