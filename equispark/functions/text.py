"""Text expressions: tokens, redaction and report formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores, in any script."""
    return F.split(text, WORD_BREAK)


def capital_words(text: Column, shortest: int, longest: int) -> Column:
    """Distinct words made of plain capitals with a length in range."""
    return F.array_distinct(F.filter(words(text), lambda w: w.rlike(f"^[A-Z]{{{shortest},{longest}}}$")))


def quoted_symbols(sql: Column) -> Column:
    """Distinct symbols compared with `ticker` by = or inside the first IN list."""
    equal = F.regexp_extract_all(sql, F.lit(r"(?i)ticker\s*=\s*['\"]([A-Z]+)['\"]"), 1)
    first_list = F.regexp_extract(sql, r"(?i)ticker\s+IN\s*\(([^)]+)\)", 1)
    listed = F.regexp_extract_all(first_list, F.lit(r"(?i)['\"]([A-Z]+)['\"]"), 1)
    return F.array_distinct(F.concat(equal, listed))


def redact_connection(text: Column) -> Column:
    """Replaces the password of scheme://user:password@host by ***."""
    return F.regexp_replace(text, r"([a-z][a-z0-9+.\-]*://[^:/@\s]+:)([^@\s]+)(@)", "$1***$3")


def mask_tail(text: Column, shown: int = 4) -> Column:
    """Stars for all but the last characters; *** when nothing may be left to show."""
    short = text.isNull() | (F.length(text) <= shown)
    return F.when(short, "***").otherwise(
        F.concat(F.repeat(F.lit("*"), F.length(text) - shown), F.right(text, F.lit(shown)))
    )


def similarity(left: Column, right: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    return 1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right), F.lit(1))


# Name patterns that choose a report format, tried in this order.
MONEY_NAMES = (
    "revenue",
    "income",
    "cash",
    "assets",
    "liabilities",
    "equity",
    "flow",
    "profit",
    "ebitda",
    "marketcap",
)
RATIO_NAMES = ("margin", "ratio", "roe", "roa", "growth", "return")
PRICE_NAMES = ("price", "open", "high", "low", "close", "adj_close")
VOLUME_NAMES = ("volume", "shares", "count")


def _fixed(value: Column) -> Column:
    """Two decimals, rounded from the exact binary value; printf would round its short form."""
    return F.translate(F.format_number(value, 2), ",", "")


def money_text(value: Column) -> Column:
    """Dollars with a T, B, M or K suffix by size."""
    size = F.abs(value)
    out = F.concat(F.lit("$"), _fixed(value))
    for suffix, unit in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)):
        out = F.when(size >= unit, F.concat(F.lit("$"), _fixed(value / unit), F.lit(suffix))).otherwise(out)
    return out


def report_text(name: str, value: Column) -> Column:
    """A number as report text, in the format its column name calls for."""
    number, lowered = value.cast("double"), name.lower()
    if any(p in lowered for p in MONEY_NAMES):
        text = money_text(number)
    elif any(p in lowered for p in RATIO_NAMES):
        text = F.concat(_fixed(number * 100), F.lit("%"))
    elif any(p in lowered for p in PRICE_NAMES):
        text = F.concat(F.lit("$"), _fixed(number))
    elif any(p in lowered for p in VOLUME_NAMES):
        text = F.format_number(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)), 0)
    else:
        text = _fixed(number)
    return F.when(value.isNull() | F.isnan(number), "N/A").otherwise(text)
