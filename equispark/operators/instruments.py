"""Instrument flags, market filters, date filters and symbol lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.functions.dates import period_bounds

# Instrument types and market presets.
EQUITY_TYPES = ("EQUITY", "COMMON_STOCK", "COMMONSTOCK", "STOCK")
FUND_TYPES = ("MUTUALFUND", "FUND")
CRYPTO_TYPES = ("CRYPTOCURRENCY", "CRYPTO")
US_COUNTRIES = ("United States", "United States of America", "USA", "US")
US_MARKETS = ("us_market", "us")
EU_COUNTRIES = (
    "United Kingdom",
    "Germany",
    "France",
    "Netherlands",
    "Spain",
    "Italy",
    "Ireland",
    "Belgium",
    "Austria",
    "Sweden",
    "Denmark",
    "Finland",
    "Norway",
)
EU_CURRENCIES = ("EUR", "GBP", "SEK", "DKK", "NOK", "CHF")


@dataclass(frozen=True)
class Market:
    """Allowed sets of a market; None leaves a dimension open."""

    countries: tuple[str, ...] | None = None
    currencies: tuple[str, ...] | None = None
    exchanges: tuple[str, ...] | None = None
    no_etfs: bool = True
    no_funds: bool = True
    no_crypto: bool = True


GLOBAL = Market()
US_ONLY = Market(countries=US_COUNTRIES, currencies=("USD",))
EU_ONLY = Market(countries=EU_COUNTRIES, currencies=EU_CURRENCIES)


def market_from_config(config: Mapping) -> Market:
    """The market a configuration names; unknown modes are global, empty lists open."""
    mode = config.get("mode", "global")
    if mode == "custom":
        lists = config.get("custom", {})
        allowed = {
            field: tuple(lists.get(f"allowed_{field}") or ()) or None for field in ("countries", "currencies", "exchanges")
        }
        return Market(
            **allowed,
            no_etfs=config.get("exclude_etfs", True),
            no_funds=config.get("exclude_mutualfunds", True),
            no_crypto=config.get("exclude_crypto", True),
        )
    return {"us_only": US_ONLY, "eu_only": EU_ONLY}.get(mode, GLOBAL)


def _text(frame: DataFrame, column: str) -> Column:
    """Trimmed text of a column; '' where it is NULL or the table lacks it."""
    if column.lower() not in {c.lower() for c in frame.columns}:
        return F.lit("")
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))


def is_etf(frame: DataFrame, equity_types: Sequence[str] = EQUITY_TYPES) -> Column:
    """ETF by type, by a type outside the allowed set (blank included), by flag or by name."""
    kind = F.upper(_text(frame, "quoteType"))
    flagged = F.lit(False)
    for flag in ("isETF", "fundFamily"):
        flagged = flagged | (F.lower(_text(frame, flag)) == "true")
    named = F.concat(F.lit(" "), F.upper(_text(frame, "longName")), F.lit(" ")).contains(" ETF")
    return (kind == "ETF") | ~kind.isin(*equity_types) | flagged | named


def is_fund(frame: DataFrame) -> Column:
    return F.upper(_text(frame, "quoteType")).isin(*FUND_TYPES)


def is_crypto(frame: DataFrame) -> Column:
    return F.upper(_text(frame, "quoteType")).isin(*CRYPTO_TYPES)


def reporting_currency(frame: DataFrame) -> Column:
    """Upper-cased financial currency, else trading currency.

    Only a missing or empty financial currency falls through; a blank one stays.
    """
    present = {c.lower() for c in frame.columns}
    held = [F.nullif(F.col(c), F.lit("")) for c in ("financialCurrency", "currency") if c.lower() in present]
    return F.upper(F.trim(F.coalesce(*held, F.lit(""))))


def reject_reason(frame: DataFrame, market: Market) -> Column:
    """The first rule an instrument fails, NULL when it passes all."""
    rules: list[tuple[str, Column]] = []
    if market.no_etfs:
        rules.append(("etf", is_etf(frame)))
    if market.no_funds:
        rules.append(("fund", is_fund(frame)))
    if market.no_crypto:
        rules.append(("crypto", is_crypto(frame)))
    if market.countries is not None:
        allowed = [c.strip().lower() for c in market.countries]
        rules.append(("country", ~F.lower(_text(frame, "country")).isin(*allowed)))
    if market.currencies is not None:
        rules.append(("currency", ~reporting_currency(frame).isin(*market.currencies)))
    if market.exchanges is not None:
        allowed = [e.strip().upper() for e in market.exchanges]
        rules.append(("exchange", ~F.upper(_text(frame, "exchange")).isin(*allowed)))
    reason = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        reason = F.when(failed, name).otherwise(reason)
    return reason


def flag_etf(frame: DataFrame) -> DataFrame:
    return frame.withColumn("is_etf", is_etf(frame))


def flag_mutual_fund(frame: DataFrame) -> DataFrame:
    return frame.withColumn("is_fund", is_fund(frame))


def flag_crypto(frame: DataFrame) -> DataFrame:
    return frame.withColumn("is_crypto", is_crypto(frame))


def classify_instruments(frame: DataFrame, market: Market = GLOBAL) -> DataFrame:
    """Every instrument with its reject reason."""
    return frame.withColumn("reject_reason", reject_reason(frame, market))


def instrument_filter(frame: DataFrame, market: Market = GLOBAL) -> DataFrame:
    """Only the instruments that pass."""
    return classify_instruments(frame, market).filter("reject_reason IS NULL").drop("reject_reason")


def us_listing_filter(frame: DataFrame, countries: Sequence[str] = US_COUNTRIES) -> DataFrame:
    named = F.lower(_text(frame, "country")).isin(*[c.lower() for c in countries])
    return frame.filter(named | F.lower(_text(frame, "market")).isin(*US_MARKETS))


def usd_financials_filter(frame: DataFrame) -> DataFrame:
    return frame.filter(reporting_currency(frame) == "USD")


# -- dates -------------------------------------------------------------------


def period_filter(frame: DataFrame, period: str, as_of: date, column: str = "date", **parts) -> DataFrame:
    """Rows inside a named period. Bounds are literals, so they reach the scan."""
    start, end = period_bounds(period, as_of, **parts)
    if start == end:
        return frame.filter(F.col(column) == F.lit(start))
    return frame.filter(F.col(column).between(F.lit(start), F.lit(end)))


def in_periods(frame: DataFrame, periods: Mapping[str, tuple[date, date]], column: str = "date") -> DataFrame:
    """Each row once for every period it lies in, with `period`, `period_start` and `period_end`.

    A period table of literals: the span of all of them prunes the scan, and a
    row is matched to its periods in place.
    """
    table = F.array(
        *[
            F.struct(F.lit(name).alias("period"), F.lit(start).alias("period_start"), F.lit(end).alias("period_end"))
            for name, (start, end) in periods.items()
        ]
    )
    first, last = min(p[0] for p in periods.values()), max(p[1] for p in periods.values())
    day = F.col(column)
    spanned = frame.filter(day.between(F.lit(first), F.lit(last)))
    own = F.filter(table, lambda p: day.between(p["period_start"], p["period_end"]))
    return spanned.select("*", F.inline(own))


def since_events(frame: DataFrame, events: Mapping[str, DataFrame]) -> DataFrame:
    """Each row once for every event of its company that it follows, with `event` and `event_date`; one scan for all events."""
    tables = [table.select("ticker", F.lit(name).alias("event"), "event_date") for name, table in events.items()]
    every = reduce(DataFrame.union, tables)
    return frame.join(every, "ticker").filter("date >= event_date")


def date_range(frame: DataFrame, ticker: str, start: date, end: date) -> DataFrame:
    return frame.filter((F.col("ticker") == ticker) & F.col("date").between(F.lit(start), F.lit(end)))


def first_price_dates(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.min("date").alias("event_date"))


def last_split_dates(splits: DataFrame) -> DataFrame:
    return splits.groupBy("ticker").agg(F.max("date").alias("event_date"))


def last_report_dates(reports: DataFrame, as_of: date) -> DataFrame:
    past = reports.filter(F.col("report_date") <= F.lit(as_of))
    return past.groupBy("ticker").agg(F.max("report_date").alias("event_date"))


def since_event(frame: DataFrame, events: DataFrame) -> DataFrame:
    """Rows on or after each company's own event date; companies without one drop out."""
    return frame.join(events, "ticker").filter("date >= event_date")


# -- symbols and names -------------------------------------------------------


def prefix_search(metadata: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    hits = metadata.filter(F.col("ticker").startswith(prefix.strip().upper())).select("ticker").distinct()
    return hits.orderBy("ticker").limit(limit)


def name_search(metadata: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Companies whose ticker starts with the text or whose name contains it."""
    wanted = text.strip().upper()
    hits = metadata.filter(F.col("ticker").startswith(wanted) | F.upper("longName").contains(wanted))

    def shown(c):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))

    return (
        hits.select("ticker", shown("longName").alias("name"), shown("sector").alias("sector"))
        .distinct()
        .withColumn("display", F.concat_ws(" - ", "ticker", "name"))
        .orderBy("ticker", "name", "sector")
        .limit(limit)
    )


def symbol_exists(symbols: DataFrame, metadata: DataFrame) -> DataFrame:
    """Whether each given symbol, upper-cased, is a known company."""
    known = metadata.select(F.upper("ticker").alias("lookup")).distinct().withColumn("known", F.lit(True))
    asked = symbols.select("symbol", F.upper(F.trim("symbol")).alias("lookup"))
    return asked.join(known, "lookup", "left").select("symbol", F.coalesce("known", F.lit(False)).alias("is_known"))


def distinct_symbols(frame: DataFrame) -> DataFrame:
    return frame.select("ticker").filter("ticker IS NOT NULL").distinct().orderBy("ticker")


def in_symbols(frame: DataFrame, symbols: Iterable[str]) -> DataFrame:
    return frame.filter(F.col("ticker").isin(*symbols))
