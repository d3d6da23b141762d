"""Named, parameterised queries. Parameters are typed values, never SQL text."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.functions.dates import in_year
from equispark.operators.instruments import date_range

MAX_ROWS = 1000
DEFAULT_ROWS = 500


def capped_result(frame: DataFrame, limit: int | None = None, default: int = DEFAULT_ROWS, most: int = MAX_ROWS) -> DataFrame:
    """A report-sized result: the limit asked for or the default; more than the maximum is refused, not cut."""
    if limit is not None and limit > most:
        raise ValueError(f"at most {most} rows can be asked for, not {limit}")
    return frame.limit(default if limit is None else limit)


def _metric(frame: DataFrame, name: str) -> str:
    """A numeric column of the table, found without regard to case; anything else is refused."""
    for column, kind in frame.dtypes:
        if column.lower() == name.lower() and kind in ("double", "bigint", "int"):
            return column
    raise ValueError(f"not a metric of this table: {name}")


def top_revenue(tables: Any, year: int, limit: int = 10) -> DataFrame:
    rows = tables.of_year(year).annual.filter(in_year("date", year)).select("ticker", "date", "totalRevenue")
    return rows.orderBy(F.desc("totalRevenue"), "ticker").limit(limit)


def ticker_comparison(tables: Any, metric: str, tickers: Sequence[str], limit: int = 25) -> DataFrame:
    column = _metric(tables.annual, metric)
    rows = tables.annual.filter(F.col("ticker").isin(*tickers)).select("ticker", "date", column)
    return rows.orderBy(F.desc("date"), "ticker").limit(limit)


def revenue_trends(tables: Any, ticker: str, start_date: date, limit: int = 10) -> DataFrame:
    rows = tables.annual.filter((F.col("ticker") == ticker) & (F.col("date") >= F.lit(start_date)))
    return rows.select("ticker", "date", "totalRevenue").orderBy(F.desc("date")).limit(limit)


def profit_margins(tables: Any, tickers: Sequence[str], limit: int = 25) -> DataFrame:
    rows = tables.ratios.filter(F.col("ticker").isin(*tickers)).select("ticker", "date", "net_margin", "gross_margin")
    return rows.orderBy(F.desc("date"), "ticker").limit(limit)


def peer_group_comparison(tables: Any, metric: str, peer_group: str, year: int, limit: int = 25) -> DataFrame:
    reports = tables.of_year(year).annual
    column = _metric(reports, metric)
    members = tables.peers.filter(F.col("peer_group") == peer_group).select("ticker")
    rows = reports.filter(in_year("date", year)).join(members, "ticker")
    return rows.select("ticker", "date", column).orderBy(F.desc(column), "ticker", "date").limit(limit)


def top_roe(tables: Any, start_date: date, limit: int = 10) -> DataFrame:
    rows = tables.ratios.filter(F.col("date") >= F.lit(start_date)).select("ticker", "date", "roe")
    return rows.orderBy(F.desc_nulls_last("roe"), "ticker", "date").limit(limit)


def dividend_history(tables: Any, ticker: str, limit: int = 25) -> DataFrame:
    rows = tables.dividends.filter(F.col("ticker") == ticker).select("ticker", "date", "amount")
    return rows.orderBy(F.desc("date")).limit(limit)


def stock_price_range(tables: Any, ticker: str, start_date: date, end_date: date, limit: int = 100) -> DataFrame:
    rows = date_range(tables.prices, ticker, start_date, end_date).select("ticker", "date", "close", "volume")
    return rows.orderBy(F.desc("date")).limit(limit)


def growth_leaders(tables: Any, start_date: date, limit: int = 10) -> DataFrame:
    rows = tables.growth.filter((F.col("date") >= F.lit(start_date)) & F.col("revenue_growth_yoy").isNotNull())
    return (
        rows.select("ticker", "date", "revenue_growth_yoy")
        .orderBy(F.desc("revenue_growth_yoy"), "ticker", "date")
        .limit(limit)
    )


def sector_analysis(tables: Any, year: int, limit: int = 15) -> DataFrame:
    """Mean revenue, mean margin and company count per sector for a year."""
    own = tables.of_year(year)
    reports = own.annual.filter(in_year("date", year)).select("ticker", "date", "totalRevenue")
    margins = own.ratios.filter(in_year("date", year)).select("ticker", "date", "net_margin")
    placed = reports.join(tables.metadata.select("ticker", "sector"), "ticker").join(margins, ["ticker", "date"], "left")
    return (
        placed.groupBy("sector")
        .agg(
            F.avg("totalRevenue").alias("avg_revenue"),
            F.avg("net_margin").alias("avg_margin"),
            F.count("*").alias("company_count"),
        )
        .orderBy(F.desc("avg_revenue"), "sector")
        .limit(limit)
    )


TEMPLATES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        top_revenue,
        ticker_comparison,
        revenue_trends,
        profit_margins,
        peer_group_comparison,
        top_roe,
        dividend_history,
        stock_price_range,
        growth_leaders,
        sector_analysis,
    )
}


def run_template(tables: Any, name: str, params: Mapping[str, Any]) -> DataFrame:
    """A named query with its defaults under the given parameters."""
    if name not in TEMPLATES:
        raise KeyError(f"unknown template {name}; known: {', '.join(TEMPLATES)}")
    wanted = list(inspect.signature(TEMPLATES[name]).parameters.values())[1:]
    values = {p.name: p.default for p in wanted if p.default is not p.empty}
    values |= {k: v for k, v in params.items() if k in {p.name for p in wanted}}
    missing = [p.name for p in wanted if p.name not in values]
    if missing:
        raise ValueError(f"template {name} lacks parameters: {missing}")
    return TEMPLATES[name](tables, **values)
