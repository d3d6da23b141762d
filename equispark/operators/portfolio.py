"""Portfolio reports: holdings joined to one-row-per-company snapshots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.functions.numeric import pos_div
from equispark.operators.fundamentals import latest_price, newest
from equispark.operators.fx import fx_rate_exact


def _valued(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    return holdings.join(latest_price(prices), "ticker").withColumn("value", F.col("shares") * F.col("price"))


def portfolio_value(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    return _valued(holdings, prices).groupBy("portfolio_name").agg(
        F.sum("value").alias("total_value"), F.count("*").alias("holdings")
    )


def portfolio_value_in(
    holdings: DataFrame, prices: DataFrame, metadata: DataFrame, rates: DataFrame, base: str = "USD"
) -> DataFrame:
    """Portfolio values in base currency; holdings without a rate are counted apart."""
    local = _valued(holdings, prices).join(metadata.select("ticker", "currency"), "ticker")
    rated = fx_rate_exact(local, rates, F.col("currency"), F.lit(base), F.col("price_date"))
    return rated.groupBy("portfolio_name").agg(
        F.sum(F.col("value") * F.col("fx_rate")).alias("base_value"),
        F.count(F.when(F.col("fx_rate").isNull(), 1)).alias("unrated_holdings"),
    )


def portfolio_unrealized(holdings: DataFrame, prices: DataFrame) -> DataFrame:
    cost = F.col("purchase_price")
    return _valued(holdings, prices).select(
        "portfolio_name",
        "ticker",
        "shares",
        "purchase_price",
        "price",
        (F.col("shares") * (F.col("price") - cost)).alias("gain"),
        (pos_div(F.col("price") - cost, cost) * 100).alias("gain_pct"),
    )


def portfolio_allocation(holdings: DataFrame, prices: DataFrame, metadata: DataFrame, by: str = "sector") -> DataFrame:
    """Share of each sector (or other company column) in its portfolio's value.

    The window runs over the summed parts: one row per sector and portfolio.
    """
    placed = _valued(holdings, prices).join(metadata.select("ticker", by), "ticker")
    parts = placed.groupBy("portfolio_name", by).agg(F.sum("value").alias("part_value"))
    whole = F.sum("part_value").over(W.partitionBy("portfolio_name"))
    return parts.withColumn("whole", whole).withColumn("share", pos_div("part_value", "whole")).drop("whole")


def _since(prices: DataFrame, start: Column, as_of: date) -> DataFrame:
    window = prices.filter(F.col("date").between(start, F.lit(as_of)))
    return window.groupBy("ticker").agg(
        F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close")
    )


def portfolio_ytd(holdings: DataFrame, prices: DataFrame, *, as_of: date) -> DataFrame:
    ends = _since(prices, F.lit(date(as_of.year, 1, 1)), as_of)
    change = pos_div(F.col("last_close") - F.col("first_close"), "first_close") * 100
    return holdings.join(ends, "ticker").select("portfolio_name", "ticker", change.alias("ytd_return_pct"))


def portfolio_vs_benchmark(holdings: DataFrame, prices: DataFrame, benchmark: DataFrame, *, as_of: date) -> DataFrame:
    """Year-to-date return of each portfolio against a benchmark series (date, level).

    The benchmark is one row per day; its two ends come in as scalars.
    """
    start = F.lit(date(as_of.year, 1, 1))
    ends = _since(prices, start, as_of)
    level = benchmark.filter(F.col("date").between(start, F.lit(as_of))).agg(
        (F.max_by("level", "date") / F.min_by("level", "date") - 1).alias("r")
    )
    worth = holdings.join(ends, "ticker").groupBy("portfolio_name").agg(
        F.sum(F.col("shares") * F.col("first_close")).alias("start_value"),
        F.sum(F.col("shares") * F.col("last_close")).alias("end_value"),
    )
    own = pos_div(F.col("end_value") - F.col("start_value"), "start_value") * 100
    return worth.withColumn("return_pct", own).withColumn("benchmark_pct", level.scalar() * 100).select(
        "portfolio_name", "return_pct", "benchmark_pct", (F.col("return_pct") - F.col("benchmark_pct")).alias("excess_pct")
    )


def market_index(prices: DataFrame) -> DataFrame:
    """A price-weighted index: the volume-weighted close of every day."""
    traded = F.sum(F.col("close") * F.col("volume"))
    return prices.groupBy("date").agg((traded / F.nullif(F.sum("volume"), F.lit(0))).alias("level"))


def portfolio_dividends(holdings: DataFrame, dividends: DataFrame, *, as_of: date) -> DataFrame:
    """Dividend income this year: yearly amounts per company first, then the holdings."""
    year = dividends.filter(F.col("date").between(F.lit(date(as_of.year, 1, 1)), F.lit(as_of)))
    paid = year.groupBy("ticker").agg(F.sum("amount").alias("per_share"))
    income = F.sum(F.col("shares") * F.col("per_share"))
    return holdings.join(paid, "ticker").groupBy("portfolio_name").agg(income.alias("dividend_income"))


def portfolio_weighted_pe(holdings: DataFrame, prices: DataFrame, valuation: DataFrame) -> DataFrame:
    """Value-weighted mean P/E over the holdings that have one."""
    rated = _valued(holdings, prices).join(valuation.filter("pe_ratio IS NOT NULL").select("ticker", "pe_ratio"), "ticker")
    return rated.groupBy("portfolio_name").agg(
        (F.sum(F.col("value") * F.col("pe_ratio")) / F.nullif(F.sum("value"), F.lit(0.0))).alias("weighted_pe")
    )


def portfolio_income_yoy(holdings: DataFrame, growth: DataFrame) -> DataFrame:
    """Change in net income of each holding in its newest report."""
    change = growth.withColumn("income_change", F.col("netIncome") - F.col("prior_income"))
    last = newest(change, ["netIncome", "prior_income", "income_change", "income_growth_yoy"], "fiscal_date")
    return holdings.select("portfolio_name", "ticker").join(last, "ticker")


def portfolio_fx_exposure(holdings: DataFrame, prices: DataFrame, metadata: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """Value by local currency, in that currency and in base."""
    local = _valued(holdings, prices).join(metadata.select("ticker", "currency"), "ticker")
    rated = fx_rate_exact(local, rates, F.col("currency"), F.lit(base), F.col("price_date"))
    return rated.groupBy("portfolio_name", "currency").agg(
        F.sum("value").alias("local_value"), F.sum(F.col("value") * F.col("fx_rate")).alias("base_value")
    )


def portfolio_upcoming_earnings(holdings: DataFrame, calendar: DataFrame, *, as_of: date) -> DataFrame:
    upcoming = calendar.filter(F.col("earnings_date") >= F.lit(as_of))
    return holdings.select("portfolio_name", "ticker").join(upcoming, "ticker")
