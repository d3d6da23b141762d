"""Screens and peer reports over the derived tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.functions.dates import in_year
from equispark.operators.fundamentals import newest
from equispark.operators.ordering import segmented_rank


def _sectors(metadata: DataFrame) -> DataFrame:
    return metadata.select("ticker", "sector")


# -- valuation -----------------------------------------------------------------


def screen_value(
    valuation: DataFrame, metadata: DataFrame, max_pe: float = 15, max_pb: float = 2, sector: str | None = None
) -> DataFrame:
    cheap = valuation.filter((F.col("pe_ratio") < max_pe) & (F.col("pb_ratio") < max_pb))
    placed = cheap.join(_sectors(metadata), "ticker")
    hits = placed if sector is None else placed.filter(F.col("sector") == sector)
    return hits.select("ticker", "sector", "pe_ratio", "pb_ratio")


def screen_peg(valuation: DataFrame, max_peg: float = 1) -> DataFrame:
    hits = valuation.filter((F.col("cap_class") == "Large Cap") & (F.col("peg_ratio") < max_peg))
    return hits.select("ticker", "peg_ratio", "market_cap")


def screen_multi_currency_value(
    fx_valuation: DataFrame,
    max_pe: float = 15,
    max_pb: float = 2,
    min_yield: float = 3,
    min_cap: float = 10e9,
    top: int = 20,
) -> DataFrame:
    hits = fx_valuation.filter(
        (F.col("pe_ratio") < max_pe)
        & (F.col("pb_ratio") < max_pb)
        & (F.col("dividend_yield_pct") > min_yield)
        & (F.col("market_cap_usd") > min_cap)
    )
    return (
        hits.select(
            "ticker",
            "local_currency",
            "pe_ratio",
            "pb_ratio",
            "dividend_yield_pct",
            (F.col("market_cap_usd") / 1e9).alias("market_cap_billions"),
        )
        .orderBy("pe_ratio", "ticker")
        .limit(top)
    )


def screen_high_yield_non_base(fx_valuation: DataFrame, min_yield: float = 4, base: str = "USD") -> DataFrame:
    hits = fx_valuation.filter((F.col("dividend_yield_pct") > min_yield) & (F.col("local_currency") != base))
    return hits.select("ticker", "local_currency", "dividend_yield_pct", "pe_ratio")


def screen_quality(
    annual: DataFrame, ratios: DataFrame, growth: DataFrame, min_roe: float = 0.2, max_debt: float = 0.4
) -> DataFrame:
    """Free cash flow, high ROE, growing revenue and low debt in the same report."""
    keys = ["ticker", "date"]
    cash = annual.filter("freeCashFlow > 0").select(*keys, "freeCashFlow")
    strong = ratios.filter((F.col("roe") > min_roe) & (F.col("debt_ratio") < max_debt)).select(*keys, "roe", "debt_ratio")
    growing = growth.filter("revenue_growth_yoy > 0").select(*keys, "revenue_growth_yoy")
    return cash.join(strong, keys).join(growing, keys)


def screen_low_debt(ratios: DataFrame, max_debt: float = 0.3) -> DataFrame:
    return ratios.filter(F.col("debt_ratio") < max_debt).select("ticker", "date", "debt_ratio")


def screen_funnel(
    metadata: DataFrame,
    valuation: DataFrame,
    recommendations: DataFrame,
    *,
    sector: str | None = None,
    max_pe: float | None = None,
    to_grade: str | None = None,
) -> DataFrame:
    """Companies that pass each stage asked for, as a chain of semi joins."""
    companies = metadata if sector is None else metadata.filter(F.col("sector") == sector)
    if max_pe is not None:
        companies = companies.join(valuation.filter(F.col("pe_ratio") < max_pe), "ticker", "left_semi")
    if to_grade is not None:
        graded = recommendations.filter(F.col("to_grade") == to_grade).select("ticker").distinct()
        companies = companies.join(graded, "ticker", "left_semi")
    return companies


# -- technical -----------------------------------------------------------------


def latest_bars(indicators: DataFrame, *columns: str) -> DataFrame:
    """The newest indicator row per company.

    The windows have already brought each company together, so this aggregate
    needs no further shuffle.
    """
    return newest(indicators, columns)


def screen_above_sma200(indicators: DataFrame) -> DataFrame:
    return latest_bars(indicators, "close", "sma_200").filter("close > sma_200")


def screen_sma50_cross(indicators: DataFrame, *, as_of: date, days: int = 30) -> DataFrame:
    """Upward crossings of the 50-row mean in the last days."""
    order = W.partitionBy("ticker").orderBy("date")
    above = F.col("close") > F.col("sma_50")
    crossed = indicators.select("ticker", "date", "close", "sma_50", above.alias("above")).withColumn(
        "was_above", F.lag("above").over(order)
    )
    recent = F.col("date") >= F.date_sub(F.lit(as_of), days)
    return crossed.filter("above AND NOT was_above").filter(recent).select("ticker", "date", "close", "sma_50")


def screen_golden_cross(indicators: DataFrame) -> DataFrame:
    return latest_bars(indicators, "sma_50", "sma_200").filter("sma_50 > sma_200")


def screen_macd_bullish(indicators: DataFrame) -> DataFrame:
    return latest_bars(indicators, "macd", "macd_signal").filter("macd > macd_signal")


def screen_momentum(indicators: DataFrame, min_change: float = 10, top: int | None = None) -> DataFrame:
    hits = latest_bars(indicators, "close", "pct_change_20d").filter(F.col("pct_change_20d") > min_change)
    return hits if top is None else hits.orderBy(F.desc("pct_change_20d"), "ticker").limit(top)


def screen_near_52w_high(indicators: DataFrame, within: float = 5) -> DataFrame:
    return latest_bars(indicators, "close", "week_52_high", "pct_from_52w_high").filter(
        F.col("pct_from_52w_high") >= -within
    )


def screen_rsi(indicators: DataFrame, low: float = 30, high: float = 70) -> DataFrame:
    rsi = F.col("rsi_14")
    signal = F.when(rsi < low, "oversold").when(rsi > high, "overbought")
    return latest_bars(indicators, "rsi_14").withColumn("signal", signal).filter("signal IS NOT NULL")


def screen_bollinger_squeeze(indicators: DataFrame, share: float = 0.1) -> DataFrame:
    """Newest bars whose band width is in the lowest share of the company's own history."""
    width = (F.col("bb_upper") - F.col("bb_lower")) / F.nullif("bb_middle", F.lit(0.0))
    history = indicators.select("ticker", "date", width.alias("band_width")).filter("band_width IS NOT NULL")
    own = W.partitionBy("ticker")
    ranked = history.withColumn("width_rank", F.percent_rank().over(own.orderBy("band_width"))).withColumn(
        "last_date", F.max("date").over(own)
    )
    return ranked.filter((F.col("date") == F.col("last_date")) & (F.col("width_rank") <= share)).drop("last_date")


def screen_pullback(indicators: DataFrame, max_rsi: float = 40) -> DataFrame:
    hits = latest_bars(indicators, "close", "sma_200", "rsi_14")
    return hits.filter((F.col("rsi_14") < max_rsi) & (F.col("close") > F.col("sma_200")))


def screen_confirmed_momentum(indicators: DataFrame, prices: DataFrame | None = None, top: int = 20) -> DataFrame:
    """Strong, not overbought, MACD-confirmed bars above their 50-row mean.

    The price is the close that the indicators were made of, unless another
    price table is given.
    """
    strong = indicators.filter("pct_change_20d > 10 AND rsi_14 < 70 AND macd > macd_signal")
    if prices is None:
        priced = strong.withColumn("current_price", F.col("close"))
    else:
        priced = strong.join(prices.select("ticker", "date", F.col("close").alias("current_price")), ["ticker", "date"])
    return (
        priced.filter("current_price > sma_50")
        .select("ticker", "date", "rsi_14", "macd", "macd_signal", "pct_change_20d", "sma_50", "current_price")
        .orderBy(F.desc("pct_change_20d"), "ticker", "date")
        .limit(top)
    )


def screen_drop_with_growth(indicators: DataFrame, growth: DataFrame, max_change: float = -10) -> DataFrame:
    """Newest 20-day change below a limit while the last reported income grew."""
    fallen = latest_bars(indicators, "pct_change_20d").filter(F.col("pct_change_20d") < max_change)
    grown = newest(growth.filter("income_growth_yoy IS NOT NULL"), ["income_growth_yoy"], "fiscal_date")
    return fallen.join(grown.filter("income_growth_yoy > 0"), "ticker").select(
        "ticker", "pct_change_20d", "income_growth_yoy"
    )


# -- earnings --------------------------------------------------------------------


def screen_beat_estimates(history: DataFrame, *, as_of: date) -> DataFrame:
    """Companies whose newest report beat its estimate."""
    past = history.filter(F.col("report_date") <= F.lit(as_of)).withColumn("date", F.col("report_date"))
    last = newest(past, ["eps_actual", "eps_estimate", "surprise_pct"], "report_date")
    return last.filter("eps_actual > eps_estimate")


def screen_consistent_beats(history: DataFrame, min_share: float = 0.75) -> DataFrame:
    beat = F.when(F.col("eps_actual") > F.col("eps_estimate"), 1.0).otherwise(0.0)
    rated = history.filter("eps_actual IS NOT NULL AND eps_estimate IS NOT NULL")
    shares = rated.groupBy("ticker").agg(F.avg(beat).alias("beat_share"), F.count("*").alias("reports"))
    return shares.filter(F.col("beat_share") > min_share)


def surprise_history(history: DataFrame, ticker: str, *, as_of: date, years: int = 2) -> DataFrame:
    since = F.add_months(F.lit(as_of), -12 * years)
    rows = history.filter((F.col("ticker") == ticker) & F.col("report_date").between(since, F.lit(as_of)))
    return rows.select("ticker", "report_date", "eps_estimate", "eps_actual", "surprise_pct").orderBy(
        F.desc("report_date")
    )


def earnings_this_week(calendar: DataFrame, *, as_of: date, days: int = 7) -> DataFrame:
    end = F.date_add(F.lit(as_of), days)
    return calendar.filter(F.col("earnings_date").between(F.lit(as_of), end)).orderBy("earnings_date", "ticker")


# -- analysts ----------------------------------------------------------------------


def screen_upside(targets: DataFrame, min_upside: float = 20) -> DataFrame:
    hits = targets.filter(F.col("upside_pct") >= min_upside)
    return hits.select("ticker", "current_price", "target_mean", "upside_pct").orderBy(F.desc("upside_pct"), "ticker")


def recent_actions(scores: DataFrame, score: int, *, as_of: date, days: int = 90) -> DataFrame:
    recent = F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of))
    return scores.filter((F.col("action_score") == score) & recent).select("ticker", "date", "firm", "to_grade")


def screen_upgrades(scores: DataFrame, *, as_of: date, days: int = 90) -> DataFrame:
    return recent_actions(scores, 1, as_of=as_of, days=days)


def screen_downgrades(scores: DataFrame, *, as_of: date, days: int = 90) -> DataFrame:
    return recent_actions(scores, -1, as_of=as_of, days=days)


def bullish_firms(scores: DataFrame, metadata: DataFrame, sector: str) -> DataFrame:
    inside = metadata.filter(F.col("sector") == sector).select("ticker")
    return (
        scores.join(inside, "ticker", "left_semi")
        .groupBy("firm")
        .agg(F.avg("action_score").alias("mean_score"), F.count("*").alias("actions"))
        .orderBy(F.desc("mean_score"), "firm")
    )


def screen_growth_estimate(estimates: DataFrame, min_growth: float = 20) -> DataFrame:
    return estimates.filter(F.col("next_5yr_growth") > min_growth).select("ticker", "date", "next_5yr_growth")


def estimate_revisions(estimates: DataFrame, metric: str = "current_year_growth") -> DataFrame:
    """Estimates above the one published before."""
    before = F.lag(metric).over(W.partitionBy("ticker").orderBy("date"))
    revised = estimates.select("ticker", "date", F.col(metric).alias("estimate"), before.alias("previous"))
    return revised.filter("estimate > previous")


# -- peers ----------------------------------------------------------------------------


def peer_rank(facts: DataFrame, peers: DataFrame, metric: str, year: int, top: int | None = None) -> DataFrame:
    """Ranks of a metric inside each peer group for a year, all of them or the best `top`.

    A row is one company of a year; equal metrics are ranked by ticker. With
    `top`, the rank filter keeps that many rows per group in every map task,
    before the shuffle. Without, a group is ranked over ranges of its rows.
    """
    rows = facts.filter(in_year("date", year) & F.col(metric).isNotNull()).select("ticker", "date", metric)
    placed = rows.join(peers, "ticker")
    if top is None:
        ranked = segmented_rank(placed, "peer_group", [-F.col(metric), F.col("ticker")], "peer_rank", [F.col("date")])
    else:
        order = W.partitionBy("peer_group").orderBy(F.desc(metric), "ticker")
        ranked = placed.withColumn("peer_rank", F.rank().over(order).cast("bigint")).filter(F.col("peer_rank") <= top)
    return ranked.select("peer_group", "ticker", "date", metric, "peer_rank")


def peer_multiples(valuation: DataFrame, peers: DataFrame, group: str) -> DataFrame:
    members = peers.filter(F.col("peer_group") == group).select("ticker")
    return valuation.join(members, "ticker").select("ticker", "pe_ratio", "pb_ratio", "ps_ratio", "peg_ratio")
