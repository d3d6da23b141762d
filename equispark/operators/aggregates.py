"""Grouped summaries over the derived tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.operators.ordering import exact_quantiles


def pe_by_sector(valuation: DataFrame, metadata: DataFrame) -> DataFrame:
    sectors = metadata.select("ticker", "sector")
    return valuation.join(sectors, "ticker").groupBy("sector").agg(
        F.avg("pe_ratio").alias("avg_pe"), F.count("pe_ratio").alias("companies")
    )


def cap_by_industry(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("industry").agg(F.sum("marketCap").alias("total_market_cap"))


def median_growth(growth: DataFrame, metadata: DataFrame) -> DataFrame:
    """Exact median revenue growth per sector."""
    sectors = metadata.select("ticker", "sector")
    grown = growth.filter("revenue_growth_yoy IS NOT NULL").join(sectors, "ticker")
    return exact_quantiles(grown, "sector", "revenue_growth_yoy", [0.5]).withColumnRenamed("q0", "median_growth")


def group_avg_roe(ratios: DataFrame, peers: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean ROE of the named groups, one column each per report date."""
    members = peers.filter(F.col("peer_group").isin(*groups))
    means = [F.avg(F.when(F.col("peer_group") == g, F.col("roe"))).alias(f"roe_{i}") for i, g in enumerate(groups)]
    return ratios.join(members, "ticker").groupBy("date").agg(*means)


def group_estimates(estimates: DataFrame, peers: DataFrame) -> DataFrame:
    return estimates.join(peers, "ticker").groupBy("peer_group").agg(
        F.avg("current_year_growth").alias("avg_current_year"),
        F.avg("next_5yr_growth").alias("avg_next_5yr"),
        F.count("*").alias("n"),
    )


def sector_relative(valuation: DataFrame, metadata: DataFrame, metric: str = "ps_ratio") -> DataFrame:
    """Each company's metric over its sector's mean.

    The mean comes from an aggregate joined back: a window per sector would put
    a whole sector into one task.
    """
    placed = valuation.select("ticker", metric).join(metadata.select("ticker", "sector"), "ticker")
    means = placed.groupBy("sector").agg(F.avg(metric).alias("sector_avg"))
    return placed.join(means, "sector").select(
        "ticker", "sector", metric, "sector_avg", F.try_divide(metric, "sector_avg").alias("relative")
    )


def describe(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long-form summary statistics of numeric columns; the quartiles are exact."""
    long = frame.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "column_name", "value", [0.25, 0.5, 0.75]).toDF("column_name", "p25", "p50", "p75")
    return moments.join(quartiles, "column_name", "left")


def daily_returns(prices: DataFrame) -> DataFrame:
    before = F.lag("close").over(W.partitionBy("ticker").orderBy("date"))
    returns = prices.select("ticker", "date", "close", before.alias("prev_close"))
    return returns.select(
        "ticker", "date", F.when(F.col("prev_close") > 0, F.col("close") / F.col("prev_close") - 1).alias("ret")
    ).filter("ret IS NOT NULL")


def return_correlation(prices: DataFrame, subject: str) -> DataFrame:
    """Correlation of every company's daily returns with the subject's, on common days.

    The subject has one return a day: the join adds no rows, and the calendar
    bounds what is broadcast.
    """
    returns = daily_returns(prices)
    own = returns.filter(F.col("ticker") == subject).select("date", F.col("ret").alias("subject_ret"))
    both = returns.filter(F.col("ticker") != subject).join(F.broadcast(own), "date")
    return both.groupBy("ticker").agg(F.corr("ret", "subject_ret").alias("correlation"), F.count("*").alias("days"))


def pair_correlation(prices: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Correlation of the daily returns of every pair of the given companies, on common days.

    A day gathers at most one return of each company asked for; its pairs go
    into partial co-moments before anything is shuffled by pair, so the number
    of rows that meet is the number of pairs per task.
    """
    chosen = sorted(set(tickers))
    returns = daily_returns(prices.filter(F.col("ticker").isin(*chosen)))
    days = returns.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("day"))
    one = days.select("day", F.posexplode("day").alias("place", "one"))
    both = one.select("one", F.explode(F.slice("day", F.col("place") + 2, F.size("day"))).alias("other"))
    return both.groupBy(F.col("one.ticker").alias("ticker"), F.col("other.ticker").alias("other")).agg(
        F.corr("one.ret", "other.ret").alias("correlation"), F.count("*").alias("days")
    )


def freshness_stats(log: DataFrame, *, now: datetime, threshold_days: int = 7) -> DataFrame:
    """Whole-day ages of the newest fetch per symbol: mean, extremes and the stale count."""
    newest = log.groupBy("ticker").agg(F.max("last_fetched").alias("last_fetched"))
    age = F.floor(F.timestamp_diff("SECOND", "last_fetched", F.lit(now).cast("timestamp_ntz")) / 86400)
    return newest.select(age.cast("bigint").alias("age")).agg(
        F.avg("age").alias("avg_age_days"),
        F.max("age").alias("max_age_days"),
        F.min("age").alias("min_age_days"),
        F.count(F.when(F.col("age") >= threshold_days, 1)).alias("stale_symbols"),
    )


def date_span(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()
