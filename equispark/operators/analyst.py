"""Earnings and analyst tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.functions.numeric import pct_change


def earnings_history(raw: DataFrame) -> DataFrame:
    return raw.filter("report_date IS NOT NULL").orderBy("ticker", F.desc("report_date"), "fiscal_period")


def earnings_upcoming(calendar: DataFrame, *, as_of: date) -> DataFrame:
    return calendar.filter(F.col("earnings_date") >= F.lit(as_of)).orderBy("earnings_date", "ticker")


def recommendation_scores(raw: DataFrame) -> DataFrame:
    """Adds 1 for `up`, -1 for `down`, 0 for anything else."""
    score = F.when(F.col("action") == "up", 1).when(F.col("action") == "down", -1).otherwise(0)
    return raw.filter("date IS NOT NULL").withColumn("action_score", score.cast("bigint"))


def price_target_upside(raw: DataFrame) -> DataFrame:
    current = F.col("current_price")
    return (
        raw.filter("date IS NOT NULL")
        .withColumn("upside_pct", pct_change("target_mean", current))
        .withColumn("downside_pct", pct_change("target_low", current))
        .withColumn("max_upside_pct", pct_change("target_high", current))
    )


def analyst_consensus(raw: DataFrame) -> DataFrame:
    """Adds the number of votes, their mean on a 1-5 scale and its label."""
    votes = ("strong_buy", "buy", "hold", "sell", "strong_sell")
    labels = ("Strong Buy", "Buy", "Hold", "Sell", "Strong Sell")
    total = sum((F.col(v) for v in votes[1:]), F.col(votes[0]))
    points = sum((F.col(v) * (weight + 1) for weight, v in enumerate(votes)), F.lit(0))
    rated = raw.filter("date IS NOT NULL").withColumn("total_analysts", total).withColumn(
        "consensus_rating",
        F.when(F.col("total_analysts") > 0, points.cast("double") / F.col("total_analysts")),
    )
    rating = F.col("consensus_rating")
    label = F.when(rating <= 1.5, labels[0])
    for step, name in enumerate(labels[1:4], start=1):
        label = label.when(rating <= 1.5 + step, name)
    return rated.withColumn("consensus_label", label.when(rating > 4.5, labels[4]))


def growth_estimates_peg(raw: DataFrame, valuation: DataFrame) -> DataFrame:
    """Adds P/E over the five-year growth estimate."""
    multiples = valuation.select("ticker", "pe_ratio")
    peg = F.when(F.col("next_5yr_growth") > 0, F.col("pe_ratio") / F.col("next_5yr_growth"))
    return (
        raw.filter("date IS NOT NULL")
        .join(multiples, "ticker", "left")
        .withColumn("peg_forward", peg)
        .drop("pe_ratio")
    )
