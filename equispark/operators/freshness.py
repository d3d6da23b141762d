"""Fetch logs: staleness, skip lists and run summaries."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.sources.store import upsert_by_key

# The data types a company needs before it can be skipped.
REQUIRED_TYPES = (
    "financials_annual",
    "financials_quarterly",
    "prices_daily",
    "dividends_history",
    "splits_history",
    "company_metadata",
)


def whole_days(since: Column, now: datetime) -> Column:
    """Completed 24-hour days, not calendar days."""
    seconds = F.timestamp_diff("SECOND", since, F.lit(now).cast("timestamp_ntz"))
    return F.floor(seconds / 86400).cast("bigint")


def freshness_status(symbols: DataFrame, log: DataFrame, *, now: datetime, threshold_days: int = 7) -> DataFrame:
    """Age, staleness and a label for each symbol; one never fetched is stale."""
    newest = log.groupBy("ticker").agg(F.max("last_fetched").alias("last_fetched"), F.count("*").alias("n_log"))
    aged = symbols.select("ticker").distinct().join(newest, "ticker", "left").withColumn(
        "days_old", whole_days(F.col("last_fetched"), now)
    )
    label = (
        F.when(F.col("n_log").isNull(), "never fetched")
        .when(F.col("days_old").isNull(), "unknown")
        .otherwise(F.concat(F.col("days_old").cast("string"), F.lit(" days old")))
    )
    stale = F.coalesce(F.col("days_old") >= threshold_days, F.lit(True))
    return aged.select("ticker", "days_old", stale.alias("is_stale"), label.alias("label"))


def freshness_skip_list(
    log: DataFrame,
    *,
    now: datetime,
    threshold_days: int = 7,
    required: Sequence[str] = REQUIRED_TYPES,
    mode: str = "refresh",
) -> DataFrame:
    """Symbols a refresh may skip: every required type is fresh. Other modes skip none."""
    if mode != "refresh":
        return log.select("ticker").limit(0)
    newest = log.filter(F.col("data_type").isin(*required)).groupBy("ticker", "data_type").agg(
        F.max("last_fetched").alias("last_fetched")
    )
    fresh = newest.filter(whole_days(F.col("last_fetched"), now) < threshold_days)
    return fresh.groupBy("ticker").agg(F.count("*").alias("n")).filter(F.col("n") == len(required)).select("ticker")


def latest_records(log: DataFrame) -> DataFrame:
    """One record per (ticker, data_type): the newest log entry."""
    order = F.struct("last_fetched", "event_id")
    return log.groupBy("ticker", "data_type").agg(
        F.max("last_fetched").alias("last_fetched"),
        F.max_by("status", order).alias("status"),
        F.max_by("record_count", order).alias("record_count"),
    )


def freshness_update(records: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert_by_key(records, updates, ("ticker", "data_type"))


def ingest_run_summary(log: DataFrame) -> DataFrame:
    """Counts by outcome, mean duration over all and rows over the successes."""
    def outcome(name):
        return F.count(F.when(F.col("status") == name, 1)).alias(f"n_{name}")

    return log.agg(
        outcome("success"),
        outcome("failed"),
        outcome("skipped"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("record_count"))), F.lit(0)).alias("total_rows"),
    )


def ingest_failures(log: DataFrame, top: int = 10) -> DataFrame:
    """The first failures of a run, for the report."""
    failed = log.filter("status = 'failed'").select("event_id", "ticker", "data_type", "last_fetched")
    return failed.orderBy("event_id").limit(top)
