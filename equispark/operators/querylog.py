"""Query-log and request-log reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _newest_first():
    return F.desc("timestamp"), F.desc("id")


def query_log_stats(log: DataFrame) -> DataFrame:
    """Totals, favourites, failures, success share and mean time of a log."""
    counts = log.agg(
        F.count("*").alias("total_queries"),
        F.count(F.when(F.col("is_favorite"), 1)).alias("favorites_count"),
        F.count("error_message").alias("failed_queries"),
        F.avg("execution_time_ms").alias("mean_ms"),
    )
    total, failed = F.col("total_queries"), F.col("failed_queries")
    return counts.select(
        "total_queries",
        "favorites_count",
        "failed_queries",
        F.when(total > 0, (total - failed) / total * 100).otherwise(0.0).alias("success_rate"),
        F.round(F.coalesce("mean_ms", F.lit(0.0)), 2).alias("avg_execution_time_ms"),
    )


def query_log_repeats(log: DataFrame, top: int = 5) -> DataFrame:
    """The most repeated query texts."""
    counts = log.groupBy("user_query").agg(F.count("*").alias("n")).filter("n > 1")
    return counts.orderBy(F.desc("n"), "user_query").limit(top)


def query_log_recent(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(*_newest_first()).limit(n)


def query_log_favorites(log: DataFrame) -> DataFrame:
    return log.filter("is_favorite").orderBy(*_newest_first())


def query_log_search(log: DataFrame, text: str, n: int = 20) -> DataFrame:
    """Newest entries with the text in the query or its notes, case-insensitive."""
    wanted = text.lower()
    hit = F.lower("user_query").contains(wanted) | F.coalesce(F.lower("notes").contains(wanted), F.lit(False))
    return log.filter(hit).orderBy(*_newest_first()).limit(n)


def query_log_prune(log: DataFrame, max_records: int) -> DataFrame:
    """The newest records only: a top-k per partition, merged. Zero or less keeps the whole log."""
    return log if max_records <= 0 else log.orderBy(*_newest_first()).limit(max_records)


def query_log_to_turns(log: DataFrame) -> DataFrame:
    """Log rows as user turns of one-turn conversations, details as JSON."""
    details = F.to_json(
        F.struct("generated_sql", "row_count", "execution_time_ms", F.lit("legacy_migration").alias("source")),
        {"ignoreNullFields": "false"},
    )
    return log.select(
        F.concat(F.lit("legacy-"), F.col("id").cast("string")).alias("conversation_id"),
        F.lit("user").alias("role"),
        F.col("user_query").alias("content"),
        details.alias("metadata"),
        F.col("timestamp").alias("created_at"),
    )


def cache_hit_stats(requests: DataFrame) -> DataFrame:
    """Hits, misses, hit rate and mean latency of a request log with a hit flag."""
    hits, total = F.count(F.when(F.col("is_hit"), 1)), F.count("*")
    return requests.agg(
        hits.alias("hits"),
        (total - hits).alias("misses"),
        total.alias("total_requests"),
        F.when(total > 0, hits / total * 100).otherwise(0.0).alias("hit_rate_pct"),
        F.count("latency_ms").alias("latency_samples"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )


def invalidate_by_symbol(entries: DataFrame, key: str, symbols: str, refreshed: DataFrame) -> DataFrame:
    """Entries that depend on any refreshed symbol, compared in upper case.

    Dependencies are exploded and semi-joined, so neither side has to fit in a
    task or on the driver.
    """
    depends = entries.select(key, F.explode(symbols).alias("s")).select(key, F.upper("s").alias("symbol"))
    changed = refreshed.select(F.upper("ticker").alias("symbol")).distinct()
    return depends.join(changed, "symbol", "left_semi").select(key).distinct()
