"""Rankings and per-company series. Windows are per company and bounded by its reports or bars."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.functions.dates import in_year
from equispark.functions.numeric import pos_div
from equispark.operators.aggregates import daily_returns
from equispark.operators.ordering import segmented_rank


def rank_revenue(annual: DataFrame, top: int = 10) -> DataFrame:
    """Top N revenues per year with rank and dense rank.

    Filtering on the rank lets every map task keep only its own top N per year.
    """
    by_year = W.partitionBy("fiscal_year").orderBy(F.desc_nulls_last("totalRevenue"))
    ranked = annual.select(
        "ticker", F.year("date").cast("bigint").alias("fiscal_year"), "totalRevenue"
    ).withColumn("revenue_rank", F.rank().over(by_year).cast("bigint")).filter(F.col("revenue_rank") <= top)
    return ranked.withColumn("revenue_dense_rank", F.dense_rank().over(by_year).cast("bigint"))


def lag_lead(annual: DataFrame) -> DataFrame:
    order = W.partitionBy("ticker").orderBy("date")
    return annual.select(
        "ticker",
        "date",
        "totalRevenue",
        F.lag("totalRevenue").over(order).alias("prior_revenue"),
        F.lead("totalRevenue").over(order).alias("next_revenue"),
    )


def moving_avg(annual: DataFrame, periods: int = 3) -> DataFrame:
    frame = W.partitionBy("ticker").orderBy("date").rowsBetween(1 - periods, 0)
    return annual.select("ticker", "date", "totalRevenue", F.avg("totalRevenue").over(frame).alias("revenue_avg"))


def top_quartile(ratios: DataFrame, as_of_year: int) -> DataFrame:
    """First quartile of ROE within a year, in NTILE's sense: ties by ticker, then by date.

    A global NTILE would sort everything in one task; see `segmented_rank`.
    """
    rows = ratios.filter(in_year("date", as_of_year) & F.col("roe").isNotNull()).select("ticker", "date", "roe")
    total = rows.agg(F.count("*")).scalar()
    # NTILE gives the first (total mod 4) buckets one row more.
    first_bucket = F.floor(total / 4) + F.when(total % 4 > 0, 1).otherwise(0)
    one = rows.withColumn("quartile", F.lit(1).cast("bigint"))
    numbered = segmented_rank(one, "quartile", [-F.col("roe"), F.col("ticker"), F.col("date")], "row_no")
    return numbered.filter(F.col("row_no") <= first_bucket).select("ticker", "date", "roe", "quartile")


def volatility(prices: DataFrame, metadata: DataFrame, subject: str, n_peers: int = 3) -> DataFrame:
    """30, 90 and 252 day deviations of daily returns of a company and its largest sector peers."""
    company = metadata.select("ticker", "sector", "marketCap")
    sector = company.filter(F.col("ticker") == subject).select(F.col("sector").alias("own_sector"))
    peers = (
        company.filter(F.col("ticker") != subject)
        .join(sector, F.col("sector") == F.col("own_sector"), "left_semi")
        .orderBy(F.desc("marketCap"), "ticker")
        .limit(n_peers)
    )
    chosen = peers.select("ticker").unionByName(company.filter(F.col("ticker") == subject).select("ticker"))
    returns = daily_returns(prices.join(chosen, "ticker", "left_semi"))
    order = W.partitionBy("ticker").orderBy("date")
    frames = [F.stddev_samp("ret").over(order.rowsBetween(1 - n, 0)).alias(f"vol_{n}") for n in (30, 90, 252)]
    return returns.select("ticker", "date", *frames)


def qoq_growth(quarterly: DataFrame, tickers: tuple[str, ...] | None = None) -> DataFrame:
    rows = quarterly if tickers is None else quarterly.filter(F.col("ticker").isin(*tickers))
    before = F.lag("totalRevenue").over(W.partitionBy("ticker").orderBy("date"))
    return rows.select("ticker", "date", "totalRevenue", before.alias("prior_quarter")).withColumn(
        "qoq_growth", pos_div(F.col("totalRevenue") - F.col("prior_quarter"), "prior_quarter")
    )


def dividend_streaks(dividends: DataFrame, min_years: int = 5) -> DataFrame:
    """Runs of consecutive calendar years in which the yearly dividend rose."""
    yearly = dividends.groupBy("ticker", F.year("date").alias("y")).agg(F.sum("amount").alias("paid"))
    order = W.partitionBy("ticker").orderBy("y")
    rose = (F.col("paid") > F.lag("paid").over(order)) & (F.col("y") == F.lag("y").over(order) + 1)
    marked = yearly.withColumn("broke", F.when(rose, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("broke").over(order))
    lengths = runs.groupBy("ticker", "run").agg(
        F.sum(1 - F.col("broke")).cast("bigint").alias("raises"), F.max("y").cast("bigint").alias("last_year")
    )
    return lengths.filter(F.col("raises") >= min_years).select("ticker", "raises", "last_year")


def improving_margin(ratios: DataFrame) -> DataFrame:
    """Companies whose newest net margin tops the year before, which tops the one before that."""
    order = W.partitionBy("ticker").orderBy("date")
    seen = ratios.select(
        "ticker",
        "date",
        "net_margin",
        F.lag("net_margin", 1).over(order).alias("margin_1y"),
        F.lag("net_margin", 2).over(order).alias("margin_2y"),
        (F.lead("date").over(order)).isNull().alias("is_newest"),
    )
    return seen.filter("is_newest AND net_margin > margin_1y AND margin_1y > margin_2y").drop("is_newest")


def total_return(prices: DataFrame, start: date, end: date) -> DataFrame:
    """First against last close of a period, as partial aggregates."""
    inside = prices.filter(F.col("date").between(F.lit(start), F.lit(end)))
    ends = inside.groupBy("ticker").agg(
        F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close")
    )
    return ends.withColumn("return_pct", pos_div(F.col("last_close") - F.col("first_close"), "first_close") * 100)
