"""Ratios, growth, latest snapshots and valuation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.functions.numeric import decimal4, pos_div

# Named groups of companies.
PEER_GROUPS: dict[str, list[str]] = {
    "FAANG": ["META", "AAPL", "AMZN", "NFLX", "GOOGL"],
    "Magnificent Seven": ["AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "TSLA"],
    "Semiconductors": ["NVDA", "AMD", "INTC", "TSM", "QCOM", "AVGO", "MU"],
    "Cloud Computing": ["AMZN", "MSFT", "GOOGL", "CRM", "ORCL", "IBM"],
    "Social Media": ["META", "SNAP", "PINS", "TWTR", "RDDT"],
    "Streaming": ["NFLX", "DIS", "PARA", "WBD"],
    "E-commerce": ["AMZN", "EBAY", "SHOP", "ETSY", "MELI"],
    "Payment Processors": ["V", "MA", "PYPL", "SQ", "AXP"],
    "Electric Vehicles": ["TSLA", "RIVN", "LCID", "F", "GM"],
    "Airlines": ["AAL", "DAL", "UAL", "LUV", "JBLU"],
    "Banks": ["JPM", "BAC", "WFC", "C", "GS", "MS"],
    "Oil & Gas": ["XOM", "CVX", "COP", "SLB", "BP", "SHEL"],
    "Defense": ["LMT", "RTX", "BA", "NOC", "GD"],
    "Retail": ["WMT", "TGT", "COST", "HD", "LOW"],
    "Pharma": ["JNJ", "PFE", "MRK", "ABBV", "LLY", "BMY"],
    "Telecom": ["T", "VZ", "TMUS", "CMCSA"],
}

STATEMENT_COLUMNS = ("netIncome", "totalRevenue", "shareholderEquity", "totalAssets")
LARGE_CAP = 10e9
MID_CAP = 2e9


def ratios_financial(annual: DataFrame) -> DataFrame:
    """Nine ratios per statement with revenue; each needs a positive denominator."""
    ratios = {
        "net_margin": ("netIncome", "totalRevenue"),
        "roe": ("netIncome", "shareholderEquity"),
        "roa": ("netIncome", "totalAssets"),
        "debt_ratio": ("totalLiabilities", "totalAssets"),
        "cash_conversion": ("operatingCashFlow", "netIncome"),
        "fcf_margin": ("freeCashFlow", "totalRevenue"),
        "asset_turnover": ("totalRevenue", "totalAssets"),
        "gross_margin": ("grossProfit", "totalRevenue"),
        "ebitda_margin": ("ebitda", "totalRevenue"),
    }
    columns = [pos_div(num, den).alias(name) for name, (num, den) in ratios.items()]
    return annual.filter("totalRevenue IS NOT NULL").select("ticker", "date", *columns)


def _with_prior_filings(annual: DataFrame) -> DataFrame:
    """Adds `prior_filings`: revenue and income of the calendar year before.

    A range frame over the year finds them in the one shuffle on ticker; a
    self-join would build the table twice. A ticker files once or a few times a
    year, which bounds both the frame and the partition.
    """
    last_year = W.partitionBy("ticker").orderBy("fy").rangeBetween(-1, -1)
    prior = F.collect_list(F.struct("totalRevenue", "netIncome")).over(last_year)
    years = annual.withColumn("fy", F.year("date"))
    return years.withColumn("prior_filings", F.when(F.col("fy").isNotNull(), prior)).drop("fy")


def growth_annual(annual: DataFrame) -> DataFrame:
    """Each statement beside every statement of the calendar year before.

    Exploding the prior filings keeps the semantics of a left join: a gap gives
    NULL, two prior filings give two rows.
    """
    statements = annual.select("ticker", "date", "totalRevenue", "netIncome")
    pairs = _with_prior_filings(statements).withColumn("p", F.explode_outer("prior_filings"))
    return pairs.select(
        "ticker",
        "date",
        "totalRevenue",
        "netIncome",
        F.col("p.totalRevenue").alias("prior_revenue"),
        F.col("p.netIncome").alias("prior_income"),
        pos_div(F.col("totalRevenue") - F.col("p.totalRevenue"), F.col("p.totalRevenue")).alias("revenue_growth_yoy"),
        pos_div(F.col("netIncome") - F.col("p.netIncome"), F.col("p.netIncome")).alias("income_growth_yoy"),
    )


# -- peers -------------------------------------------------------------------


def peer_membership(spark: SparkSession) -> DataFrame:
    """(ticker, peer_group) of the built-in groups, many to many."""
    rows = [(ticker, group) for group, tickers in PEER_GROUPS.items() for ticker in tickers]
    return spark.createDataFrame(rows, "ticker string, peer_group string")


def peer_lookup(peers: DataFrame, group: str) -> DataFrame:
    return peers.filter(F.lower("peer_group") == group.lower()).select("ticker").distinct()


# -- latest snapshots ----------------------------------------------------------


def newest(frame: DataFrame, columns: Sequence[str], date_name: str = "date") -> DataFrame:
    """The newest row per ticker as partial aggregates: no sort, no hot partition."""
    picks = [F.max_by(c, "date").alias(c) for c in columns]
    return frame.groupBy("ticker").agg(F.max("date").alias(date_name), *picks)


def latest_price(prices: DataFrame) -> DataFrame:
    return newest(prices.select("ticker", "date", F.col("close").alias("price")), ["price"], "price_date")


def latest_financials(annual: DataFrame) -> DataFrame:
    return newest(annual.filter("totalRevenue IS NOT NULL"), STATEMENT_COLUMNS, "fiscal_date")


def trailing_dividends(dividends: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    recent = dividends.filter(F.col("date") >= F.date_sub(F.lit(as_of), days))
    return recent.groupBy("ticker").agg(
        F.sum("amount").alias("annual_dividend"), F.max("date").alias("last_dividend_date")
    )


def implied_shares(metadata: DataFrame, prices: DataFrame) -> DataFrame:
    return metadata.join(latest_price(prices), "ticker", "left").select(
        "ticker", "marketCap", pos_div("marketCap", "price").alias("shares")
    )


def cap_class(cap: Column) -> Column:
    return (
        F.when(cap >= LARGE_CAP, "Large Cap").when(cap >= MID_CAP, "Mid Cap").when(cap > 0, "Small Cap").otherwise("Unknown")
    )


def classify_caps(metadata: DataFrame) -> DataFrame:
    return metadata.select("ticker", "marketCap", cap_class(F.col("marketCap")).alias("cap_class"))


def valuation_metrics(
    prices: DataFrame, annual: DataFrame, dividends: DataFrame, metadata: DataFrame, *, as_of: date
) -> DataFrame:
    """Market multiples at each company's newest price.

    Every input is first reduced to one row per ticker by partial aggregation,
    so all joins are ticker-sized and share the ticker partitioning. The newest
    statement brings its prior filings along; the statements are read once.
    """
    company = metadata.select("ticker", "marketCap")
    statements = annual.select("ticker", "date", *STATEMENT_COLUMNS)
    latest = newest(
        _with_prior_filings(statements).filter("totalRevenue IS NOT NULL"),
        [*STATEMENT_COLUMNS, "prior_filings"],
        "fiscal_date",
    ).withColumn("prior", F.explode_outer("prior_filings"))
    base = (
        latest_price(prices)
        .join(company, "ticker")
        .join(latest, "ticker", "left")
        .join(trailing_dividends(dividends, as_of), "ticker", "left")
        .withColumn("shares", pos_div("marketCap", "price"))
    )
    price, cap, shares = F.col("price"), F.col("marketCap"), F.col("shares")
    income, equity, revenue = F.col("netIncome"), F.col("shareholderEquity"), F.col("totalRevenue")
    before, dividend = F.col("prior.totalRevenue"), F.col("annual_dividend")
    growth_rate = pos_div(revenue - before, before)
    has_shares = shares > 0
    pe = F.when((income > 0) & has_shares, price / (income / shares))
    return base.select(
        "ticker",
        F.col("price_date").alias("date"),
        "price",
        cap.alias("market_cap"),
        pe.alias("pe_ratio"),
        F.when((equity > 0) & has_shares, price / (equity / shares)).alias("pb_ratio"),
        F.when((revenue > 0) & (cap > 0), cap / revenue).alias("ps_ratio"),
        F.when(growth_rate > 0, pe / (growth_rate * 100)).alias("peg_ratio"),
        F.when((price > 0) & (dividend > 0), dividend / price).alias("dividend_yield"),
        F.when((income > 0) & (dividend > 0), dividend * shares / income).alias("payout_ratio"),
        cap_class(cap).alias("cap_class"),
    )


# -- decimal domain metrics ------------------------------------------------------


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(24,4)")


def domain_margins(statements: DataFrame) -> DataFrame:
    """Net and operating margin, four places; NULL on missing data or mixed currencies."""
    revenue, same = _money("totalRevenue"), F.col("revenue_currency")

    def margin(amount: str, currency: str) -> Column:
        usable = (revenue != 0) & (F.col(currency) == same)
        return F.when(usable, decimal4(F.try_divide(_money(amount), revenue)))

    return statements.select(
        "ticker",
        "date",
        margin("netIncome", "income_currency").alias("net_margin"),
        margin("operatingIncome", "operating_currency").alias("operating_margin"),
    )


def growth_rate_decimal(pairs: DataFrame) -> DataFrame:
    """Growth from `previous` to `current`, four places, with the reason where undefined."""
    now, before = _money("current"), _money("previous")
    error = F.when(F.col("current_currency") != F.col("previous_currency"), "currency mismatch").when(
        before == 0, "previous is zero"
    )
    return pairs.withColumn("error", error).withColumn(
        "growth_rate", F.when(F.col("error").isNull(), decimal4(F.try_divide(now - before, before)))
    )


def healthy_balance_sheet(annual: DataFrame, limit: float = 0.6) -> DataFrame:
    healthy = pos_div("totalLiabilities", "totalAssets") < limit
    return annual.select("ticker", "date", F.coalesce(healthy, F.lit(False)).alias("is_healthy"))


def safe_ratios(annual: DataFrame) -> DataFrame:
    """Both division guards side by side: positive denominators, and nonzero ones."""
    from equispark.functions.numeric import nonzero_div

    return annual.select(
        "ticker",
        "date",
        pos_div("totalRevenue", "netIncome").alias("positive_only"),
        nonzero_div("totalRevenue", "netIncome").alias("nonzero"),
    )
