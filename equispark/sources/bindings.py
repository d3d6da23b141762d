"""The engine's tables, bound onto the star-schema files by declarative plans.

Every binding aggregates the fact rows before it joins the names, so the wide
shuffle carries partial sums, and sums money in whole cents, so totals do not
depend on the order of addition.
"""

from __future__ import annotations

from copy import copy
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.functions.dates import in_year
from equispark.functions.numeric import cents, from_cents
from equispark.operators.etl import earnings_surprise

# Pairs with a base rate from which the daily rates derive.
FX_PAIRS = [("EUR", "USD", 1.1), ("USD", "GBP", 0.8), ("JPY", "USD", 0.007)]


class MarketTables:
    """Lazy domain tables over one folder of parquet files, of all years or of one."""

    year: int | None = None

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def of_year(self, year: int) -> MarketTables:
        """The tables of one calendar year: the range reaches the scan of the facts.

        Right for all that a year's facts make up; not for growth and the like,
        which look at the year before.
        """
        out = copy(self)
        for name in [n for n, held in vars(out).items() if isinstance(held, DataFrame)]:
            del vars(out)[name]
        out.year = year
        return out

    def file(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream_path(self, name: str) -> str:
        """A table's files as a glob, which a file stream takes for one file as for a folder of them."""
        return f"{self.folder}/{name}.parquet*"

    # -- facts -----------------------------------------------------------

    @cached_property
    def lines(self) -> DataFrame:
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        facts = self.file("lineitem")
        if self.year is not None:
            facts = facts.filter(in_year("l_shipdate", self.year))
        return facts.select(
            "l_orderkey",
            "l_suppkey",
            "l_partkey",
            F.col("l_shipdate").cast("date").alias("d"),
            F.col("l_quantity").alias("q"),
            "l_linenumber",
            "l_returnflag",
            "l_linestatus",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
            cents("l_discount").alias("disc_pct"),
            cents("l_extendedprice").alias("gross_c"),
            cents(net).alias("net_c"),
            cents(net * (1 - F.col("l_tax"))).alias("after_tax_c"),
            cents(F.col("l_extendedprice") * F.col("l_tax")).alias("tax_c"),
        )

    @cached_property
    def names(self) -> DataFrame:
        return self.file("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("ticker"))

    def _named(self, frame: DataFrame) -> DataFrame:
        return frame.join(self.names, "l_suppkey").drop("l_suppkey")

    # -- statements ------------------------------------------------------

    def _statements(self, period: list[str], period_end) -> DataFrame:
        parts = self.file("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
        lines = self.lines.withColumn("y", F.year("d")).withColumn("qtr", F.quarter("d"))
        sums = (
            lines.join(parts, "l_partkey")
            .groupBy("l_suppkey", *period)
            .agg(
                F.sum("gross_c").alias("gross"),
                F.sum("net_c").alias("net"),
                F.sum("after_tax_c").alias("after_tax"),
                F.sum("tax_c").alias("tax"),
                F.sum(F.when(F.col("l_linestatus") == "F", F.col("net_c"))).alias("settled"),
                F.sum(cents(F.col("p_retailprice") * F.col("q"))).alias("cost"),
            )
        )
        equity = self.file("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"),
            F.col("s_name").alias("ticker"),
            (F.col("s_acctbal") * 1000).alias("shareholderEquity"),
        )
        return sums.join(equity, "l_suppkey").select(
            "ticker",
            period_end.alias("date"),
            from_cents("gross").alias("totalRevenue"),
            from_cents("net").alias("grossProfit"),
            from_cents("after_tax").alias("ebitda"),
            from_cents(F.col("net") - 2 * F.col("cost")).alias("netIncome"),
            "shareholderEquity",
            from_cents(F.col("gross") + F.col("cost")).alias("totalAssets"),
            from_cents("cost").alias("totalLiabilities"),
            from_cents(F.col("net") - F.col("cost")).alias("operatingIncome"),
            from_cents("settled").alias("operatingCashFlow"),
            from_cents(F.col("settled") - F.col("tax")).alias("freeCashFlow"),
        )

    @cached_property
    def annual(self) -> DataFrame:
        return self._statements(["y"], F.make_date("y", F.lit(12), F.lit(31)))

    @cached_property
    def quarterly(self) -> DataFrame:
        return self._statements(["y", "qtr"], F.make_date("y", F.col("qtr") * 3, F.lit(1)))

    # -- market data -----------------------------------------------------

    @cached_property
    def prices(self) -> DataFrame:
        bars = self.lines.groupBy("l_suppkey", "d").agg(
            F.min("unit").alias("low"),
            F.max("unit").alias("high"),
            (from_cents(F.sum("gross_c")) / F.sum("q")).alias("close"),
            F.sum("q").cast("bigint").alias("volume"),
        )
        return self._named(bars).select(
            "ticker",
            F.col("d").alias("date"),
            ((F.col("low") + F.col("high")) / 2).alias("open"),
            "high",
            "low",
            "close",
            F.col("close").alias("adj_close"),
            "volume",
        )

    @cached_property
    def dividends(self) -> DataFrame:
        paid = self.lines.filter("l_returnflag = 'R'").groupBy("l_suppkey", "d").agg(F.sum("disc_pct").alias("pct"))
        return self._named(paid).select("ticker", F.col("d").alias("date"), from_cents("pct").alias("amount"))

    @cached_property
    def splits(self) -> DataFrame:
        big = self.lines.filter("l_returnflag = 'N' AND q >= 50")
        ratios = big.groupBy("l_suppkey", "d").agg(F.max("l_linenumber").cast("double").alias("ratio"))
        return self._named(ratios).select("ticker", F.col("d").alias("date"), "ratio")

    # -- companies -------------------------------------------------------

    @cached_property
    def metadata(self) -> DataFrame:
        places = (
            self.file("nation")
            .join(self.file("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
        )
        key = F.col("s_suppkey")
        currency = F.element_at(
            F.array(*[F.lit(c) for c in ("USD", "EUR", "GBP", "JPY")]), (F.col("s_nationkey") % 4 + 1).cast("int")
        )
        return (
            self.file("supplier")
            .join(places, "s_nationkey")
            .select(
                F.col("s_name").alias("ticker"),
                F.concat(F.lit("Company "), "s_name").alias("longName"),
                F.when(key % 10 != 0, F.concat(F.lit("C"), key.cast("string"))).alias("shortName"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"),
                F.concat(F.lit("https://c"), key.cast("string"), F.lit(".example.com")).alias("website"),
                F.col("n_name").alias("country"),
                F.when(key % 3 == 0, "NYSE").when(key % 3 == 1, "nasdaq ").otherwise("XETRA").alias("exchange"),
                F.when(key % 11 == 0, "ETF").when(key % 13 == 0, "MUTUALFUND").otherwise("EQUITY").alias("quoteType"),
                (F.col("s_acctbal") * 2000000).alias("marketCap"),
                (key * 10).alias("employees"),
                F.concat(F.lit("Business of "), "s_name").alias("description"),
                currency.alias("currency"),
                F.when(key % 5 == 0, F.lit("USD")).when(key % 5 == 1, F.lit(" ")).alias("financialCurrency"),
                (key * 10 + 1000).alias("sharesOutstanding"),
            )
        )

    @cached_property
    def peers(self) -> DataFrame:
        groups = F.explode(F.array("sector", "industry")).alias("peer_group")
        return self.metadata.select("ticker", groups)

    @cached_property
    def rates(self) -> DataFrame:
        days = self.lines.select("d").distinct().filter(F.day("d") % 3 != 0)
        pairs = F.explode(
            F.array(*[F.struct(F.lit(b).alias("b"), F.lit(q).alias("q"), F.lit(k).alias("k")) for b, q, k in FX_PAIRS])
        )
        raw = F.col("p.k") * (1 + (F.day("d") % 10) / 100)
        return days.withColumn("p", pairs).select(
            F.col("p.b").alias("base_currency"),
            F.col("p.q").alias("quote_currency"),
            F.col("d").alias("date"),
            (F.floor(raw * 1000000 + 0.5) / 1000000).alias("rate"),
            F.lit("derived").alias("source"),
        )

    @cached_property
    def portfolios(self) -> DataFrame:
        orders = self.file("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        segments = self.file("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        held = (
            self.lines.filter("l_linestatus = 'O'")
            .join(orders, "l_orderkey")
            .join(segments, "o_custkey")
            .groupBy("c_mktsegment", "l_suppkey")
            .agg(F.sum("q").alias("shares"), F.min("d").alias("purchase_date"), F.sum("gross_c").alias("paid"))
        )
        return self._named(held).select(
            F.col("c_mktsegment").alias("portfolio_name"),
            "ticker",
            "shares",
            "purchase_date",
            (from_cents("paid") / F.col("shares")).alias("purchase_price"),
            F.lit(None).cast("string").alias("notes"),
        )

    # -- earnings and analysts -------------------------------------------

    @cached_property
    def earnings_raw(self) -> DataFrame:
        prior = W.partitionBy("ticker").orderBy("date").rowsBetween(-4, -1)
        cent = F.floor(F.col("netIncome") * 100 + 0.5).cast("bigint")
        rev = F.floor(F.col("totalRevenue") * 100 + 0.5).cast("bigint")
        n = F.count("ticker").over(prior)
        quarters = self.quarterly.select(
            "ticker",
            F.col("date").alias("report_date"),
            F.concat(F.lit("Q"), F.quarter("date").cast("string"), F.lit(" "), F.year("date").cast("string")).alias(
                "fiscal_period"
            ),
            (F.when(n > 0, F.sum(cent).over(prior).cast("double") / n) / 100000000).alias("eps_estimate"),
            (F.col("netIncome") / 1000000).alias("eps_actual"),
            (F.when(n > 0, F.sum(rev).over(prior).cast("double") / n) / 100).alias("revenue_estimate"),
            F.col("totalRevenue").alias("revenue_actual"),
        )
        return earnings_surprise(quarters).select(
            "ticker",
            "report_date",
            "fiscal_period",
            "eps_estimate",
            "eps_actual",
            "eps_surprise",
            "surprise_pct",
            "revenue_estimate",
            "revenue_actual",
        )

    @cached_property
    def earnings_calendar(self) -> DataFrame:
        recent = (
            self.file("orders")
            .withColumn("earnings_date", F.col("o_orderdate").cast("date"))
            .select(F.col("o_orderkey").alias("l_orderkey"), "earnings_date", "o_totalprice")
        )
        due = (
            self.lines.join(recent, "l_orderkey")
            .groupBy("l_suppkey", "earnings_date")
            .agg(F.max("o_totalprice").alias("estimate"))
        )
        return self._named(due).select(
            "ticker",
            "earnings_date",
            F.concat(
                F.lit("Q"), F.quarter("earnings_date").cast("string"), F.lit(" "), F.year("earnings_date").cast("string")
            ).alias("period_ending"),
            "estimate",
        )

    @cached_property
    def recommendations_raw(self) -> DataFrame:
        orders = self.file("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            "o_custkey",
            F.col("o_orderdate").cast("date").alias("date"),
            "o_orderpriority",
        )
        segments = self.file("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("firm"))
        priority = F.col("o_orderpriority")
        seen = (
            self.lines.select("l_orderkey", "l_suppkey")
            .join(orders, "l_orderkey")
            .join(segments, "o_custkey")
            .select("l_suppkey", "date", "firm", "o_orderpriority")
            .distinct()
        )
        return self._named(seen).select(
            "ticker",
            "date",
            "firm",
            F.when(priority == "1-URGENT", "Hold").when(priority == "5-LOW", "Hold").otherwise("").alias("from_grade"),
            F.when(priority == "1-URGENT", "Buy").when(priority == "5-LOW", "Sell").otherwise("Hold").alias("to_grade"),
            F.when(priority == "1-URGENT", "up").when(priority == "5-LOW", "down").otherwise("main").alias("action"),
            priority.alias("priority"),
        )

    @cached_property
    def consensus_raw(self) -> DataFrame:
        orders = self.file("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"),
            F.substring("o_orderpriority", 1, 1).alias("p"),
        )
        votes = [
            F.count(F.when(F.col("p") == digit, 1)).alias(name)
            for digit, name in zip("12345", ("strong_buy", "buy", "hold", "sell", "strong_sell"))
        ]
        counts = (
            self.lines.select("l_orderkey", "l_suppkey")
            .join(orders, "l_orderkey")
            .groupBy("l_suppkey", "date")
            .agg(*votes)
        )
        return self._named(counts).select("ticker", "date", "strong_buy", "buy", "hold", "sell", "strong_sell")

    @cached_property
    def price_targets_raw(self) -> DataFrame:
        return self.prices.groupBy("ticker").agg(
            F.max("date").alias("date"),
            F.max_by("close", "date").alias("current_price"),
            F.min("close").alias("target_low"),
            F.avg("close").alias("target_mean"),
            F.max("close").alias("target_high"),
            F.count("close").alias("num_analysts"),
        )

    @cached_property
    def growth_estimates_raw(self) -> DataFrame:
        from equispark.operators.fundamentals import growth_annual

        grown = growth_annual(self.annual).filter("prior_revenue IS NOT NULL")
        return grown.select(
            "ticker",
            "date",
            F.lit(None).cast("double").alias("current_qtr_growth"),
            F.lit(None).cast("double").alias("next_qtr_growth"),
            (F.col("income_growth_yoy") * 100).alias("current_year_growth"),
            F.lit(None).cast("double").alias("next_year_growth"),
            (F.col("revenue_growth_yoy") * 100).alias("next_5yr_growth"),
        )

    # -- logs and text ---------------------------------------------------

    @cached_property
    def ingestion_log(self) -> DataFrame:
        return self.file("events").select(
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
            F.col("event_type").alias("data_type"),
            F.col("ts").alias("last_fetched"),
            F.when(F.col("event_type") == "error", "failed")
            .when(F.col("event_type") == "view", "skipped")
            .otherwise("success")
            .alias("status"),
            (F.col("event_id") % 500).alias("record_count"),
            F.col("value").alias("duration_ms"),
            "event_id",
        )

    @cached_property
    def query_log(self) -> DataFrame:
        return self.file("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("q "), "props").alias("user_query"),
            F.concat(
                F.lit("SELECT * FROM prices_daily WHERE ticker = 'U"),
                F.translate(F.col("user_id").cast("string"), "0123456789", "ABCDEFGHIJ"),
                F.lit("' OR ticker IN ('AA', 'U"),
                F.translate((F.col("user_id") % 7).cast("string"), "0123456789", "ABCDEFGHIJ"),
                F.lit("')"),
            ).alias("generated_sql"),
            (F.col("event_id") % 100).alias("row_count"),
            F.col("value").alias("execution_time_ms"),
            (F.col("event_type") == "purchase").alias("is_favorite"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), "props")).alias("error_message"),
            F.when(F.col("event_type") == "view", F.concat(F.lit("Note "), (F.col("event_id") % 50).cast("string"))).alias(
                "notes"
            ),
        )

    @cached_property
    def turns(self) -> DataFrame:
        return self.file("conversations")

    @cached_property
    def documents(self) -> DataFrame:
        return self.file("documents")
