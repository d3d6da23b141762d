"""Exchange rates and currency-normalised valuation.

A rate table holds one row per (base, quote, date), so it is bounded by the
currency list times the calendar. Lookups are plain equi-joins on those three
columns: Spark broadcasts the rates when their measured size allows it and
otherwise splits hot (pair, date) keys through AQE.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equispark.functions.dates import parse_date
from equispark.functions.numeric import nonzero_div
from equispark.operators.fundamentals import (
    LARGE_CAP,
    MID_CAP,
    latest_financials,
    latest_price,
    trailing_dividends,
)

# Supported codes, and the majors whose dollar pairs are kept.
SUPPORTED_CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CNY", "CAD", "AUD", "CHF", "HKD", "SGD", "KRW", "INR")
MAJOR_CURRENCIES = ("EUR", "GBP", "JPY", "CNY", "CAD", "AUD", "CHF")
PIVOT = "USD"


def nearest_rates(rates: DataFrame, days: int) -> DataFrame:
    """Rates for every date within `days` of a quoted one: the nearest, the earlier on a tie.

    Spreading each quote over its few neighbouring days turns an as-of lookup
    into an equi-join and leaves the facts out of any per-pair window.
    """
    spread = rates.select(
        "base_currency",
        "quote_currency",
        F.col("date").alias("quoted"),
        "rate",
        F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("shift"),
    )
    # Twice the distance, plus one where the quote is the later of the two.
    order = F.abs("shift") * 2 + F.when(F.col("shift") < 0, 1).otherwise(0)
    return (
        spread.withColumn("date", F.date_add("quoted", F.col("shift")))
        .groupBy("base_currency", "quote_currency", "date")
        .agg(F.min_by("rate", order).alias("rate"), F.min(F.abs("shift")).cast("bigint").alias("gap_days"))
    )


def _both_ways(rates: DataFrame, prefix: str) -> DataFrame:
    """One row per ordered pair and date: the direct rate and the opposite one."""
    none, rate = F.lit(None).cast("double"), F.col("rate")
    ways = [("base_currency", "quote_currency", rate, none), ("quote_currency", "base_currency", none, rate)]
    names = [f"{prefix}_{c}" for c in ("base", "quote", "rate", "opposite")]
    sides = F.array(*[F.struct(F.col(a).alias(names[0]), F.col(b).alias(names[1]), x.alias(names[2]), y.alias(names[3])) for a, b, x, y in ways])
    both = rates.select(F.col("date").alias(f"{prefix}_date"), F.inline(sides))
    return both.groupBy(names[0], names[1], f"{prefix}_date").agg(F.max(names[2]).alias(names[2]), F.max(names[3]).alias(names[3]))


def _look_up(facts: DataFrame, rates: DataFrame, prefix: str, source: Column, target: Column, on: Column) -> DataFrame:
    table = _both_ways(rates, prefix)
    match = (
        (table[f"{prefix}_base"] == source) & (table[f"{prefix}_quote"] == target) & (table[f"{prefix}_date"] == on)
    )
    return facts.join(table, match, "left").drop(f"{prefix}_base", f"{prefix}_quote", f"{prefix}_date")


def fx_rate_exact(
    facts: DataFrame, rates: DataFrame, source: Column, target: Column, on: Column, name: str = "fx_rate"
) -> DataFrame:
    """Adds the rate of the day: quoted, else one over the opposite quote, else 1 for the same currency."""
    found = _look_up(facts, rates, "x", source, target, on)
    rate = F.coalesce("x_rate", nonzero_div(F.lit(1.0), "x_opposite"), F.when(source == target, 1.0))
    return found.withColumn(name, rate).drop("x_rate", "x_opposite")


def fx_rate_nearest(
    facts: DataFrame, rates: DataFrame, source: Column, target: Column, on: Column, days: int = 7
) -> DataFrame:
    """Adds the quoted rate nearest in time, at most `days` away, and its distance."""
    near = nearest_rates(rates, days).select(
        F.col("base_currency").alias("n_base"),
        F.col("quote_currency").alias("n_quote"),
        F.col("date").alias("n_date"),
        F.col("rate").alias("fx_rate"),
        "gap_days",
    )
    match = (near.n_base == source) & (near.n_quote == target) & (near.n_date == on)
    return facts.join(near, match, "left").drop("n_base", "n_quote", "n_date")


def fx_convert(
    facts: DataFrame, rates: DataFrame, amount: str, source: str, target: str, on: str, tolerance_days: int = 0
) -> DataFrame:
    """Adds `converted`, the `route` taken and the `error` where no route exists.

    Same currency, then the quote, then the opposite quote, then two such legs
    over the dollar. `tolerance_days` lets each quote be that far from the date.
    """
    table = nearest_rates(rates, tolerance_days) if tolerance_days else rates
    src, dst, day, value = F.col(source), F.col(target), F.col(on), F.col(amount)
    known = fx_routes(facts.select(src.alias("r_source"), dst.alias("r_target"), day.alias("r_date")).distinct(), table)
    found = facts.join(known, (src == F.col("r_source")) & (dst == F.col("r_target")) & (day == F.col("r_date")), "left")

    def leg(money: Column, p: str) -> Column:
        return F.coalesce(money * F.col(f"{p}_rate"), nonzero_div(money, f"{p}_opposite"))

    converted = (
        F.when(F.col("route") == "same", value)
        .when(F.col("route") == "direct", value * F.col("d_rate"))
        .when(F.col("route") == "inverse", value / F.nullif("d_opposite", F.lit(0.0)))
        .when(F.col("route") == "cross", leg(leg(value, "i"), "o"))
    )
    error = F.when(F.col("route").isNull(), F.concat_ws("/", src, dst))
    names = [*facts.columns, "route", "converted", "error"]
    return found.withColumn("converted", converted).withColumn("error", error).select(*names)


def fx_routes(asked: DataFrame, rates: DataFrame) -> DataFrame:
    """The route of each distinct (r_source, r_target, r_date) and the quotes of its legs.

    d is the pair itself, i the way into the dollar, o the way out of it. The
    three are rows of one lookup, so the rates are read once.
    """
    src, dst, pivot = F.col("r_source"), F.col("r_target"), F.lit(PIVOT)
    ways = {"d": (src, dst), "i": (src, pivot), "o": (pivot, dst)}
    legs = F.array(*[F.struct(F.lit(p).alias("leg"), a.alias("a"), b.alias("b")) for p, (a, b) in ways.items()])
    keys = ["r_source", "r_target", "r_date"]
    rows = asked.select(*keys, F.inline(legs))
    quotes = _look_up(rows, rates, "q", F.col("a"), F.col("b"), F.col("r_date"))
    picks = [
        F.max(F.when(F.col("leg") == p, F.col(f"q_{c}"))).alias(f"{p}_{c}") for p in ways for c in ("rate", "opposite")
    ]
    resolved = quotes.groupBy(*keys).agg(*picks)
    has = lambda p: F.col(f"{p}_rate").isNotNull() | F.nullif(f"{p}_opposite", F.lit(0.0)).isNotNull()
    route = (
        F.when(src == dst, "same")
        .when(F.col("d_rate").isNotNull(), "direct")
        .when(F.nullif("d_opposite", F.lit(0.0)).isNotNull(), "inverse")
        .when((src != pivot) & (dst != pivot) & has("i") & has("o"), "cross")
    )
    return resolved.withColumn("route", route)


def fx_money_convert(facts: DataFrame, amount: str, rate: str) -> DataFrame:
    """Adds the amount at a positive rate of up to 18 places, only the product rounded to four; other rates are reported.

    The rate is split into its whole and its broken part, whose products with an
    amount below 10^15 are exact; the half that decides the fourth place goes to
    the even side. Amounts and rates that do not fit are reported, not raised.
    """
    money, factor, broken, beyond, ticks, product = ("_" * max(map(len, facts.columns)) + f"_{i}" for i in range(6))
    tick, half = F.lit("0.0001").cast("decimal(4,4)"), F.lit("0.00005").cast("decimal(5,5)")
    # One step a column: each is computed once, and the code generated for a row stays small enough to be compiled.
    steps = facts.withColumns(
        {money: F.col(amount).try_cast("decimal(19,4)"), factor: F.when(F.col(rate) > 0, F.col(rate).try_cast("decimal(38,18)"))}
    )
    steps = steps.withColumn(broken, F.col(money) * (F.col(factor) % F.lit(1).cast("decimal(1,0)")).cast("decimal(18,18)"))
    steps = steps.withColumn(beyond, F.col(broken) % tick)
    cut = ((F.col(broken) - F.col(beyond)).cast("decimal(20,4)") * 10000).cast("decimal(20,0)")
    whole = F.floor(factor).cast("decimal(20,0)")
    steps = steps.withColumn(ticks, F.try_add(F.try_multiply((F.col(money) * 10000).cast("decimal(19,0)"), whole), cut))
    rest = F.abs(beyond)
    up = (rest > half) | ((rest == half) & (F.abs(ticks) % 2 == 1))
    rounded = F.try_add(ticks, F.when(up, F.when(F.col(money) < 0, -1).otherwise(1)).otherwise(0))
    steps = steps.withColumn(product, F.try_multiply(rounded, tick).cast("decimal(38,4)"))
    error = (
        F.when(F.col(rate).isNull() | (F.col(rate) <= 0), "rate must be positive")
        .when(F.col(amount).isNotNull() & F.col(product).isNull(), "out of range")
    )
    out = steps.withColumn("error", error).withColumn("converted", F.when(F.col("error").isNull(), F.col(product)))
    return out.drop(money, factor, broken, beyond, ticks, product)


def fx_cache_stats(rates: DataFrame) -> DataFrame:
    pair = F.concat_ws("/", "base_currency", "quote_currency")
    return rates.agg(
        F.count("*").alias("total_rates"),
        F.countDistinct(pair).alias("pairs"),
        F.min("date").alias("date_range_start"),
        F.max("date").alias("date_range_end"),
    )


def fx_missing_pairs(metadata: DataFrame, prices: DataFrame, rates: DataFrame) -> DataFrame:
    """Dollar pairs the companies need: date range, support and days held already."""
    needed = metadata.select("currency").filter("currency IS NOT NULL AND currency <> 'USD'").distinct()
    span = prices.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    held = (
        rates.filter("quote_currency = 'USD'")
        .groupBy(F.col("base_currency").alias("currency"))
        .agg(F.count("*").alias("held_days"))
    )
    return needed.join(held, "currency", "left").select(
        "currency",
        span.select("first").scalar().alias("start_date"),
        span.select("last").scalar().alias("end_date"),
        F.col("currency").isin(*SUPPORTED_CURRENCIES).alias("is_supported"),
        F.coalesce("held_days", F.lit(0)).alias("held_days"),
        F.col("held_days").isNull().alias("is_missing"),
    )


def fx_common_pairs(rates: DataFrame, start: date, end: date) -> DataFrame:
    """Quotes held per direction of the major dollar pairs, zero included."""
    pairs = [(c, PIVOT) for c in MAJOR_CURRENCIES] + [(PIVOT, c) for c in MAJOR_CURRENCIES]
    wanted = rates.sparkSession.createDataFrame(pairs, "base_currency string, quote_currency string")
    held = (
        rates.filter(F.col("date").between(F.lit(start), F.lit(end)))
        .groupBy("base_currency", "quote_currency")
        .agg(F.count("*").alias("n"))
    )
    return wanted.join(held, ["base_currency", "quote_currency"], "left").select(
        F.concat_ws("/", "base_currency", "quote_currency").alias("pair"), F.coalesce("n", F.lit(0)).alias("n_rates")
    )


def market_cap_category(cap: Column) -> Column:
    """Cap class in base currency; without a rate the class is Small Cap."""
    return F.when(cap >= LARGE_CAP, "Large Cap").when(cap >= MID_CAP, "Mid Cap").otherwise("Small Cap")


def prep_rates(documents: DataFrame) -> DataFrame:
    """Rate documents as rows of the rate table, the highest rate of repeated keys; without a date or rate they go."""
    rows = documents.select(
        F.upper("base_currency").alias("base_currency"),
        F.upper("quote_currency").alias("quote_currency"),
        parse_date("date").alias("date"),
        F.expr("try_cast(rate AS double)").alias("rate"),
        F.col("source").cast("string").alias("source"),
    ).filter("date IS NOT NULL AND rate IS NOT NULL")
    keys = ("base_currency", "quote_currency", "date")
    return rows.groupBy(*keys).agg(F.max("rate").alias("rate"), F.max("source").alias("source"))


def valuation_multicurrency(
    prices: DataFrame,
    annual: DataFrame,
    dividends: DataFrame,
    metadata: DataFrame,
    rates: DataFrame,
    *,
    as_of: date,
    base: str = "USD",
) -> DataFrame:
    """Local and base-currency values with currency-neutral multiples.

    The rate is looked up once per company and reused by every converted
    column. Negative earnings keep their sign in the multiples.
    """
    company = metadata.filter("currency IS NOT NULL").select("ticker", "currency", "sharesOutstanding")
    snapshot = (
        latest_price(prices)
        .join(latest_financials(annual), "ticker")
        .join(company, "ticker")
        .join(trailing_dividends(dividends, as_of), "ticker", "left")
    )
    rated = fx_rate_exact(snapshot, rates, F.col("currency"), F.lit(base), F.col("price_date"))
    cap = F.col("price") * F.col("sharesOutstanding")
    local = {
        "price": F.col("price"),
        "market_cap": cap,
        "revenue": F.col("totalRevenue"),
        "net_income": F.col("netIncome"),
        "equity": F.col("shareholderEquity"),
    }
    suffix = base.lower()
    eps = nonzero_div("netIncome", F.col("sharesOutstanding").cast("double"))
    return rated.select(
        "ticker",
        "price_date",
        "fiscal_date",
        F.col("currency").alias("local_currency"),
        F.lit(base).alias("base_currency"),
        *[value.alias(f"{name}_local") for name, value in local.items()],
        "fx_rate",
        *[(value * F.col("fx_rate")).alias(f"{name}_{suffix}") for name, value in local.items()],
        nonzero_div(cap, "netIncome").alias("pe_ratio"),
        nonzero_div(cap, "totalRevenue").alias("ps_ratio"),
        nonzero_div(cap, "shareholderEquity").alias("pb_ratio"),
        nonzero_div("price", eps).alias("price_to_eps"),
        F.when(F.col("price") > 0, F.col("annual_dividend") / F.col("price") * 100).alias("dividend_yield_pct"),
        market_cap_category(cap * F.col("fx_rate")).alias("market_cap_category"),
    )
