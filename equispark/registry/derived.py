"""Fundamentals, earnings, analysts, technical indicators and exchange rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from equispark.operators import analyst, fundamentals, fx, technical
from equispark.operators.fundamentals import PEER_GROUPS
from equispark.registry.base import AS_OF, CALENDAR_DAY, Query

SYMBOLS = sorted({symbol for symbols in PEER_GROUPS.values() for symbol in symbols})
RATIOS = "ticker, date, net_margin, roe, roa, debt_ratio, cash_conversion, fcf_margin, asset_turnover, gross_margin, ebitda_margin"

# -- fundamentals ------------------------------------------------------------

FUNDAMENTALS = {
    "ratios_financial": Query(lambda t: t.ratios, f"SELECT {RATIOS} FROM t_ratios"),
    "growth_annual": Query(lambda t: t.growth, "SELECT * FROM t_growth"),
    "latest_price": Query(lambda t: fundamentals.latest_price(t.prices), "SELECT * FROM t_last_price"),
    "latest_financials": Query(lambda t: fundamentals.latest_financials(t.annual), "SELECT * FROM t_last_annual"),
    "trailing_dividends": Query(
        lambda t: fundamentals.trailing_dividends(t.dividends, AS_OF),
        "SELECT * FROM t_year_dividends",
        {"annual_dividend": 6},
    ),
    "implied_shares": Query(
        lambda t: fundamentals.implied_shares(t.metadata, t.prices),
        """SELECT ticker, marketCap, CASE WHEN price > 0 THEN marketCap / price END AS shares
           FROM t_metadata LEFT JOIN t_last_price USING (ticker)""",
    ),
    "valuation_metrics": Query(
        lambda t: t.valuation,
        "SELECT * FROM t_valuation",
        {"dividend_yield": 8, "payout_ratio": 6},
    ),
    "cap_class": Query(
        lambda t: fundamentals.classify_caps(t.metadata),
        """SELECT ticker, marketCap, CASE WHEN marketCap >= 10e9 THEN 'Large Cap' WHEN marketCap >= 2e9 THEN 'Mid Cap'
                  WHEN marketCap > 0 THEN 'Small Cap' ELSE 'Unknown' END AS cap_class FROM t_metadata""",
    ),
    "domain_margins": Query(
        lambda t: fundamentals.domain_margins(_with_currencies(t))
        .withColumn("net_margin", F.col("net_margin").cast("double"))
        .withColumn("operating_margin", F.col("operating_margin").cast("double")),
        """SELECT ticker, date,
                  CASE WHEN currency <> 'JPY' AND totalRevenue <> 0 THEN round_even(netIncome / totalRevenue, 4) END
                      AS net_margin,
                  CASE WHEN currency <> 'EUR' AND totalRevenue <> 0 THEN round_even(operatingIncome / totalRevenue, 4) END
                      AS operating_margin
           FROM t_annual JOIN t_metadata USING (ticker)""",
    ),
    "growth_rate_decimal": Query(
        lambda t: fundamentals.growth_rate_decimal(_income_pairs(t)).select(
            "ticker", "date", F.col("growth_rate").cast("double").alias("growth_rate"), "error"
        ),
        """SELECT ticker, date,
                  CASE WHEN currency <> 'JPY' THEN round_even((netIncome - prior_income) / prior_income, 4) END
                      AS growth_rate,
                  CASE WHEN currency = 'JPY' THEN 'currency mismatch' END AS error
           FROM t_growth JOIN t_metadata USING (ticker) WHERE prior_income IS NOT NULL""",
    ),
    "healthy_balance_sheet": Query(
        lambda t: fundamentals.healthy_balance_sheet(t.annual),
        """SELECT ticker, date,
                  coalesce(CASE WHEN totalAssets > 0 THEN totalLiabilities / totalAssets END < 0.6, FALSE) AS is_healthy
           FROM t_annual""",
    ),
    "peer_membership": Query(
        # Companies trade under the built-in symbols in turn, and stand in the groups of their symbol.
        lambda t: _listed(t).join(fundamentals.peer_membership(t.spark).withColumnRenamed("ticker", "symbol"), "symbol"),
        f"""SELECT s_name AS ticker, v.symbol, v.peer_group FROM supplier
            JOIN (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(SYMBOLS))}) n(i, symbol)
              ON s_suppkey % {len(SYMBOLS)} = i
            JOIN (VALUES {", ".join(f"('{s}', '{g}')" for g, own in PEER_GROUPS.items() for s in own)}) v(symbol, peer_group)
              ON v.symbol = n.symbol""",
    ),
    "peer_lookup": Query(
        lambda t: fundamentals.peer_lookup(t.peers, "europe"),
        "SELECT DISTINCT ticker FROM t_peers WHERE lower(peer_group) = 'europe'",
    ),
    "safe_divide": Query(
        lambda t: fundamentals.safe_ratios(t.annual),
        """SELECT ticker, date, CASE WHEN netIncome > 0 THEN totalRevenue / netIncome END AS positive_only,
                  totalRevenue / nullif(netIncome, 0) AS nonzero FROM t_annual""",
    ),
    "year_extract": Query(
        lambda t: t.of_year(1999).annual.select(
            "ticker", F.year("date").cast("bigint").alias("fiscal_year"), "totalRevenue"
        ),
        "SELECT ticker, year(date) AS fiscal_year, totalRevenue FROM t_annual WHERE year(date) = 1999",
    ),
}


def _with_currencies(t):
    """Statements with a currency per amount; yen companies report income in another one, euro companies operating income."""
    currencies = t.metadata.select("ticker", "currency")
    other = lambda code: F.when(F.col("currency") == code, F.lit("USD")).otherwise(F.col("currency"))
    return t.annual.join(currencies, "ticker").select(
        "*",
        F.col("currency").alias("revenue_currency"),
        other("JPY").alias("income_currency"),
        other("EUR").alias("operating_currency"),
    )


def _income_pairs(t):
    other = F.when(F.col("currency") == "JPY", F.lit("USD")).otherwise(F.col("currency"))
    return (
        t.growth.filter("prior_income IS NOT NULL")
        .join(t.metadata.select("ticker", "currency"), "ticker")
        .select(
            "ticker",
            "date",
            F.col("netIncome").alias("current"),
            F.col("prior_income").alias("previous"),
            F.col("currency").alias("current_currency"),
            other.alias("previous_currency"),
        )
    )


def _listed(t):
    symbol = F.get(F.array(*[F.lit(s) for s in SYMBOLS]), (F.col("s_suppkey") % len(SYMBOLS)).cast("int"))
    return t.file("supplier").select(F.col("s_name").alias("ticker"), symbol.alias("symbol"))


# -- earnings and analysts ---------------------------------------------------

ANALYSTS = {
    "earnings_history": Query(
        lambda t: analyst.earnings_history(t.earnings_raw),
        "SELECT * FROM t_earnings_raw WHERE report_date IS NOT NULL ORDER BY ticker, report_date DESC",
    ),
    "earnings_upcoming": Query(
        lambda t: analyst.earnings_upcoming(t.earnings_calendar, as_of=CALENDAR_DAY),
        "SELECT * FROM t_calendar WHERE earnings_date >= DATE '2001-07-15' ORDER BY earnings_date",
    ),
    "recommendation_scores": Query(
        lambda t: t.recommendations,
        "SELECT * FROM t_scores WHERE date IS NOT NULL",
    ),
    "price_target_upside": Query(
        lambda t: t.price_targets,
        "SELECT * FROM t_targets",
        {"target_mean": 4, "upside_pct": 4},
    ),
    "analyst_consensus": Query(
        lambda t: t.consensus,
        """SELECT *, CASE WHEN consensus_rating <= 1.5 THEN 'Strong Buy' WHEN consensus_rating <= 2.5 THEN 'Buy'
                  WHEN consensus_rating <= 3.5 THEN 'Hold' WHEN consensus_rating <= 4.5 THEN 'Sell'
                  WHEN consensus_rating > 4.5 THEN 'Strong Sell' END AS consensus_label
           FROM (SELECT *, strong_buy + buy + hold + sell + strong_sell AS total_analysts,
                        CAST(strong_buy + 2 * buy + 3 * hold + 4 * sell + 5 * strong_sell AS DOUBLE)
                            / nullif(strong_buy + buy + hold + sell + strong_sell, 0) AS consensus_rating
                 FROM t_consensus_raw)""",
    ),
    "growth_estimates_peg": Query(lambda t: t.growth_estimates, "SELECT * FROM t_growth_estimates"),
}

# -- technical ---------------------------------------------------------------

AVERAGES = ["sma_20", "sma_50", "sma_200", "ema_12", "ema_26"]
INDICATORS = {c: 4 for c in AVERAGES} | {
    c: 4
    for c in (
        "close",
        "rsi_14",
        "macd",
        "macd_signal",
        "macd_histogram",
        "bb_upper",
        "bb_middle",
        "bb_lower",
    )
}


def _indicator(name, columns, rounded):
    run = getattr(technical, name)
    sql = f"SELECT ticker, date, {', '.join(columns)} FROM t_indicators"
    return Query(lambda t: run(t.prices), sql, {c: 4 for c in columns} if rounded else {})


TECHNICAL = {
    "technical_indicators": Query(lambda t: t.indicators, "SELECT * FROM t_indicators", INDICATORS),
    "technical_sma": _indicator("technical_sma", AVERAGES[:3], True),
    "technical_ema": _indicator("technical_ema", AVERAGES[3:], True),
    "technical_ema_true": Query(
        lambda t: technical.ema_true(t.prices),
        "SELECT ticker, date, close, ema_true_12, ema_true_26 FROM t_ema_walk",
        {"close": 4, "ema_true_12": 4, "ema_true_26": 4},
    ),
    "technical_rsi": _indicator("technical_rsi", ["rsi_14"], True),
    "technical_macd": _indicator("technical_macd", ["macd", "macd_signal", "macd_histogram"], True),
    "technical_bollinger": _indicator("technical_bollinger", ["bb_upper", "bb_middle", "bb_lower"], True),
    "technical_volume": _indicator("technical_volume", ["volume_avg_20", "volume_ratio"], False),
    "technical_momentum": _indicator("technical_momentum", [f"pct_change_{n}d" for n in (1, 5, 20, 60, 252)], False),
    "technical_52w": _indicator(
        "technical_52w", ["week_52_high", "week_52_low", "pct_from_52w_high", "pct_from_52w_low"], False
    ),
    "ohlc_shape": Query(
        lambda t: technical.ohlc_shape(t.prices), "SELECT ticker, date, open, high, low, close FROM t_prices"
    ),
}

# -- exchange rates ------------------------------------------------------------

QUOTED = "(SELECT ticker, date, close, currency FROM t_prices JOIN t_metadata USING (ticker))"


def _quoted(t):
    return t.prices.select("ticker", "date", "close").join(t.metadata.select("ticker", "currency"), "ticker")


def _to_pounds(t):
    return _quoted(t).withColumn("target", F.lit("GBP"))


NEAREST_SQL = """
    SELECT base_currency, quote_currency, target AS date, rate, gap
    FROM (SELECT base_currency, quote_currency, date + CAST(s AS INT) AS target, rate, abs(s) AS gap,
                 row_number() OVER (PARTITION BY base_currency, quote_currency, date + CAST(s AS INT)
                                    ORDER BY abs(s), date) AS rn
          FROM t_rates, range(-7, 8) r(s))
    WHERE rn = 1"""

FX = {
    "fx_rate_exact": Query(
        lambda t: fx.fx_rate_exact(_quoted(t), t.rates, F.col("currency"), F.lit("USD"), F.col("date")),
        f"""SELECT ticker, date, close, currency,
                   coalesce(direct, 1e0 / nullif(opposite, 0), CASE WHEN currency = 'USD' THEN 1e0 END) AS fx_rate
            FROM {QUOTED} LEFT JOIN t_fx ON fx_from = currency AND fx_to = 'USD' AND fx_date = date""",
    ),
    "fx_rate_nearest": Query(
        lambda t: fx.fx_rate_nearest(_quoted(t), t.rates, F.col("currency"), F.lit("USD"), F.col("date")),
        f"""SELECT q.ticker, q.date, q.close, q.currency, rate AS fx_rate, CAST(gap AS BIGINT) AS gap_days
            FROM {QUOTED} q LEFT JOIN ({NEAREST_SQL}) n
              ON n.base_currency = q.currency AND n.quote_currency = 'USD' AND n.date = q.date""",
    ),
    "fx_convert": Query(
        lambda t: fx.fx_convert(_to_pounds(t), t.rates, "close", "currency", "target", "date"),
        f"""SELECT ticker, date, close, currency, target, route,
                   CASE route WHEN 'same' THEN close WHEN 'direct' THEN close * direct
                              WHEN 'inverse' THEN close / opposite
                              ELSE coalesce(usd * usd_out, usd / usd_in) END AS converted,
                   CASE WHEN route IS NULL THEN currency || '/' || target END AS error
            FROM (SELECT f.*, d.direct, d.opposite, o.direct AS usd_out, o.opposite AS usd_in,
                         coalesce(close * i.direct, close / i.opposite) AS usd,
                         CASE WHEN currency = target THEN 'same' WHEN d.direct IS NOT NULL THEN 'direct'
                              WHEN d.opposite IS NOT NULL THEN 'inverse'
                              WHEN currency <> 'USD' AND coalesce(i.direct, i.opposite) IS NOT NULL
                                   AND coalesce(o.direct, o.opposite) IS NOT NULL THEN 'cross' END AS route
                  FROM (SELECT *, 'GBP' AS target FROM {QUOTED}) f
                  LEFT JOIN t_fx d ON d.fx_from = currency AND d.fx_to = target AND d.fx_date = date
                  LEFT JOIN t_fx i ON i.fx_from = currency AND i.fx_to = 'USD' AND i.fx_date = date
                  LEFT JOIN t_fx o ON o.fx_from = 'USD' AND o.fx_to = target AND o.fx_date = date)""",
    ),
    "fx_money_convert": Query(
        lambda t: _money_rows(t),
        """SELECT ticker, date, amount, rate, error,
                  CASE WHEN rate > 0 THEN (q + CASE WHEN r > 500000 OR (r = 500000 AND q % 2 = 1) THEN 1 ELSE 0 END)
                       / 1e4 END AS converted
           FROM (SELECT *, (cents * 100 * CAST(rate * 1e6 AS BIGINT)) // 1000000 AS q,
                        (cents * 100 * CAST(rate * 1e6 AS BIGINT)) % 1000000 AS r,
                        CASE WHEN rate > 0 THEN NULL ELSE 'rate must be positive' END AS error
                 FROM (SELECT s_name AS ticker, d AS date, gross_c AS cents, gross_c / 1e2 AS amount,
                              CASE WHEN l_linenumber = 1 THEN 0e0 ELSE rate END AS rate
                       FROM t_lines JOIN supplier ON s_suppkey = l_suppkey
                       JOIN t_rates ON date = d AND base_currency = 'EUR'))""",
    ),
    "fx_cache_stats": Query(
        lambda t: fx.fx_cache_stats(t.rates),
        """SELECT count(*) AS total_rates, count(DISTINCT base_currency || '/' || quote_currency) AS pairs,
                  min(date) AS date_range_start, max(date) AS date_range_end FROM t_rates""",
    ),
    "fx_missing_pairs": Query(
        lambda t: fx.fx_missing_pairs(t.metadata, t.prices, t.rates),
        """SELECT currency, (SELECT min(date) FROM t_prices) AS start_date, (SELECT max(date) FROM t_prices) AS end_date,
                  currency IN ('EUR', 'GBP', 'JPY', 'CNY', 'CAD', 'AUD', 'CHF', 'HKD', 'SGD', 'KRW', 'INR') AS is_supported,
                  (SELECT count(*) FROM t_rates WHERE base_currency = currency AND quote_currency = 'USD') AS held_days,
                  (SELECT count(*) FROM t_rates WHERE base_currency = currency AND quote_currency = 'USD') = 0
                      AS is_missing
           FROM (SELECT DISTINCT currency FROM t_metadata WHERE currency <> 'USD')""",
    ),
    "fx_common_pairs": Query(
        lambda t: fx.fx_common_pairs(t.rates, AS_OF.replace(year=1999), AS_OF),
        """SELECT a || '/' || b AS pair, (SELECT count(*) FROM t_rates WHERE base_currency = a AND quote_currency = b
                                          AND date BETWEEN DATE '1999-11-04' AND DATE '2001-11-04') AS n_rates
           FROM (SELECT c AS a, 'USD' AS b FROM (VALUES ('EUR'), ('GBP'), ('JPY'), ('CNY'), ('CAD'), ('AUD'), ('CHF')) v(c)
                 UNION ALL
                 SELECT 'USD', c FROM (VALUES ('EUR'), ('GBP'), ('JPY'), ('CNY'), ('CAD'), ('AUD'), ('CHF')) v(c))""",
    ),
    "valuation_multicurrency": Query(
        lambda t: t.fx_valuation, "SELECT * FROM t_fx_valuation", {"dividend_yield_pct": 6}
    ),
    "market_cap_category_fx": Query(
        lambda t: t.fx_valuation.select("ticker", "local_currency", "market_cap_usd", "market_cap_category"),
        "SELECT ticker, local_currency, market_cap_usd, market_cap_category FROM t_fx_valuation",
    ),
}


def _money_rows(t):
    """Amounts of every sale at the day's euro rate; first lines get a zero rate."""
    euro = t.rates.filter("base_currency = 'EUR'").select(F.col("date").alias("d"), "rate")
    sales = t.lines.select("l_suppkey", "d", "gross_c", "l_linenumber").join(euro, "d").join(t.names, "l_suppkey")
    rows = sales.select(
        "ticker",
        F.col("d").alias("date"),
        (F.col("gross_c").cast("double") / 100).alias("amount"),
        F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("rate")).alias("rate"),
    )
    converted = fx.fx_money_convert(rows, "amount", "rate")
    return converted.withColumn("converted", F.col("converted").cast("double"))


QUERIES = FUNDAMENTALS | ANALYSTS | TECHNICAL | FX
