"""Aggregates, series, templates, screens and portfolio reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from equispark.operators import aggregates, portfolio, screens, series
from equispark.plans.templates import capped_result, run_template
from equispark.registry.base import AS_OF, CALENDAR_DAY, Query

SUBJECT = "Supplier#000000002"
TRIO = ("Supplier#000000001", "Supplier#000000002", "Supplier#000000003")
TRIO_SQL = "('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000003')"

CHOSEN = tuple(f"Supplier#{i:09}" for i in range(10))

# -- aggregates ----------------------------------------------------------------

AGGREGATES = {
    "agg_pe_by_sector": Query(
        lambda t: aggregates.pe_by_sector(t.valuation, t.metadata),
        """SELECT sector, avg(pe_ratio) AS avg_pe, count(pe_ratio) AS companies
           FROM t_valuation JOIN t_metadata USING (ticker) GROUP BY sector""",
        {"avg_pe": 6},
    ),
    "agg_cap_by_industry": Query(
        lambda t: aggregates.cap_by_industry(t.metadata),
        "SELECT industry, sum(marketCap) AS total_market_cap FROM t_metadata GROUP BY industry",
        {"total_market_cap": 0},
    ),
    "agg_median_growth": Query(
        lambda t: aggregates.median_growth(t.growth, t.metadata),
        """SELECT sector, median(revenue_growth_yoy) AS median_growth
           FROM t_growth JOIN t_metadata USING (ticker) WHERE revenue_growth_yoy IS NOT NULL GROUP BY sector""",
        {"median_growth": 8},
    ),
    "agg_group_avg_roe": Query(
        lambda t: aggregates.group_avg_roe(t.ratios, t.peers, ["EUROPE", "NATION_3"]),
        """SELECT date, avg(CASE WHEN peer_group = 'EUROPE' THEN roe END) AS roe_0,
                  avg(CASE WHEN peer_group = 'NATION_3' THEN roe END) AS roe_1
           FROM t_ratios JOIN t_peers USING (ticker) WHERE peer_group IN ('EUROPE', 'NATION_3') GROUP BY date""",
        {"roe_0": 8, "roe_1": 8},
    ),
    "agg_group_vs_group_estimates": Query(
        lambda t: aggregates.group_estimates(t.growth_estimates_raw, t.peers),
        """SELECT peer_group, avg(current_year_growth) AS avg_current_year, avg(next_5yr_growth) AS avg_next_5yr,
                  count(*) AS n
           FROM t_growth_estimates_raw JOIN t_peers USING (ticker) GROUP BY peer_group""",
        {"avg_current_year": 6, "avg_next_5yr": 6},
    ),
    "agg_sector_relative": Query(
        lambda t: aggregates.sector_relative(t.valuation, t.metadata),
        """SELECT ticker, sector, ps_ratio, avg(ps_ratio) OVER (PARTITION BY sector) AS sector_avg,
                  ps_ratio / nullif(avg(ps_ratio) OVER (PARTITION BY sector), 0) AS relative
           FROM t_valuation JOIN t_metadata USING (ticker)""",
        {"sector_avg": 6, "relative": 6},
    ),
    "agg_describe": Query(
        lambda t: aggregates.describe(t.annual, ["totalRevenue", "netIncome", "freeCashFlow"]),
        """SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
                  quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
                  max(value) AS max
           FROM (SELECT 'totalRevenue' AS column_name, totalRevenue AS value FROM t_annual
                 UNION ALL SELECT 'netIncome', netIncome FROM t_annual
                 UNION ALL SELECT 'freeCashFlow', freeCashFlow FROM t_annual) GROUP BY column_name""",
        {"mean": 2, "std": 2, "p25": 2, "p50": 2, "p75": 2},
    ),
    "agg_correlation": Query(
        lambda t: aggregates.return_correlation(t.prices, SUBJECT),
        f"""SELECT a.ticker, corr(a.ret, b.ret) AS correlation, count(*) AS days
            FROM t_returns a JOIN t_returns b ON b.date = a.date AND b.ticker = '{SUBJECT}'
            WHERE a.ticker <> '{SUBJECT}' GROUP BY a.ticker""",
        {"correlation": 6},
    ),
    "agg_correlation_pairs": Query(
        lambda t: aggregates.pair_correlation(t.prices, CHOSEN),
        f"""SELECT a.ticker, b.ticker AS other, corr(a.ret, b.ret) AS correlation, count(*) AS days
            FROM t_returns a JOIN t_returns b ON b.date = a.date AND b.ticker > a.ticker
            WHERE a.ticker IN {CHOSEN} AND b.ticker IN {CHOSEN} GROUP BY 1, 2""",
        {"correlation": 6},
    ),
    "agg_min_max_date": Query(
        lambda t: aggregates.date_span(t.prices),
        "SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM t_prices GROUP BY ticker",
    ),
    "union_distinct": Query(
        lambda t: aggregates.union_distinct(t.dividends.select("ticker", "date"), t.splits.select("ticker", "date")),
        "SELECT ticker, date FROM t_dividends UNION SELECT ticker, date FROM t_splits",
    ),
}

# -- series --------------------------------------------------------------------

SERIES = {
    "win_rank_revenue": Query(
        lambda t: series.rank_revenue(t.annual),
        """SELECT * FROM (SELECT ticker, year(date) AS fiscal_year, totalRevenue,
                                 rank() OVER (PARTITION BY year(date) ORDER BY totalRevenue DESC) AS revenue_rank,
                                 dense_rank() OVER (PARTITION BY year(date) ORDER BY totalRevenue DESC)
                                     AS revenue_dense_rank FROM t_annual)
           WHERE revenue_rank <= 10""",
    ),
    "win_lag_lead": Query(
        lambda t: series.lag_lead(t.annual),
        """SELECT ticker, date, totalRevenue, lag(totalRevenue) OVER w AS prior_revenue,
                  lead(totalRevenue) OVER w AS next_revenue
           FROM t_annual WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    ),
    "win_moving_avg_3": Query(
        lambda t: series.moving_avg(t.annual),
        """SELECT ticker, date, totalRevenue, avg(totalRevenue) OVER (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING)
                      AS revenue_avg FROM t_annual""",
        {"revenue_avg": 3},
    ),
    "win_top_quartile": Query(
        lambda t: series.top_quartile(t.of_year(2000).ratios, 2000),
        """SELECT * FROM (SELECT ticker, date, roe, ntile(4) OVER (ORDER BY roe DESC, ticker) AS quartile
                          FROM t_ratios WHERE year(date) = 2000 AND roe IS NOT NULL) WHERE quartile = 1""",
    ),
    "win_volatility": Query(
        lambda t: series.volatility(t.prices, t.metadata, SUBJECT),
        f"""SELECT ticker, date, stddev_samp(ret) OVER (w ROWS 29 PRECEDING) AS vol_30,
                   stddev_samp(ret) OVER (w ROWS 89 PRECEDING) AS vol_90,
                   stddev_samp(ret) OVER (w ROWS 251 PRECEDING) AS vol_252
            FROM t_returns
            WHERE ticker = '{SUBJECT}' OR ticker IN
                (SELECT ticker FROM t_metadata WHERE ticker <> '{SUBJECT}'
                   AND sector = (SELECT sector FROM t_metadata WHERE ticker = '{SUBJECT}')
                 ORDER BY marketCap DESC, ticker LIMIT 3)
            WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
        {"vol_30": 6, "vol_90": 6, "vol_252": 6},
    ),
    "win_qoq_growth": Query(
        lambda t: series.qoq_growth(t.quarterly),
        """SELECT ticker, date, totalRevenue, prior_quarter,
                  CASE WHEN prior_quarter > 0 THEN (totalRevenue - prior_quarter) / prior_quarter END AS qoq_growth
           FROM (SELECT *, lag(totalRevenue) OVER (PARTITION BY ticker ORDER BY date) AS prior_quarter
                 FROM t_quarterly)""".replace("SELECT *,", "SELECT ticker, date, totalRevenue,"),
    ),
    "win_streak_dividends": Query(
        lambda t: series.dividend_streaks(_whole_dividends(t), min_years=3),
        """SELECT ticker, sum(1 - broke) AS raises, max(y) AS last_year
           FROM (SELECT *, sum(broke) OVER (PARTITION BY ticker ORDER BY y) AS run
                 FROM (SELECT *, CASE WHEN paid > lag(paid) OVER w AND y = lag(y) OVER w + 1 THEN 0 ELSE 1 END AS broke
                       FROM (SELECT ticker, year(date) AS y, sum(CAST(round(amount * 100) AS BIGINT)) AS paid
                             FROM t_dividends GROUP BY 1, 2)
                       WINDOW w AS (PARTITION BY ticker ORDER BY y)))
           GROUP BY ticker, run HAVING sum(1 - broke) >= 3""",
    ),
    "win_improving_margin": Query(
        lambda t: series.improving_margin(t.ratios),
        """SELECT ticker, date, net_margin, margin_1y, margin_2y
           FROM (SELECT *, lag(net_margin) OVER w AS margin_1y, lag(net_margin, 2) OVER w AS margin_2y,
                        max(date) OVER (PARTITION BY ticker) AS newest
                 FROM t_ratios WINDOW w AS (PARTITION BY ticker ORDER BY date))
           WHERE date = newest AND net_margin > margin_1y AND margin_1y > margin_2y""",
    ),
    "win_total_return": Query(
        lambda t: series.total_return(t.prices, date(2000, 1, 1), date(2000, 12, 31)),
        """SELECT *, CASE WHEN first_close > 0 THEN (last_close - first_close) / first_close END * 100 AS return_pct
           FROM (SELECT ticker, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close FROM t_prices
                 WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY ticker)""",
    ),
}


def _whole_dividends(t):
    """Dividends in whole cents, so that equal years compare as equal."""
    return t.dividends.withColumn("amount", F.round(F.col("amount") * 100).cast("bigint"))


# -- templates -----------------------------------------------------------------


def _template(name, sql, rounded=None, **params):
    return Query(lambda t: run_template(t, name, params), sql, rounded or {})


TEMPLATES = {
    "tpl_top_revenue": _template(
        "top_revenue",
        """SELECT ticker, date, totalRevenue FROM t_annual WHERE year(date) = 2000
           ORDER BY totalRevenue DESC, ticker LIMIT 10""",
        year=2000,
    ),
    "tpl_ticker_comparison": _template(
        "ticker_comparison",
        f"SELECT ticker, date, netIncome FROM t_annual WHERE ticker IN {TRIO_SQL} ORDER BY date DESC, ticker LIMIT 25",
        metric="netincome",
        tickers=TRIO,
    ),
    "tpl_revenue_trends": _template(
        "revenue_trends",
        f"""SELECT ticker, date, totalRevenue FROM t_annual WHERE ticker = '{SUBJECT}' AND date >= DATE '1997-01-01'
            ORDER BY date DESC LIMIT 10""",
        ticker=SUBJECT,
        start_date=date(1997, 1, 1),
    ),
    "tpl_profit_margins": _template(
        "profit_margins",
        f"""SELECT ticker, date, net_margin, gross_margin FROM t_ratios WHERE ticker IN {TRIO_SQL}
            ORDER BY date DESC, ticker LIMIT 25""",
        tickers=TRIO,
    ),
    "tpl_peer_group_comparison": _template(
        "peer_group_comparison",
        """SELECT ticker, date, totalRevenue FROM t_annual JOIN t_peers USING (ticker)
           WHERE peer_group = 'EUROPE' AND year(date) = 1999 ORDER BY totalRevenue DESC, ticker LIMIT 25""",
        metric="totalRevenue",
        peer_group="EUROPE",
        year=1999,
    ),
    "tpl_top_roe": _template(
        "top_roe",
        """SELECT ticker, date, roe FROM t_ratios WHERE date >= DATE '1998-01-01'
           ORDER BY roe DESC NULLS LAST, ticker, date LIMIT 10""",
        start_date=date(1998, 1, 1),
    ),
    "tpl_dividend_history": _template(
        "dividend_history",
        f"SELECT ticker, date, amount FROM t_dividends WHERE ticker = '{SUBJECT}' ORDER BY date DESC LIMIT 25",
        ticker=SUBJECT,
    ),
    "tpl_stock_price_range": _template(
        "stock_price_range",
        f"""SELECT ticker, date, close, volume FROM t_prices WHERE ticker = '{SUBJECT}'
            AND date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31' ORDER BY date DESC LIMIT 100""",
        ticker=SUBJECT,
        start_date=date(1999, 1, 1),
        end_date=date(2000, 12, 31),
    ),
    "tpl_growth_leaders": _template(
        "growth_leaders",
        """SELECT ticker, date, revenue_growth_yoy FROM t_growth
           WHERE date >= DATE '1998-01-01' AND revenue_growth_yoy IS NOT NULL
           ORDER BY revenue_growth_yoy DESC, ticker, date LIMIT 10""",
        start_date=date(1998, 1, 1),
    ),
    "tpl_sector_analysis": _template(
        "sector_analysis",
        """SELECT sector, avg(totalRevenue) AS avg_revenue, avg(net_margin) AS avg_margin, count(*) AS company_count
           FROM t_annual a JOIN t_metadata m USING (ticker) LEFT JOIN t_ratios r USING (ticker, date)
           WHERE year(a.date) = 2000 GROUP BY sector ORDER BY avg_revenue DESC, sector LIMIT 15""",
        {"avg_revenue": 2, "avg_margin": 8},
        year=2000,
    ),
    "run_template": _template(
        "top_revenue",
        """SELECT ticker, date, totalRevenue FROM t_annual WHERE year(date) = 1999
           ORDER BY totalRevenue DESC, ticker LIMIT 3""",
        year=1999,
        limit=3,
        note="not a parameter",
    ),
    "capped_result": Query(
        lambda t: capped_result(t.prices.orderBy("date", "ticker"), limit=1000),
        "SELECT * FROM t_prices ORDER BY date, ticker LIMIT 1000",
    ),
}

# -- screens -------------------------------------------------------------------

FUNNEL_SQL = """
    SELECT m.* FROM t_metadata m
    WHERE sector = 'EUROPE' AND ticker IN (SELECT ticker FROM t_valuation WHERE pe_ratio < 30000)
      AND ticker IN (SELECT ticker FROM t_scores WHERE to_grade = 'Buy')"""


def _last(columns, where):
    return f"SELECT ticker, date, {columns} FROM t_last_bar WHERE {where}"


def _round4(*columns):
    return {c: 4 for c in columns}


SCREENS = {
    "screen_value": Query(
        lambda t: screens.screen_value(t.valuation, t.metadata, 20000, 3000),
        """SELECT ticker, sector, pe_ratio, pb_ratio FROM t_valuation JOIN t_metadata USING (ticker)
           WHERE pe_ratio < 20000 AND pb_ratio < 3000""",
    ),
    "screen_peg": Query(
        lambda t: screens.screen_peg(t.valuation, 10000),
        """SELECT ticker, peg_ratio, market_cap FROM t_valuation
           WHERE cap_class = 'Large Cap' AND peg_ratio < 10000""",
    ),
    "screen_multi_currency_value": Query(
        lambda t: screens.screen_multi_currency_value(t.fx_valuation, 15, 2, 0.01, 1000),
        """SELECT ticker, local_currency, pe_ratio, pb_ratio, dividend_yield_pct,
                  market_cap_usd / 1e9 AS market_cap_billions
           FROM t_fx_valuation
           WHERE pe_ratio < 15 AND pb_ratio < 2 AND dividend_yield_pct > 0.01 AND market_cap_usd > 1000
           ORDER BY pe_ratio, ticker LIMIT 20""",
        {"dividend_yield_pct": 6},
    ),
    "screen_high_yield_non_base": Query(
        lambda t: screens.screen_high_yield_non_base(t.fx_valuation, 0.08),
        """SELECT ticker, local_currency, dividend_yield_pct, pe_ratio FROM t_fx_valuation
           WHERE dividend_yield_pct > 0.08 AND local_currency <> 'USD'""",
        {"dividend_yield_pct": 6},
    ),
    "screen_quality": Query(
        lambda t: screens.screen_quality(t.annual, t.ratios, t.growth),
        """SELECT ticker, date, freeCashFlow, roe, debt_ratio, revenue_growth_yoy
           FROM t_annual JOIN t_ratios USING (ticker, date) JOIN t_growth USING (ticker, date)
           WHERE freeCashFlow > 0 AND roe > 0.2 AND debt_ratio < 0.4 AND revenue_growth_yoy > 0""",
    ),
    "screen_low_debt": Query(
        lambda t: screens.screen_low_debt(t.ratios),
        "SELECT ticker, date, debt_ratio FROM t_ratios WHERE debt_ratio < 0.3",
    ),
    "screen_funnel": Query(
        lambda t: screens.screen_funnel(
            t.metadata, t.valuation, t.recommendations, sector="EUROPE", max_pe=30000, to_grade="Buy"
        ),
        FUNNEL_SQL,
    ),
    "screen_above_sma200": Query(
        lambda t: screens.screen_above_sma200(t.indicators),
        _last("close, sma_200", "close > sma_200"),
        _round4("close", "sma_200"),
    ),
    "screen_sma50_cross": Query(
        lambda t: screens.screen_sma50_cross(t.indicators, as_of=AS_OF, days=60),
        """SELECT ticker, date, close, sma_50
           FROM (SELECT *, lag(close > sma_50) OVER (PARTITION BY ticker ORDER BY date) AS was_above FROM t_indicators)
           WHERE close > sma_50 AND NOT was_above AND date >= DATE '2001-11-04' - 60""",
        _round4("close", "sma_50"),
    ),
    "screen_golden_cross": Query(
        lambda t: screens.screen_golden_cross(t.indicators),
        _last("sma_50, sma_200", "sma_50 > sma_200"),
        _round4("sma_50", "sma_200"),
    ),
    "screen_macd_bullish": Query(
        lambda t: screens.screen_macd_bullish(t.indicators),
        _last("macd, macd_signal", "macd > macd_signal"),
        _round4("macd", "macd_signal"),
    ),
    "screen_momentum": Query(
        lambda t: screens.screen_momentum(t.indicators),
        _last("close, pct_change_20d", "pct_change_20d > 10"),
    ),
    "screen_near_52w_high": Query(
        lambda t: screens.screen_near_52w_high(t.indicators, 60),
        _last("close, week_52_high, pct_from_52w_high", "pct_from_52w_high >= -60"),
    ),
    "screen_rsi": Query(
        lambda t: screens.screen_rsi(t.indicators, 45, 55),
        _last(
            "rsi_14, CASE WHEN rsi_14 < 45 THEN 'oversold' ELSE 'overbought' END AS signal", "rsi_14 < 45 OR rsi_14 > 55"
        ),
        _round4("rsi_14"),
    ),
    "screen_bollinger_squeeze": Query(
        lambda t: screens.screen_bollinger_squeeze(t.indicators),
        """SELECT ticker, date, band_width, width_rank
           FROM (SELECT *, percent_rank() OVER (PARTITION BY ticker ORDER BY band_width) AS width_rank,
                        max(date) OVER (PARTITION BY ticker) AS newest
                 FROM (SELECT ticker, date, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS band_width FROM t_indicators)
                 WHERE band_width IS NOT NULL)
           WHERE date = newest AND width_rank <= 0.1""",
        {"band_width": 4, "width_rank": 6},
    ),
    "screen_pullback": Query(
        lambda t: screens.screen_pullback(t.indicators, 50),
        _last("close, sma_200, rsi_14", "rsi_14 < 50 AND close > sma_200"),
        _round4("close", "sma_200", "rsi_14"),
    ),
    "screen_confirmed_momentum": Query(
        lambda t: screens.screen_confirmed_momentum(t.indicators),
        """SELECT ticker, date, rsi_14, macd, macd_signal, pct_change_20d, sma_50, p.close AS current_price
           FROM t_indicators i JOIN t_prices p USING (ticker, date)
           WHERE pct_change_20d > 10 AND rsi_14 < 70 AND macd > macd_signal AND p.close > sma_50
           ORDER BY pct_change_20d DESC, ticker, date LIMIT 20""",
        _round4("rsi_14", "macd", "macd_signal", "sma_50"),
    ),
    "screen_drop_with_growth": Query(
        lambda t: screens.screen_drop_with_growth(t.indicators, t.growth),
        """SELECT ticker, pct_change_20d, income_growth_yoy FROM t_last_bar
           JOIN (SELECT ticker, arg_max(income_growth_yoy, date) AS income_growth_yoy FROM t_growth
                 WHERE income_growth_yoy IS NOT NULL GROUP BY ticker) USING (ticker)
           WHERE pct_change_20d < -10 AND income_growth_yoy > 0""",
    ),
    "screen_beat_estimates": Query(
        lambda t: screens.screen_beat_estimates(t.earnings, as_of=AS_OF),
        """SELECT ticker, report_date, eps_actual, eps_estimate, surprise_pct
           FROM (SELECT * FROM t_earnings_raw WHERE report_date <= DATE '2001-11-04'
                 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY report_date DESC) = 1)
           WHERE eps_actual > eps_estimate""",
    ),
    "screen_consistent_beats": Query(
        lambda t: screens.screen_consistent_beats(t.earnings, 0.5),
        """SELECT ticker, avg(CASE WHEN eps_actual > eps_estimate THEN 1e0 ELSE 0e0 END) AS beat_share, count(*) AS reports
           FROM t_earnings_raw WHERE eps_actual IS NOT NULL AND eps_estimate IS NOT NULL
           GROUP BY ticker HAVING avg(CASE WHEN eps_actual > eps_estimate THEN 1e0 ELSE 0e0 END) > 0.5""",
    ),
    "surprise_history": Query(
        lambda t: screens.surprise_history(t.earnings, SUBJECT, as_of=AS_OF),
        f"""SELECT ticker, report_date, eps_estimate, eps_actual, surprise_pct FROM t_earnings_raw
            WHERE ticker = '{SUBJECT}' AND report_date BETWEEN DATE '1999-11-04' AND DATE '2001-11-04'""",
    ),
    "earnings_this_week": Query(
        lambda t: screens.earnings_this_week(t.earnings_calendar, as_of=CALENDAR_DAY),
        "SELECT * FROM t_calendar WHERE earnings_date BETWEEN DATE '2001-07-15' AND DATE '2001-07-22'",
    ),
    "screen_upside": Query(
        lambda t: screens.screen_upside(t.price_targets),
        "SELECT ticker, current_price, target_mean, upside_pct FROM t_targets WHERE upside_pct >= 20",
        {"target_mean": 4, "upside_pct": 4},
    ),
    "screen_upgrades": Query(
        lambda t: screens.screen_upgrades(t.recommendations, as_of=CALENDAR_DAY),
        """SELECT ticker, date, firm, to_grade FROM t_scores
           WHERE action_score = 1 AND date BETWEEN DATE '2001-07-15' - 90 AND DATE '2001-07-15'""",
    ),
    "screen_downgrades": Query(
        lambda t: screens.screen_downgrades(t.recommendations, as_of=CALENDAR_DAY),
        """SELECT ticker, date, firm, to_grade FROM t_scores
           WHERE action_score = -1 AND date BETWEEN DATE '2001-07-15' - 90 AND DATE '2001-07-15'""",
    ),
    "bullish_firms": Query(
        lambda t: screens.bullish_firms(t.recommendations, t.metadata, "EUROPE"),
        """SELECT firm, avg(action_score) AS mean_score, count(*) AS actions FROM t_scores
           WHERE ticker IN (SELECT ticker FROM t_metadata WHERE sector = 'EUROPE') GROUP BY firm""",
    ),
    "screen_growth_estimate": Query(
        lambda t: screens.screen_growth_estimate(t.growth_estimates_raw),
        "SELECT ticker, date, next_5yr_growth FROM t_growth_estimates_raw WHERE next_5yr_growth > 20",
    ),
    "estimate_revisions": Query(
        lambda t: screens.estimate_revisions(t.growth_estimates_raw, "next_5yr_growth"),
        """SELECT * FROM (SELECT ticker, date, next_5yr_growth AS estimate,
                                 lag(next_5yr_growth) OVER (PARTITION BY ticker ORDER BY date) AS previous
                          FROM t_growth_estimates_raw) WHERE estimate > previous""",
    ),
    "peer_rank": Query(
        lambda t: screens.peer_rank(t.of_year(2000).ratios, t.peers, "net_margin", 2000),
        """SELECT peer_group, ticker, date, net_margin,
                  rank() OVER (PARTITION BY peer_group ORDER BY net_margin DESC, ticker) AS peer_rank
           FROM t_ratios JOIN t_peers USING (ticker) WHERE year(date) = 2000 AND net_margin IS NOT NULL""",
    ),
    "peer_rank_growth": Query(
        # Growth looks a year back, so it is ranked over the table of all years.
        lambda t: screens.peer_rank(t.growth, t.peers, "revenue_growth_yoy", 2000),
        """SELECT peer_group, ticker, date, revenue_growth_yoy,
                  rank() OVER (PARTITION BY peer_group ORDER BY revenue_growth_yoy DESC, ticker) AS peer_rank
           FROM t_growth JOIN t_peers USING (ticker) WHERE year(date) = 2000 AND revenue_growth_yoy IS NOT NULL""",
    ),
    "peer_multiples": Query(
        lambda t: screens.peer_multiples(t.valuation, t.peers, "EUROPE"),
        """SELECT ticker, pe_ratio, pb_ratio, ps_ratio, peg_ratio FROM t_valuation JOIN t_peers USING (ticker)
           WHERE peer_group = 'EUROPE'""",
    ),
}

# -- portfolios ------------------------------------------------------------------

FX_VALUED = """
    (SELECT v.*, currency,
            coalesce(direct, 1e0 / nullif(opposite, 0), CASE WHEN currency = 'USD' THEN 1e0 END) AS fx_rate
     FROM t_valued v JOIN t_metadata USING (ticker)
     LEFT JOIN t_fx ON fx_from = currency AND fx_to = 'USD' AND fx_date = price_date)"""
YTD = """
    (SELECT ticker, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close FROM t_prices
     WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-11-04' GROUP BY ticker)"""

PORTFOLIOS = {
    "portfolio_value": Query(
        lambda t: portfolio.portfolio_value(t.portfolios, t.prices),
        "SELECT portfolio_name, sum(value) AS total_value, count(*) AS holdings FROM t_valued GROUP BY portfolio_name",
        {"total_value": 2},
    ),
    "portfolio_value_base": Query(
        lambda t: portfolio.portfolio_value_in(t.portfolios, t.prices, t.metadata, t.rates),
        f"""SELECT portfolio_name, sum(value * fx_rate) AS base_value,
                   count(*) FILTER (WHERE fx_rate IS NULL) AS unrated_holdings
            FROM {FX_VALUED} GROUP BY portfolio_name""",
        {"base_value": 2},
    ),
    "portfolio_unrealized": Query(
        lambda t: portfolio.portfolio_unrealized(t.portfolios, t.prices),
        """SELECT portfolio_name, ticker, shares, purchase_price, price, shares * (price - purchase_price) AS gain,
                  CASE WHEN purchase_price > 0 THEN (price - purchase_price) / purchase_price END * 100 AS gain_pct
           FROM t_valued""",
    ),
    "portfolio_allocation": Query(
        lambda t: portfolio.portfolio_allocation(t.portfolios, t.prices, t.metadata),
        """SELECT *, part_value / sum(part_value) OVER (PARTITION BY portfolio_name) AS share
           FROM (SELECT portfolio_name, sector, sum(value) AS part_value
                 FROM t_valued JOIN t_metadata USING (ticker) GROUP BY 1, 2)""",
        {"part_value": 2, "share": 8},
    ),
    "portfolio_allocation_country": Query(
        lambda t: portfolio.portfolio_allocation(t.portfolios, t.prices, t.metadata, "country"),
        """SELECT *, part_value / sum(part_value) OVER (PARTITION BY portfolio_name) AS share
           FROM (SELECT portfolio_name, country, sum(value) AS part_value
                 FROM t_valued JOIN t_metadata USING (ticker) GROUP BY 1, 2)""",
        {"part_value": 2, "share": 8},
    ),
    "portfolio_ytd": Query(
        lambda t: portfolio.portfolio_ytd(t.portfolios, t.prices, as_of=AS_OF),
        f"""SELECT portfolio_name, ticker,
                   CASE WHEN first_close > 0 THEN (last_close - first_close) / first_close END * 100 AS ytd_return_pct
            FROM t_portfolios JOIN {YTD} USING (ticker)""",
    ),
    "portfolio_vs_benchmark": Query(
        lambda t: portfolio.portfolio_vs_benchmark(t.portfolios, t.prices, portfolio.market_index(t.prices), as_of=AS_OF),
        f"""SELECT *, return_pct - benchmark_pct AS excess_pct
            FROM (SELECT portfolio_name, (sum(shares * last_close) - sum(shares * first_close))
                             / sum(shares * first_close) * 100 AS return_pct,
                         (SELECT (arg_max(level, date) / arg_min(level, date) - 1) * 100
                          FROM (SELECT date, sum(close * volume) / sum(volume) AS level FROM t_prices
                                WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-11-04' GROUP BY date))
                             AS benchmark_pct
                  FROM t_portfolios JOIN {YTD} USING (ticker) GROUP BY portfolio_name)""",
        {"return_pct": 6, "benchmark_pct": 6, "excess_pct": 6},
    ),
    "portfolio_dividends": Query(
        lambda t: portfolio.portfolio_dividends(t.portfolios, t.dividends, as_of=AS_OF),
        """SELECT portfolio_name, sum(shares * per_share) AS dividend_income
           FROM t_portfolios JOIN (SELECT ticker, sum(amount) AS per_share FROM t_dividends
                                   WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-11-04' GROUP BY ticker)
                USING (ticker) GROUP BY portfolio_name""",
        {"dividend_income": 4},
    ),
    "portfolio_weighted_pe": Query(
        lambda t: portfolio.portfolio_weighted_pe(t.portfolios, t.prices, t.valuation),
        """SELECT portfolio_name, sum(value * pe_ratio) / nullif(sum(value), 0) AS weighted_pe
           FROM t_valued JOIN t_valuation USING (ticker) WHERE pe_ratio IS NOT NULL GROUP BY portfolio_name""",
        {"weighted_pe": 6},
    ),
    "portfolio_income_yoy": Query(
        lambda t: portfolio.portfolio_income_yoy(t.portfolios, t.growth),
        """SELECT portfolio_name, ticker, date AS fiscal_date, netIncome, prior_income,
                  netIncome - prior_income AS income_change, income_growth_yoy
           FROM t_portfolios JOIN (SELECT * FROM t_growth
                                   QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
                USING (ticker)""",
    ),
    "portfolio_fx_exposure": Query(
        lambda t: portfolio.portfolio_fx_exposure(t.portfolios, t.prices, t.metadata, t.rates),
        f"""SELECT portfolio_name, currency, sum(value) AS local_value, sum(value * fx_rate) AS base_value
            FROM {FX_VALUED} GROUP BY 1, 2""",
        {"local_value": 2, "base_value": 2},
    ),
    "portfolio_upcoming_earnings": Query(
        lambda t: portfolio.portfolio_upcoming_earnings(t.portfolios, t.earnings_calendar, as_of=CALENDAR_DAY),
        """SELECT portfolio_name, ticker, earnings_date, period_ending, estimate
           FROM t_portfolios JOIN t_calendar USING (ticker) WHERE earnings_date >= DATE '2001-07-15'""",
    ),
}

QUERIES = AGGREGATES | SERIES | TEMPLATES | SCREENS | PORTFOLIOS
