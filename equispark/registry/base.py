"""Registration helpers and the shared SQL of the oracles."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame

from equispark.functions.numeric import TIE_GUARD, stable_round
from equispark.plans.catalog import Tables

AS_OF = date(2001, 11, 4)
CALENDAR_DAY = date(2001, 7, 15)
NOW = datetime(2024, 1, 31)


@dataclass(frozen=True)
class Query:
    """A query on the bound tables, its SQL, and the columns rounded on both sides.

    Only sums of doubles are rounded: their last bits depend on the order of
    addition, which neither engine fixes.
    """

    run: Callable[[Tables], DataFrame]
    sql: str | None = None
    rounded: Mapping[str, int] = field(default_factory=dict)

    def frame(self, spark, folder: str) -> DataFrame:
        out = self.run(Tables(spark, folder))
        if not self.rounded:
            return out
        return out.withColumns({c: stable_round(c, d) for c, d in self.rounded.items()})

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = self.sql.strip()
        if self.rounded:
            swaps = ", ".join(f"floor({c} * 1e{d} + {TIE_GUARD}) / 1e{d} AS {c}" for c, d in self.rounded.items())
            body = f"SELECT * REPLACE ({swaps}) FROM ({body})"
        return with_tables(body)


def with_tables(body: str) -> str:
    """Puts the definitions a statement refers to in front of it."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in TABLE_SQL:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(TABLE_SQL[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({TABLE_SQL[n].strip()})" for n in needed) + "\n" + body


TABLE_SQL: dict[str, str] = {
    "t_lines": """
        SELECT l_orderkey, l_suppkey, l_partkey, CAST(l_shipdate AS DATE) AS d, l_quantity AS q,
               l_linenumber, l_returnflag, l_linestatus, l_extendedprice / l_quantity AS unit,
               CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS disc_pct,
               CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS gross_c,
               CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS net_c,
               CAST(floor(l_extendedprice * (1 - l_discount) * (1 - l_tax) * 100 + 0.5) AS BIGINT) AS after_tax_c,
               CAST(floor(l_extendedprice * l_tax * 100 + 0.5) AS BIGINT) AS tax_c
        FROM lineitem""",
    "t_report_lines": """
        SELECT l.*, s_name, s_acctbal, CAST(floor(p_retailprice * q * 100 + 0.5) AS BIGINT) AS cost_c
        FROM t_lines l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""",
    "t_annual": """
        SELECT s_name AS ticker, make_date(CAST(y AS INT), 12, 31) AS date,
               gross / 1e2 AS totalRevenue, net / 1e2 AS grossProfit, after_tax / 1e2 AS ebitda,
               (net - 2 * cost) / 1e2 AS netIncome, s_acctbal * 1000 AS shareholderEquity,
               (gross + cost) / 1e2 AS totalAssets, cost / 1e2 AS totalLiabilities,
               (net - cost) / 1e2 AS operatingIncome,
               settled / 1e2 AS operatingCashFlow, (settled - tax) / 1e2 AS freeCashFlow
        FROM (SELECT s_name, s_acctbal, year(d) AS y, CAST(sum(gross_c) AS BIGINT) AS gross,
                     CAST(sum(net_c) AS BIGINT) AS net, CAST(sum(after_tax_c) AS BIGINT) AS after_tax,
                     CAST(sum(tax_c) AS BIGINT) AS tax, CAST(sum(cost_c) AS BIGINT) AS cost,
                     CAST(sum(net_c) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS settled
              FROM t_report_lines GROUP BY 1, 2, 3)""",
    "t_quarterly": """
        SELECT s_name AS ticker, make_date(CAST(y AS INT), CAST(qtr * 3 AS INT), 1) AS date,
               gross / 1e2 AS totalRevenue, net / 1e2 AS grossProfit, after_tax / 1e2 AS ebitda,
               (net - 2 * cost) / 1e2 AS netIncome, s_acctbal * 1000 AS shareholderEquity,
               (gross + cost) / 1e2 AS totalAssets, cost / 1e2 AS totalLiabilities,
               (net - cost) / 1e2 AS operatingIncome,
               settled / 1e2 AS operatingCashFlow, (settled - tax) / 1e2 AS freeCashFlow,
               net - 2 * cost AS income_cents, gross AS revenue_cents
        FROM (SELECT s_name, s_acctbal, year(d) AS y, quarter(d) AS qtr, CAST(sum(gross_c) AS BIGINT) AS gross,
                     CAST(sum(net_c) AS BIGINT) AS net, CAST(sum(after_tax_c) AS BIGINT) AS after_tax,
                     CAST(sum(tax_c) AS BIGINT) AS tax, CAST(sum(cost_c) AS BIGINT) AS cost,
                     CAST(sum(net_c) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS settled
              FROM t_report_lines GROUP BY 1, 2, 3, 4)""",
    "t_prices": """
        SELECT s_name AS ticker, d AS date, (min(unit) + max(unit)) / 2 AS open, max(unit) AS high,
               min(unit) AS low, sum(gross_c) / 1e2 / sum(q) AS close, sum(gross_c) / 1e2 / sum(q) AS adj_close,
               CAST(sum(q) AS BIGINT) AS volume
        FROM t_lines JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_name, d""",
    "t_dividends": """
        SELECT s_name AS ticker, d AS date, sum(disc_pct) / 1e2 AS amount
        FROM t_lines JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY s_name, d""",
    "t_splits": """
        SELECT s_name AS ticker, d AS date, CAST(max(l_linenumber) AS DOUBLE) AS ratio
        FROM t_lines JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_returnflag = 'N' AND q >= 50 GROUP BY s_name, d""",
    "t_metadata": """
        SELECT s_name AS ticker, 'Company ' || s_name AS longName,
               CASE WHEN s_suppkey % 10 <> 0 THEN 'C' || s_suppkey END AS shortName,
               r_name AS sector, n_name AS industry, 'https://c' || s_suppkey || '.example.com' AS website,
               n_name AS country,
               CASE s_suppkey % 3 WHEN 0 THEN 'NYSE' WHEN 1 THEN 'nasdaq ' ELSE 'XETRA' END AS exchange,
               CASE WHEN s_suppkey % 11 = 0 THEN 'ETF' WHEN s_suppkey % 13 = 0 THEN 'MUTUALFUND'
                    ELSE 'EQUITY' END AS quoteType,
               s_acctbal * 2000000 AS marketCap, s_suppkey * 10 AS employees,
               'Business of ' || s_name AS description,
               CASE s_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
               CASE s_suppkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN ' ' END AS financialCurrency,
               s_suppkey * 10 + 1000 AS sharesOutstanding
        FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "t_peers": """
        SELECT ticker, sector AS peer_group FROM t_metadata
        UNION ALL SELECT ticker, industry FROM t_metadata""",
    "t_rates": """
        SELECT b AS base_currency, qc AS quote_currency, d AS date,
               floor(k * (1 + (day(d) % 10) / 1e2) * 1e6 + 0.5) / 1e6 AS rate, 'derived' AS source
        FROM (SELECT DISTINCT d FROM t_lines WHERE day(d) % 3 <> 0),
             (VALUES ('EUR', 'USD', 1.1e0), ('USD', 'GBP', 0.8e0), ('JPY', 'USD', 0.007e0)) v(b, qc, k)""",
    "t_portfolios": """
        SELECT c_mktsegment AS portfolio_name, s_name AS ticker, sum(q) AS shares, min(d) AS purchase_date,
               sum(gross_c) / 1e2 / sum(q) AS purchase_price, CAST(NULL AS VARCHAR) AS notes
        FROM t_lines JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
             JOIN supplier ON s_suppkey = l_suppkey
        WHERE l_linestatus = 'O' GROUP BY 1, 2""",
    "t_earnings_raw": """
        SELECT ticker, date AS report_date,
               'Q' || quarter(date) || ' ' || year(date) AS fiscal_period, eps_estimate, eps_actual,
               CASE WHEN eps_estimate <> 0 THEN eps_actual - eps_estimate END AS eps_surprise,
               CASE WHEN eps_estimate <> 0 THEN (eps_actual - eps_estimate) / abs(eps_estimate) * 100 END AS surprise_pct,
               revenue_estimate, revenue_actual
        FROM (SELECT ticker, date, netIncome / 1e6 AS eps_actual, totalRevenue AS revenue_actual,
                     CAST(sum(income_cents) OVER w AS DOUBLE) / nullif(count(*) OVER w, 0) / 1e8 AS eps_estimate,
                     CAST(sum(revenue_cents) OVER w AS DOUBLE) / nullif(count(*) OVER w, 0) / 1e2 AS revenue_estimate
              FROM t_quarterly
              WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))""",
    "t_calendar": """
        SELECT s_name AS ticker, CAST(o_orderdate AS DATE) AS earnings_date,
               'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS period_ending,
               max(o_totalprice) AS estimate
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""",
    "t_recs": """
        SELECT DISTINCT s_name AS ticker, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS firm,
               CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'Hold' ELSE '' END AS from_grade,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Buy' WHEN '5-LOW' THEN 'Sell' ELSE 'Hold' END AS to_grade,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'up' WHEN '5-LOW' THEN 'down' ELSE 'main' END AS action,
               o_orderpriority AS priority
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
             JOIN supplier ON s_suppkey = l_suppkey""",
    "t_consensus_raw": """
        SELECT s_name AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
               count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS strong_buy,
               count(*) FILTER (WHERE o_orderpriority LIKE '2%') AS buy,
               count(*) FILTER (WHERE o_orderpriority LIKE '3%') AS hold,
               count(*) FILTER (WHERE o_orderpriority LIKE '4%') AS sell,
               count(*) FILTER (WHERE o_orderpriority LIKE '5%') AS strong_sell
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""",
    "t_targets_raw": """
        SELECT ticker, max(date) AS date, arg_max(close, date) AS current_price, min(close) AS target_low,
               avg(close) AS target_mean, max(close) AS target_high, count(*) AS num_analysts
        FROM t_prices GROUP BY ticker""",
    "t_ratios": """
        SELECT ticker, date,
               CASE WHEN totalRevenue > 0 THEN netIncome / totalRevenue END AS net_margin,
               CASE WHEN shareholderEquity > 0 THEN netIncome / shareholderEquity END AS roe,
               CASE WHEN totalAssets > 0 THEN netIncome / totalAssets END AS roa,
               CASE WHEN totalAssets > 0 THEN totalLiabilities / totalAssets END AS debt_ratio,
               CASE WHEN netIncome > 0 THEN operatingCashFlow / netIncome END AS cash_conversion,
               CASE WHEN totalRevenue > 0 THEN freeCashFlow / totalRevenue END AS fcf_margin,
               CASE WHEN totalAssets > 0 THEN totalRevenue / totalAssets END AS asset_turnover,
               CASE WHEN totalRevenue > 0 THEN grossProfit / totalRevenue END AS gross_margin,
               CASE WHEN totalRevenue > 0 THEN ebitda / totalRevenue END AS ebitda_margin
        FROM t_annual WHERE totalRevenue IS NOT NULL""",
    "t_growth": """
        SELECT a.ticker, a.date, a.totalRevenue, a.netIncome, b.totalRevenue AS prior_revenue,
               b.netIncome AS prior_income,
               CASE WHEN b.totalRevenue > 0 THEN (a.totalRevenue - b.totalRevenue) / b.totalRevenue END
                   AS revenue_growth_yoy,
               CASE WHEN b.netIncome > 0 THEN (a.netIncome - b.netIncome) / b.netIncome END AS income_growth_yoy
        FROM t_annual a LEFT JOIN t_annual b ON b.ticker = a.ticker AND year(b.date) + 1 = year(a.date)""",
    "t_last_price": """
        SELECT ticker, max(date) AS price_date, arg_max(close, date) AS price FROM t_prices GROUP BY ticker""",
    "t_last_annual": """
        SELECT ticker, date AS fiscal_date, netIncome, totalRevenue, shareholderEquity, totalAssets FROM t_annual
        WHERE totalRevenue IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""",
    "t_year_dividends": """
        SELECT ticker, sum(amount) AS annual_dividend, max(date) AS last_dividend_date FROM t_dividends
        WHERE date >= DATE '2001-11-04' - 365 GROUP BY ticker""",
    "t_valuation": """
        SELECT p.ticker, p.price_date AS date, p.price, m.marketCap AS market_cap,
               CASE WHEN f.netIncome > 0 AND shares > 0 THEN p.price / (f.netIncome / shares) END AS pe_ratio,
               CASE WHEN f.shareholderEquity > 0 AND shares > 0 THEN p.price / (f.shareholderEquity / shares) END
                   AS pb_ratio,
               CASE WHEN f.totalRevenue > 0 AND m.marketCap > 0 THEN m.marketCap / f.totalRevenue END AS ps_ratio,
               CASE WHEN f.netIncome > 0 AND shares > 0 AND g.revenue_growth_yoy > 0
                    THEN p.price / (f.netIncome / shares) / (g.revenue_growth_yoy * 100) END AS peg_ratio,
               CASE WHEN p.price > 0 AND annual_dividend > 0 THEN annual_dividend / p.price END AS dividend_yield,
               CASE WHEN f.netIncome > 0 AND annual_dividend > 0 THEN annual_dividend * shares / f.netIncome END
                   AS payout_ratio,
               CASE WHEN m.marketCap >= 10e9 THEN 'Large Cap' WHEN m.marketCap >= 2e9 THEN 'Mid Cap'
                    WHEN m.marketCap > 0 THEN 'Small Cap' ELSE 'Unknown' END AS cap_class
        FROM t_last_price p
        JOIN (SELECT m.ticker, m.marketCap, CASE WHEN l.price > 0 THEN m.marketCap / l.price END AS shares
              FROM t_metadata m LEFT JOIN t_last_price l USING (ticker)) m USING (ticker)
        LEFT JOIN t_last_annual f USING (ticker)
        LEFT JOIN t_year_dividends USING (ticker)
        LEFT JOIN t_growth g ON g.ticker = p.ticker AND g.date = f.fiscal_date""",
    "t_fx": """
        SELECT a AS fx_from, b AS fx_to, date AS fx_date, max(r) AS direct, max(o) AS opposite
        FROM (SELECT base_currency AS a, quote_currency AS b, date, rate AS r, NULL AS o FROM t_rates
              UNION ALL SELECT quote_currency, base_currency, date, NULL, rate FROM t_rates) GROUP BY 1, 2, 3""",
    "t_fx_valuation": """
        SELECT p.ticker, price_date, fiscal_date, currency AS local_currency, 'USD' AS base_currency,
               price AS price_local, price * shares AS market_cap_local, totalRevenue AS revenue_local,
               netIncome AS net_income_local, shareholderEquity AS equity_local, fx AS fx_rate,
               price * fx AS price_usd, price * shares * fx AS market_cap_usd, totalRevenue * fx AS revenue_usd,
               netIncome * fx AS net_income_usd, shareholderEquity * fx AS equity_usd,
               price * shares / nullif(netIncome, 0) AS pe_ratio,
               price * shares / nullif(totalRevenue, 0) AS ps_ratio,
               price * shares / nullif(shareholderEquity, 0) AS pb_ratio,
               price / nullif(netIncome / nullif(CAST(shares AS DOUBLE), 0), 0) AS price_to_eps,
               CASE WHEN price > 0 THEN annual_dividend / price * 100 END AS dividend_yield_pct,
               CASE WHEN price * shares * fx >= 10e9 THEN 'Large Cap' WHEN price * shares * fx >= 2e9 THEN 'Mid Cap'
                    ELSE 'Small Cap' END AS market_cap_category
        FROM (SELECT p.*, f.* EXCLUDE (ticker), currency, sharesOutstanding AS shares, annual_dividend,
                     coalesce(direct, 1e0 / nullif(opposite, 0), CASE WHEN currency = 'USD' THEN 1e0 END) AS fx
              FROM t_last_price p JOIN t_last_annual f USING (ticker)
              JOIN t_metadata m USING (ticker)
              LEFT JOIN t_year_dividends USING (ticker)
              LEFT JOIN t_fx ON fx_from = currency AND fx_to = 'USD' AND fx_date = price_date
              WHERE currency IS NOT NULL) p""",
    "t_growth_estimates_raw": """
        SELECT ticker, date, CAST(NULL AS DOUBLE) AS current_qtr_growth, CAST(NULL AS DOUBLE) AS next_qtr_growth,
               income_growth_yoy * 100 AS current_year_growth, CAST(NULL AS DOUBLE) AS next_year_growth,
               revenue_growth_yoy * 100 AS next_5yr_growth
        FROM t_growth WHERE prior_revenue IS NOT NULL""",
    "t_growth_estimates": """
        SELECT g.*, CASE WHEN next_5yr_growth > 0 THEN pe_ratio / next_5yr_growth END AS peg_forward
        FROM t_growth_estimates_raw g LEFT JOIN t_valuation v USING (ticker)""",
    "t_scores": """
        SELECT *, CASE action WHEN 'up' THEN 1 WHEN 'down' THEN -1 ELSE 0 END::BIGINT AS action_score FROM t_recs""",
    "t_targets": """
        SELECT *, CASE WHEN current_price > 0 THEN (target_mean - current_price) / current_price * 100 END AS upside_pct,
               CASE WHEN current_price > 0 THEN (target_low - current_price) / current_price * 100 END AS downside_pct,
               CASE WHEN current_price > 0 THEN (target_high - current_price) / current_price * 100 END
                   AS max_upside_pct
        FROM t_targets_raw""",
    "t_bars": """
        SELECT ticker, date, close, volume,
               avg(close) OVER w20 AS sma_20, avg(close) OVER w50 AS sma_50, avg(close) OVER w200 AS sma_200,
               avg(close) OVER w12 AS ema_12, avg(close) OVER w26 AS ema_26, stddev_samp(close) OVER w20 AS std_20,
               avg(volume) OVER w20 AS volume_avg_20, close - lag(close) OVER w AS step,
               lag(close, 1) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20,
               lag(close, 60) OVER w AS c60, lag(close, 252) OVER w AS c252,
               max(close) OVER w252 AS week_52_high, min(close) OVER w252 AS week_52_low
        FROM t_prices
        WINDOW w AS (PARTITION BY ticker ORDER BY date),
               w12 AS (PARTITION BY ticker ORDER BY date ROWS 11 PRECEDING),
               w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING),
               w26 AS (PARTITION BY ticker ORDER BY date ROWS 25 PRECEDING),
               w50 AS (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING),
               w200 AS (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING),
               w252 AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING)""",
    "t_indicators": """
        SELECT ticker, date, close, sma_20, sma_50, sma_200, ema_12, ema_26,
               CASE WHEN avg_loss = 0 THEN 100.0 WHEN avg_gain = 0 THEN 0.0
                    ELSE 100 - 100 / (1 + avg_gain / avg_loss) END AS rsi_14,
               macd, macd_signal, macd - macd_signal AS macd_histogram, sma_20 + 2 * std_20 AS bb_upper,
               sma_20 AS bb_middle, sma_20 - 2 * std_20 AS bb_lower, volume_avg_20,
               CASE WHEN volume_avg_20 > 0 THEN volume / volume_avg_20 END AS volume_ratio,
               CASE WHEN c1 > 0 THEN (close - c1) / c1 * 100 END AS pct_change_1d,
               CASE WHEN c5 > 0 THEN (close - c5) / c5 * 100 END AS pct_change_5d,
               CASE WHEN c20 > 0 THEN (close - c20) / c20 * 100 END AS pct_change_20d,
               CASE WHEN c60 > 0 THEN (close - c60) / c60 * 100 END AS pct_change_60d,
               CASE WHEN c252 > 0 THEN (close - c252) / c252 * 100 END AS pct_change_252d,
               week_52_high, week_52_low,
               CASE WHEN week_52_high > 0 THEN (close - week_52_high) / week_52_high * 100 END AS pct_from_52w_high,
               CASE WHEN week_52_low > 0 THEN (close - week_52_low) / week_52_low * 100 END AS pct_from_52w_low
        FROM (SELECT *, ema_12 - ema_26 AS macd,
                     avg(greatest(coalesce(step, 0), 0)) OVER w14 AS avg_gain,
                     avg(greatest(-coalesce(step, 0), 0)) OVER w14 AS avg_loss,
                     avg(ema_12 - ema_26) OVER w9 AS macd_signal
              FROM t_bars
              WINDOW w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING),
                     w9 AS (PARTITION BY ticker ORDER BY date ROWS 8 PRECEDING))
        WHERE sma_20 IS NOT NULL""",
    "t_bar_numbers": """
        SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM t_prices""",
    "t_ema_walk": """
        SELECT ticker, date, close, n, close AS ema_true_12, close AS ema_true_26 FROM t_bar_numbers WHERE n = 1
        UNION ALL
        SELECT s.ticker, s.date, s.close, s.n, s.close * (2e0 / 13) + w.ema_true_12 * (1 - 2e0 / 13),
               s.close * (2e0 / 27) + w.ema_true_26 * (1 - 2e0 / 27)
        FROM t_ema_walk w JOIN t_bar_numbers s ON s.ticker = w.ticker AND s.n = w.n + 1""",
    "t_last_bar": """
        SELECT * FROM t_indicators QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""",
    "t_returns": """
        SELECT ticker, date, close / prev - 1 AS ret
        FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM t_prices) WHERE prev > 0""",
    "t_valued": """
        SELECT h.*, price, price_date, shares * price AS value FROM t_portfolios h JOIN t_last_price USING (ticker)""",
    "t_fetches": """
        SELECT 'U' || user_id AS ticker, event_type AS data_type, ts AS last_fetched,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status,
               event_id % 500 AS record_count, value AS duration_ms, event_id
        FROM events""",
    "t_log": """
        SELECT event_id AS id, ts AS timestamp, 'q ' || props AS user_query,
               'SELECT * FROM prices_daily WHERE ticker = ''U'
                   || translate(CAST(user_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ')
                   || ''' OR ticker IN (''AA'', ''U'
                   || translate(CAST(user_id % 7 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || ''')' AS generated_sql,
               event_id % 100 AS row_count, value AS execution_time_ms, event_type = 'purchase' AS is_favorite,
               CASE WHEN event_type = 'error' THEN 'failed: ' || props END AS error_message,
               CASE WHEN event_type = 'view' THEN 'Note ' || event_id % 50 END AS notes
        FROM events""",
}
