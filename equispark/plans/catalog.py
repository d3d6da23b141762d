"""Every table of the engine under one roof, derived ones included, and as SQL views."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame

from equispark.operators import analyst, fundamentals, fx, technical
from equispark.sources.bindings import MarketTables


class Tables(MarketTables):
    """Base tables plus the derived ones, each a lazy plan."""

    def __init__(self, spark, folder: str, as_of: date = date(2001, 11, 4)):
        super().__init__(spark, folder)
        self.as_of = as_of

    @cached_property
    def ratios(self) -> DataFrame:
        return fundamentals.ratios_financial(self.annual)

    @cached_property
    def growth(self) -> DataFrame:
        return fundamentals.growth_annual(self.annual)

    @cached_property
    def valuation(self) -> DataFrame:
        return fundamentals.valuation_metrics(self.prices, self.annual, self.dividends, self.metadata, as_of=self.as_of)

    @cached_property
    def fx_valuation(self) -> DataFrame:
        return fx.valuation_multicurrency(
            self.prices, self.annual, self.dividends, self.metadata, self.rates, as_of=self.as_of
        )

    @cached_property
    def indicators(self) -> DataFrame:
        return technical.technical_indicators(self.prices)

    @cached_property
    def earnings(self) -> DataFrame:
        return self.earnings_raw.filter("report_date IS NOT NULL")

    @cached_property
    def recommendations(self) -> DataFrame:
        return analyst.recommendation_scores(self.recommendations_raw)

    @cached_property
    def price_targets(self) -> DataFrame:
        return analyst.price_target_upside(self.price_targets_raw)

    @cached_property
    def consensus(self) -> DataFrame:
        return analyst.analyst_consensus(self.consensus_raw)

    @cached_property
    def growth_estimates(self) -> DataFrame:
        return analyst.growth_estimates_peg(self.growth_estimates_raw, self.valuation)


# SQL view name of each table.
VIEWS = {
    "financials_annual": "annual",
    "financials_quarterly": "quarterly",
    "prices_daily": "prices",
    "dividends_history": "dividends",
    "splits_history": "splits",
    "company_metadata": "metadata",
    "company_peers": "peers",
    "user_portfolios": "portfolios",
    "ratios_financial": "ratios",
    "growth_annual": "growth",
    "valuation_metrics": "valuation",
    "valuation_metrics_multicurrency": "fx_valuation",
    "earnings_history": "earnings",
    "earnings_calendar": "earnings_calendar",
    "analyst_recommendations": "recommendations",
    "analyst_price_targets": "price_targets",
    "analyst_consensus": "consensus",
    "analyst_growth_estimates": "growth_estimates",
    "technical_indicators": "indicators",
    "currency_exchange_rates": "rates",
}


def register_views(tables: Tables) -> list[str]:
    """Temp views for `spark.sql`; Spark's analyzer checks tables and columns."""
    for view, attribute in VIEWS.items():
        getattr(tables, attribute).createOrReplaceTempView(view)
    return list(VIEWS)
