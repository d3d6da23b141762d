"""The refresh: raw documents to stored tables to derived tables, in dependency order."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from equispark.operators import analyst, etl, fundamentals, fx, technical
from equispark.plans.catalog import VIEWS
from equispark.sources import store

# Each raw collection, its table, its projection, its key, and whether folders hold a year or a month.
UPSERTED = {
    "raw_annual": ("financials_annual", etl.statement_fields, ("ticker", "date"), "year"),
    "raw_quarterly": ("financials_quarterly", etl.statement_fields, ("ticker", "date"), "year"),
    "raw_prices": ("prices_daily", etl.prep_prices, ("ticker", "date"), "month"),
    "raw_dividends": ("dividends_history", etl.prep_dividends, ("ticker", "date"), "year"),
    "raw_splits": ("splits_history", etl.prep_splits, ("ticker", "date"), "year"),
    "raw_earnings": ("earnings_history_raw", etl.prep_earnings_history, ("ticker", "report_date", "fiscal_period"), "year"),
    "raw_rates": ("currency_exchange_rates", fx.prep_rates, ("base_currency", "quote_currency", "date"), "month"),
}
REPLACED = {
    "raw_metadata": ("company_metadata", etl.prep_metadata),
    "raw_earnings_calendar": ("earnings_calendar", etl.prep_earnings_calendar),
    "raw_recommendations": ("analyst_recommendations_raw", etl.prep_recommendations),
    "raw_price_targets": ("analyst_price_targets_raw", etl.prep_price_targets),
    "raw_consensus": ("analyst_consensus_raw", etl.prep_consensus),
    "raw_growth_estimates": ("analyst_growth_estimates_raw", etl.prep_growth_estimates),
}


def load(raw: Mapping[str, DataFrame], root: str, tolerance_pct: float | None = None) -> None:
    """Upserts or replaces the stored tables from whatever collections came in.

    With a tolerance, the rows of each load are counted against its documents
    before readers see any of them; a load that lacks more raises.
    """
    for collection, (table, prepare, keys, unit) in UPSERTED.items():
        if collection in raw:
            documents = raw[collection]

            def audit(written: DataFrame, documents: DataFrame = documents, table: str = table) -> None:
                if tolerance_pct is not None:
                    store.require_integrity(documents, written, tolerance_pct, table)

            rows = prepare(documents)
            # Statements are staged as parsed maps, which tell what columns they have.
            shape = partial(etl.widened, known=store.number_columns(table)) if "fields" in rows.columns else lambda load: load
            store.upsert_table(rows, f"{root}/{table}", keys, unit, audit, shape)
    for collection, (table, prepare) in REPLACED.items():
        if collection in raw:
            store.replace_table(prepare(raw[collection]), f"{root}/{table}")


def stored(spark: SparkSession, root: str, table: str, year: int | None = None) -> DataFrame:
    """A stored table, or its typed empty form before the first load. Columns that no load had are there, empty."""
    path = f"{root}/{table}"
    empty = store.bootstrap_empty(spark, table)
    return store.evolve_schema(empty, store.read_table(spark, path, year)) if store.has_rows(spark, path) else empty


def derive(spark: SparkSession, root: str, as_of: date) -> dict[str, DataFrame]:
    """Derived tables; growth feeds valuation, valuation feeds the growth estimates.

    A failing step raises: a table with zero rows is never the sign of an error.
    """
    annual, prices, dividends, metadata, rates = (
        stored(spark, root, t)
        for t in ("financials_annual", "prices_daily", "dividends_history", "company_metadata", "currency_exchange_rates")
    )
    valuation = fundamentals.valuation_metrics(prices, annual, dividends, metadata, as_of=as_of)
    return {
        "ratios_financial": fundamentals.ratios_financial(annual),
        "growth_annual": fundamentals.growth_annual(annual),
        "company_peers": fundamentals.peer_membership(spark),
        "user_portfolios": stored(spark, root, "user_portfolios"),
        "valuation_metrics": valuation,
        "valuation_metrics_multicurrency": fx.valuation_multicurrency(prices, annual, dividends, metadata, rates, as_of=as_of),
        "earnings_history": analyst.earnings_history(stored(spark, root, "earnings_history_raw")),
        "earnings_calendar_upcoming": analyst.earnings_upcoming(stored(spark, root, "earnings_calendar"), as_of=as_of),
        "analyst_recommendations": analyst.recommendation_scores(stored(spark, root, "analyst_recommendations_raw")),
        "analyst_price_targets": analyst.price_target_upside(stored(spark, root, "analyst_price_targets_raw")),
        "analyst_consensus": analyst.analyst_consensus(stored(spark, root, "analyst_consensus_raw")),
        "analyst_growth_estimates": analyst.growth_estimates_peg(
            stored(spark, root, "analyst_growth_estimates_raw"), valuation
        ),
        "technical_indicators": technical.technical_indicators(technical.one_bar_per_day(prices)),
    }


# Derived tables whose date questions are asked by; they are stored by year of it.
DATED = {"ratios_financial", "growth_annual", "earnings_history", "analyst_recommendations", "technical_indicators"}


def refresh(raw: Mapping[str, DataFrame], root: str, as_of: date, tolerance_pct: float | None = None) -> dict[str, DataFrame]:
    """Loads what came in and writes every derived table; returns them as read back."""
    spark = next(iter(raw.values())).sparkSession
    load(raw, root, tolerance_pct)
    out = {}
    for name, frame in derive(spark, root, as_of).items():
        path = f"{root}/derived/{name}"
        by = next((c for c in ("date", "report_date") if c in frame.columns), None) if name in DATED else None
        store.replace_table(frame, path, by)
        out[name] = store.read_table(spark, path)
    return out


class StoredTables:
    """What a refresh has published, under the names that templates use; of all years or of one."""

    def __init__(self, spark: SparkSession, root: str, year: int | None = None):
        self.spark, self.root, self.year = spark, root, year

    def of_year(self, year: int) -> StoredTables:
        return StoredTables(self.spark, self.root, year)

    def __getattr__(self, name: str) -> DataFrame:
        table = next((view for view, attribute in VIEWS.items() if attribute == name), None)
        if table is None:
            raise AttributeError(name)
        derived = f"{self.root}/derived/{table}"
        if store.has_rows(self.spark, derived):
            return store.read_table(self.spark, derived, self.year)
        return stored(self.spark, self.root, table, self.year)
