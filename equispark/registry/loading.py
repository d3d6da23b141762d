"""Sources, sinks, document projections, normalisers and filters.

Raw documents are derived from the bound tables: the same rows as JSON text or
loosely typed columns, with the defects each step has to cope with.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equispark.functions.dates import period_bounds
from equispark.operators import etl, instruments
from equispark.operators.freshness import latest_records
from equispark.registry.base import AS_OF, Query
from equispark.sources import readers, store
from equispark.streaming.jobs import scratch_table

# All named periods, and their bounds as DuckDB's own dates.
PERIODS = {
    "ytd": {},
    "last_n_years": {"n": 3},
    "past_n_years": {"n": 2},
    "last_n_months": {"n": 6},
    "last_n_days": {"n": 45},
    "last_year": {},
    "last_month": {},
    "last_week": {},
    "this_year": {},
    "this_quarter": {},
    "quarter": {"year": 2000, "quarter": 2},
    "last_quarter": {},
    "fiscal_year": {"year": 1999},
    "year": {"year": 2000},
    "iso_date": {"day": date(2001, 3, 15)},
    "before_covid": {},
}
PERIODS_SQL = """
    SELECT period, CAST(a AS DATE) AS period_start, CAST(b AS DATE) AS period_end
    FROM (SELECT DATE '2001-11-04' AS t),
         LATERAL (VALUES ('ytd', date_trunc('year', t), t),
                         ('last_n_years', t - INTERVAL 3 YEAR, t),
                         ('past_n_years', t - INTERVAL 2 YEAR, t),
                         ('last_n_months', t - INTERVAL 6 MONTH, t),
                         ('last_n_days', t - 45, t),
                         ('last_year', t - INTERVAL 1 YEAR, t),
                         ('last_month', t - INTERVAL 1 MONTH, t),
                         ('last_week', t - 7, t),
                         ('this_year', date_trunc('year', t), date_trunc('year', t) + INTERVAL 1 YEAR - INTERVAL 1 DAY),
                         ('this_quarter', date_trunc('quarter', t), date_trunc('quarter', t) + INTERVAL 3 MONTH - INTERVAL 1 DAY),
                         ('quarter', DATE '2000-04-01', DATE '2000-06-30'),
                         ('last_quarter', date_trunc('quarter', t) - INTERVAL 3 MONTH, date_trunc('quarter', t) - INTERVAL 1 DAY),
                         ('fiscal_year', DATE '1999-01-01', DATE '1999-12-31'),
                         ('year', DATE '2000-01-01', DATE '2000-12-31'),
                         ('iso_date', DATE '2001-03-15', DATE '2001-03-15'),
                         ('before_covid', DATE '1900-01-01', DATE '2020-03-01')) v(period, a, b)"""

# -- sources -----------------------------------------------------------------


def _symbol_rows(t):
    """Hand-typed looking symbols, one per event."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 5
    typed = (
        F.when(kind == 0, F.concat(F.lit(" u"), user))
        .when(kind == 1, F.concat(F.lit("U"), user, F.lit(" ")))
        .when(kind == 2, F.lit("  "))
        .otherwise(F.concat(F.lit("u."), user))
    )
    return t.file("events").select(typed.alias("symbol"), "event_id")


def _checked_symbols(t):
    user = F.col("user_id").cast("string")
    kind = F.col("event_id") % 5
    typed = (
        F.when(kind == 0, F.concat(F.lit("u"), user))
        .when(kind == 1, F.concat(F.lit("u-b."), user))
        .when(kind == 2, F.concat(F.lit("u#"), user))
        .when(kind == 3, F.concat(F.lit("longsymbol"), user))
        .otherwise("")
    )
    return t.file("events").select("event_id", typed.alias("raw"))


CHECKED_SQL = """
    SELECT event_id, raw,
           CASE WHEN raw = '' THEN 'empty' WHEN NOT regexp_matches(raw, '^[A-Za-z0-9.\\-]+$') THEN 'format'
                WHEN length(raw) > 10 THEN 'length' END AS reject_reason
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 'u-b.' || user_id
                                WHEN 2 THEN 'u#' || user_id WHEN 3 THEN 'longsymbol' || user_id ELSE '' END AS raw
          FROM events)"""


def _symbols_file(t):
    """Company names as CSV files with a header each, written and read back."""
    path = scratch_table(t.spark, "symbols")
    rows = t.names.select(F.concat(F.lit(" "), "ticker").alias("ticker"), F.lit("x").alias("note"))
    rows.repartition(3, "ticker").write.option("header", True).csv(path)
    return readers.read_symbols_file(t.spark, path).select("symbol")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _chunked(t):
    """The event scan as a stream of one file per chunk, drained into files."""
    path, log = scratch_table(t.spark, "chunks"), scratch_table(t.spark, "chunks-log")
    chunks = readers.read_chunked(t.spark, t.stream_path("events"), EVENTS, 1)
    query = (
        chunks.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return t.spark.read.schema(EVENTS).parquet(path)


SOURCES = {
    "read_raw_documents": Query(
        lambda t: readers.read_raw_documents(t.spark, f"{t.folder}/documents.parquet", DOCUMENTS, "parquet"),
        "SELECT doc_id, text, lang, source, n_chars FROM documents",
    ),
    "read_symbols_file": Query(_symbols_file, "SELECT s_name AS symbol FROM supplier"),
    "dedupe_symbols": Query(
        lambda t: etl.dedupe_symbols(_symbol_rows(t), "symbol", "event_id", 50),
        """SELECT ticker, min(event_id) AS position
           FROM (SELECT event_id, upper(trim(CASE event_id % 5 WHEN 0 THEN ' u' || user_id WHEN 1 THEN 'U' || user_id || ' '
                                             WHEN 2 THEN '  ' ELSE 'u.' || user_id END)) AS ticker FROM events)
           WHERE ticker <> '' GROUP BY ticker ORDER BY position LIMIT 50""",
    ),
    "valid_symbols": Query(
        lambda t: etl.valid_symbols(_checked_symbols(t), "raw").select("event_id", "symbol"),
        f"SELECT event_id, upper(raw) AS symbol FROM ({CHECKED_SQL}) WHERE reject_reason IS NULL",
    ),
    "rejected_symbols": Query(
        lambda t: etl.rejected_symbols(_checked_symbols(t), "raw").select("event_id", "raw", "reject_reason"),
        f"SELECT event_id, raw, reject_reason FROM ({CHECKED_SQL}) WHERE reject_reason IS NOT NULL",
    ),
    "read_chunked": Query(_chunked, "SELECT event_id, ts, user_id, event_type, value, props FROM events"),
    "partition_size_advice": Query(
        lambda t: etl.partition_size_advice(t.documents, "text"),
        """SELECT count(*) AS row_count, sum(strlen(text)) / count(*) AS avg_bytes,
                  sum(strlen(text)) / 1048576e0 AS total_mb,
                  CAST(least(greatest(floor(500 * 1048576e0 / (sum(strlen(text)) / count(*))), 100), 5000) AS BIGINT)
                      AS chunk_rows
           FROM documents""",
    ),
    "table_row_counts": Query(
        lambda t: etl.table_row_counts(
            {
                "financials_annual": t.annual,
                "prices_daily": t.prices,
                "company_metadata": t.metadata,
                "dividends_history": t.dividends,
                "user_watchlists": None,
            }
        ),
        """SELECT 'financials_annual' AS table_name, (SELECT count(*) FROM t_annual) AS row_count, 'ok' AS note
           UNION ALL SELECT 'prices_daily', (SELECT count(*) FROM t_prices), 'ok'
           UNION ALL SELECT 'company_metadata', (SELECT count(*) FROM t_metadata), 'ok'
           UNION ALL SELECT 'dividends_history', (SELECT count(*) FROM t_dividends), 'ok'
           UNION ALL SELECT 'user_watchlists', NULL, 'not found'""",
    ),
}

# -- sinks ---------------------------------------------------------------------


def _csv(t):
    path = scratch_table(t.spark, "csv")
    store.sink_csv(t.prices, path)
    schema = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint"
    return t.spark.read.schema(schema).csv(path, header=True)


def _json(t):
    path = scratch_table(t.spark, "json")
    store.sink_json(t.annual, path)
    return t.spark.read.schema(t.annual.schema).json(path)


def _parquet(t):
    path = scratch_table(t.spark, "parquet")
    store.sink_parquet(t.dividends, path)
    return t.spark.read.parquet(path).withColumn("year", F.col("year").cast("bigint"))


def _exported_log(t):
    path = scratch_table(t.spark, "log")
    store.export_query_log(t.query_log, path, favorites_only=True)
    schema = (
        "id bigint, timestamp timestamp_ntz, user_query string, generated_sql string, row_count bigint, "
        "execution_time_ms double, is_favorite boolean, error_message string, notes string"
    )
    return t.spark.read.schema(schema).options(**store.CSV_OPTIONS).csv(path)


def _stored_prices(t):
    return t.prices.filter("date < DATE'2001-07-01'").select("ticker", "date", "close", "volume")


def _incoming_prices(t):
    return t.prices.filter("date >= DATE'2001-01-01'").select(
        "ticker", "date", (F.col("close") + 1).alias("close"), (F.col("volume") > 30).alias("is_heavy")
    )


def _upsert_loads(t):
    """The same upsert on a stored table, the second load sent twice."""
    table = scratch_table(t.spark, "prices")
    store.upsert_table(_stored_prices(t), table)
    store.upsert_table(_incoming_prices(t), table)
    store.upsert_table(_incoming_prices(t), table)
    return store.read_table(t.spark, table)


UPSERT_SQL = """
    SELECT ticker, date, close, volume, CAST(NULL AS BOOLEAN) AS is_heavy FROM t_prices
    WHERE date < DATE '2001-01-01'
    UNION ALL
    SELECT ticker, date, close + 1, NULL, volume > 30 FROM t_prices WHERE date >= DATE '2001-01-01'"""


def _upsert_earnings(t):
    old = t.earnings_raw.filter("report_date < DATE'2000-01-01'")
    new = t.earnings_raw.filter("report_date >= DATE'1998-01-01'").withColumn("eps_actual", F.col("eps_actual") * 2)
    return store.upsert_earnings_key(old, new).select("ticker", "report_date", "fiscal_period", "eps_actual")


def _last_writes(t):
    log = t.ingestion_log.select("ticker", "data_type", "last_fetched", "status", "record_count", "event_id")
    return store.upsert_last_write_wins(
        log.filter("event_id % 2 = 0"), log.filter("event_id % 2 = 1"), ["ticker", "data_type"], "last_fetched"
    )


def _upsert_rates(t):
    new = t.rates.filter("date >= DATE'2000-01-01'").withColumn("rate", F.col("rate") * 2)
    return store.upsert_fx(t.rates.filter("date < DATE'2001-01-01'"), new)


def _replaced(t):
    """Two loads of a table, then an empty one that changes nothing."""
    table = scratch_table(t.spark, "metadata")
    store.replace_table(t.metadata.filter("sector = 'ASIA'"), table)
    store.replace_table(t.metadata, table)
    store.replace_table(t.metadata.filter("ticker IS NULL"), table)
    return store.read_table(t.spark, table)


def _evolved(t):
    old = t.annual.select("ticker", "date", "totalRevenue").filter("date < DATE'1998-01-01'")
    new = t.annual.select("ticker", "date", "totalRevenue", "ebitda").filter("date >= DATE'1998-01-01'")
    return store.evolve_schema(old, new)


SINKS = {
    "sink_csv": Query(_csv, "SELECT * FROM t_prices"),
    "sink_json": Query(_json, "SELECT * FROM t_annual"),
    "sink_parquet": Query(_parquet, "SELECT *, year(date) AS year FROM t_dividends"),
    "export_query_log": Query(_exported_log, "SELECT * FROM t_log WHERE is_favorite"),
    "upsert_by_key": Query(lambda t: store.upsert_by_key(_stored_prices(t), _incoming_prices(t)), UPSERT_SQL),
    "upsert_change_sets": Query(_upsert_loads, UPSERT_SQL),
    "upsert_earnings_key": Query(
        _upsert_earnings,
        """SELECT ticker, report_date, fiscal_period,
                  CASE WHEN report_date < DATE '1998-01-01' THEN eps_actual ELSE eps_actual * 2 END AS eps_actual
           FROM t_earnings_raw""",
    ),
    "upsert_last_write_wins": Query(
        _last_writes,
        """SELECT ticker, data_type, last_fetched, status, record_count, event_id FROM t_fetches
           QUALIFY row_number() OVER (PARTITION BY ticker, data_type ORDER BY last_fetched DESC, event_id % 2 DESC) = 1""",
    ),
    "upsert_fx": Query(
        _upsert_rates,
        """SELECT base_currency, quote_currency, date,
                  CASE WHEN date < DATE '2000-01-01' THEN rate ELSE rate * 2 END AS rate, source FROM t_rates""",
    ),
    "replace_table": Query(_replaced, "SELECT * FROM t_metadata"),
    "evolve_schema": Query(
        _evolved,
        "SELECT ticker, date, totalRevenue, CASE WHEN date >= DATE '1998-01-01' THEN ebitda END AS ebitda FROM t_annual",
    ),
    "bootstrap_empty": Query(
        # The portfolio table as created, and its first load.
        lambda t: store.evolve_schema(store.bootstrap_empty(t.spark, "user_portfolios"), t.portfolios),
        "SELECT portfolio_name, ticker, shares, purchase_date, purchase_price, notes FROM t_portfolios",
    ),
    "integrity_check": Query(
        lambda t: store.integrity_check(t.quarterly, t.earnings_raw.filter("eps_estimate IS NOT NULL"), 5.0),
        """SELECT *, abs(stored_rows - source_rows) / greatest(1, source_rows) * 100 AS diff_pct,
                  source_rows <= 0 OR abs(stored_rows - source_rows) / greatest(1, source_rows) * 100 <= 5 AS ok
           FROM (SELECT (SELECT count(*) FROM t_quarterly) AS source_rows,
                        (SELECT count(*) FROM t_earnings_raw WHERE eps_estimate IS NOT NULL) AS stored_rows)""",
    ),
}

# -- projections ------------------------------------------------------------------


def _iso(column: str):
    """A date as the documents spell it: bare, UTC with Z, New York offset, or unusable."""
    day = F.col(column).cast("string")
    kind = F.pmod(F.xxhash64("ticker", column), F.lit(5))
    return (
        F.when(kind == 0, day)
        .when(kind == 1, F.concat(day, F.lit("T16:00:00Z")))
        .when(kind == 2, F.concat(day, F.lit("T16:00:00-05:00")))
        .when(kind == 3, F.concat(day, F.lit("T16:00:00")))
        .otherwise(F.concat(day, F.lit("T21:00:00+00:00")))
    )


def statement_documents(frame: DataFrame) -> DataFrame:
    """Statements as raw documents: three JSON sections with text and flags mixed in.

    `ebitda` stands in two sections and only the later value is the real one.
    """
    return frame.select(
        "ticker",
        _iso("date").alias("date"),
        F.to_json(
            F.struct("totalRevenue", "netIncome", "operatingIncome", (F.col("ebitda") + 1).alias("ebitda"), F.lit("n/a").alias("auditor"))
        ).alias("income_statement"),
        F.to_json(F.struct("shareholderEquity", "totalAssets", "totalLiabilities", F.lit(True).alias("audited"))).alias(
            "balance_sheet"
        ),
        F.to_json(F.struct("operatingCashFlow", "freeCashFlow", "ebitda", "grossProfit", F.lit("12").alias("code"))).alias(
            "cash_flow"
        ),
    )


def _spoiled(documents: DataFrame) -> DataFrame:
    """The documents plus unusable copies: no ticker, bad dates, no numbers."""
    blank = documents.withColumn("ticker", F.lit(None).cast("string"))
    undated = documents.withColumn("date", F.lit("soon"))
    empty = documents.withColumns(
        {c: F.lit('{"note": "none"}') for c in ("income_statement", "balance_sheet", "cash_flow")}
    )
    return documents.unionByName(blank).unionByName(undated).unionByName(empty)


def _documents(frame: DataFrame, column: str = "date", source: str | None = None) -> DataFrame:
    """Any dated table as flat documents, with a copy of each whose date is blank."""
    texts = F.explode(F.array(_iso(column), F.lit("")))
    return frame.withColumn("iso", texts).drop(column).withColumnRenamed("iso", source or "date")


def _metadata_documents(t):
    fields = [c for c in t.metadata.columns if c != "ticker"]
    nested = t.metadata.select("ticker", F.struct(*fields).alias("metadata"))
    return nested.unionByName(nested.withColumn("ticker", F.lit("")))


def _long(t):
    metrics = ["totalRevenue", "netIncome", "ebitda"]
    holes = t.quarterly.withColumn(
        "ebitda", F.when(F.col("netIncome") < 0, float("nan")).otherwise(F.col("ebitda"))
    ).withColumn("netIncome", F.when(F.month("date") == 3, float("inf")).otherwise(F.col("netIncome")))
    return etl.statement_to_long(holes, ["ticker", "date"], metrics)


# Labels as statements spell them, and the names they are stored under.
LABELS = {
    "Total Revenue": "totalRevenue",
    "NET INCOME": "netIncome",
    "Net Income Common Stockholders": "netIncome",
    " Cash ": "cashAndCashEquivalents",
    "EBITDA": "ebitda",
    "Tax Rate For Calcs": "taxRateForCalcs",
    "Diluted-EPS (2nd)": "dilutedEps2Nd",
    "--": "--",
}


def _labelled(t):
    labels = F.array(*[F.lit(x) for x in LABELS])
    rows = t.file("events").select(
        "event_id", F.element_at(labels, (F.col("event_id") % len(LABELS) + 1).cast("int")).alias("label")
    )
    return etl.canonical_field_names(rows, "label")


LABELLED_SQL = f"""
    SELECT event_id, label, field FROM events
    JOIN (VALUES {", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(LABELS.items()))}) v(i, label, field)
      ON event_id % {len(LABELS)} = i"""


def _sections(t):
    """Three statement sets with different dates missing from each."""
    def part(condition, *fields):
        pairs = [x for f in fields for x in (F.lit(f), F.col(f))]
        return t.quarterly.filter(condition).select("ticker", "date", F.create_map(*pairs).alias("fields"))

    combined = etl.combine_statements(
        part("month(date) <> 3", "totalRevenue", "netIncome"),
        part("month(date) IN (6, 9)", "totalAssets"),
        part("month(date) IN (9, 3) AND year(date) > 1996", "freeCashFlow"),
    )
    return combined.select(
        "ticker",
        "date",
        F.try_element_at("income_statement", F.lit("netIncome")).alias("net_income"),
        F.try_element_at("balance_sheet", F.lit("totalAssets")).alias("total_assets"),
        F.size("cash_flow").cast("bigint").alias("cash_fields"),
    )


def _parsed(t):
    iso = _iso("date")
    texts = F.explode(F.array(iso, F.concat(F.lit("bad "), iso))).alias("iso")
    dated = t.prices.select("ticker", F.col("date").alias("day"), texts)
    return etl.parse_dates(dated, "iso").select("ticker", "day", "parsed_date")


PROJECTIONS = {
    "flatten_statements": Query(
        # The fields of the stored schema; a load finds new ones in its staged rows.
        lambda t: etl.flatten_statements(_spoiled(statement_documents(t.annual)), store.number_columns("financials_annual")),
        "SELECT * FROM t_annual",
    ),
    "statement_to_long": Query(
        _long,
        """SELECT ticker, date, 'totalRevenue' AS field, totalRevenue AS value FROM t_quarterly
           UNION ALL SELECT ticker, date, 'netIncome', netIncome FROM t_quarterly WHERE month(date) <> 3
           UNION ALL SELECT ticker, date, 'ebitda', ebitda FROM t_quarterly WHERE netIncome >= 0""",
    ),
    "canonical_field_names": Query(_labelled, LABELLED_SQL),
    "combine_statements": Query(
        _sections,
        """SELECT ticker, date, CASE WHEN month(date) <> 3 THEN netIncome END AS net_income,
                  CASE WHEN month(date) IN (6, 9) THEN totalAssets END AS total_assets,
                  CASE WHEN month(date) IN (9, 3) AND year(date) > 1996 THEN 1 ELSE 0 END AS cash_fields
           FROM t_quarterly WHERE month(date) <> 3 OR year(date) > 1996""",
    ),
    "reporting_ts_utc": Query(
        lambda t: etl.reporting_ts_utc(t.prices.select("ticker", "date")),
        """SELECT ticker, date,
                  timezone('UTC', timezone('America/New_York', date + INTERVAL 16 HOUR)) AS reported_at FROM t_prices""",
    ),
    "parse_dates": Query(_parsed, "SELECT ticker, date AS day, date AS parsed_date FROM t_prices"),
    "prep_prices": Query(lambda t: etl.prep_prices(_documents(t.prices)), "SELECT * FROM t_prices"),
    "prep_dividends": Query(lambda t: etl.prep_dividends(_documents(t.dividends)), "SELECT * FROM t_dividends"),
    "prep_splits": Query(lambda t: etl.prep_splits(_documents(t.splits)), "SELECT * FROM t_splits"),
    "prep_metadata": Query(lambda t: etl.prep_metadata(_metadata_documents(t)), "SELECT * FROM t_metadata"),
    "prep_earnings_history": Query(
        lambda t: etl.prep_earnings_history(_documents(t.earnings_raw, "report_date", "date")),
        "SELECT * FROM t_earnings_raw",
    ),
    "prep_earnings_calendar": Query(
        lambda t: etl.prep_earnings_calendar(_documents(t.earnings_calendar, "earnings_date", "earnings_date")),
        "SELECT * FROM t_calendar",
    ),
    "prep_recommendations": Query(
        lambda t: etl.prep_recommendations(_documents(t.recommendations_raw)),
        "SELECT ticker, date, firm, from_grade, to_grade, action FROM t_recs",
    ),
    "prep_price_targets": Query(
        lambda t: etl.prep_price_targets(_documents(t.price_targets_raw)), "SELECT * FROM t_targets_raw", {"target_mean": 4}
    ),
    "prep_consensus": Query(
        lambda t: etl.prep_consensus(
            _documents(t.consensus_raw.withColumn("hold", F.when(F.col("hold") > 0, F.col("hold"))))
        ),
        "SELECT * FROM t_consensus_raw",
    ),
    "prep_growth_estimates": Query(
        lambda t: etl.prep_growth_estimates(_documents(t.growth_estimates_raw)), "SELECT * FROM t_growth_estimates_raw"
    ),
}

# -- normalisers --------------------------------------------------------------------


def _rough_bars(t):
    """Bars with NaN opens on Mondays and volumes as doubles, NaN below 5."""
    monday = F.dayofweek("date") == 2
    return t.prices.withColumn("open", F.when(monday, float("nan")).otherwise(F.col("open"))).withColumn(
        "volume", F.when(F.col("volume") < 5, float("nan")).otherwise(F.col("volume").cast("double"))
    )


def _earnings_figures(t):
    """Actual and estimated figures with NaN and zero estimates mixed in."""
    first = F.month("report_date") == 3
    return t.earnings_raw.select(
        "ticker",
        "report_date",
        "eps_actual",
        F.when(first, 0.0)
        .when(F.month("report_date") == 6, float("nan"))
        .otherwise(F.col("eps_estimate"))
        .alias("eps_estimate"),
    )


def _info(t):
    """Company facts as a market-data source lists them, some missing."""
    key = F.col("sharesOutstanding") % 7
    return (
        t.price_targets_raw.join(t.metadata.select("ticker", "sharesOutstanding"), "ticker")
        .join(t.consensus_raw.groupBy("ticker").agg(F.max("buy").alias("votes")), "ticker", "left")
        .select(
            "ticker",
            F.when(key == 0, 0.0).when(key > 2, F.col("current_price")).alias("currentPrice"),
            F.when(key != 1, F.col("current_price") + 1).alias("regularMarketPrice"),
            F.when(key != 2, F.col("target_low")).alias("targetLowPrice"),
            F.when(key != 2, F.col("target_high")).alias("targetHighPrice"),
            F.when((key != 2) & (key != 4), F.col("target_low") + 5).alias("targetMeanPrice"),
            F.when(key != 5, F.col("num_analysts")).alias("numberOfAnalystOpinions"),
            F.when(key % 2 == 0, 2.5).alias("recommendationMean"),
            F.when(key > 1, F.col("target_low") / 1000).alias("earningsGrowth"),
            F.when(key > 3, F.col("target_high") / 1000).alias("revenueGrowth"),
            F.when(key == 1, F.col("current_price") / 1000).alias("earningsQuarterlyGrowth"),
        )
    )


INFO_SQL = """
    (SELECT ticker, CASE WHEN k = 0 THEN 0 WHEN k > 2 THEN current_price END AS currentPrice,
            CASE WHEN k <> 1 THEN current_price + 1 END AS regularMarketPrice,
            CASE WHEN k <> 2 THEN target_low END AS targetLowPrice,
            CASE WHEN k <> 2 THEN target_high END AS targetHighPrice,
            CASE WHEN k <> 2 AND k <> 4 THEN target_low + 5 END AS targetMeanPrice,
            CASE WHEN k <> 5 THEN num_analysts END AS numberOfAnalystOpinions,
            CASE WHEN k % 2 = 0 THEN 2.5e0 END AS recommendationMean,
            CASE WHEN k > 1 THEN target_low / 1000 END AS earningsGrowth,
            CASE WHEN k > 3 THEN target_high / 1000 END AS revenueGrowth,
            CASE WHEN k = 1 THEN current_price / 1000 END AS earningsQuarterlyGrowth
     FROM (SELECT *, sharesOutstanding % 7 AS k FROM t_targets_raw JOIN t_metadata USING (ticker)))"""


def _summaries(t):
    """Monthly vote rows of the companies outside Asia, newest first, a count missing in each May."""
    inside = t.metadata.filter("sector <> 'ASIA'").select("ticker")
    may = F.month("date") == 5
    return t.consensus_raw.join(inside, "ticker").select(
        "ticker",
        F.datediff(F.lit(AS_OF), "date").alias("row_no"),
        F.col("strong_buy").alias("strongBuy"),
        "buy",
        F.when(~may, F.col("hold")).alias("hold"),
        "sell",
        F.col("strong_sell").alias("strongSell"),
    )


def _aliased_earnings(t):
    odd = F.quarter("report_date") % 2 == 1
    raw = t.earnings_raw.select(
        "ticker",
        F.when(odd, F.col("report_date")).alias("date"),
        F.col("report_date").alias("index_date"),
        F.col("fiscal_period").alias("period"),
        F.when(odd, F.col("eps_estimate")).alias("epsestimate"),
        F.when(~odd, F.col("eps_estimate")).alias("eps_estimate"),
        F.col("eps_actual").alias("epsActual"),
        "revenue_actual",
    )
    return etl.coalesce_earnings_fields(raw)


def _aliased_recommendations(t):
    buys = F.col("action") == "up"
    raw = t.recommendations_raw.select(
        "ticker",
        "date",
        F.when(buys, F.col("firm")).alias("firm"),
        F.when(~buys, F.col("firm")).alias("gradecompany"),
        F.col("from_grade").alias("fromgrade"),
        "to_grade",
        "action",
    )
    return etl.coalesce_recommendation_fields(raw)


NORMALISERS = {
    "normalise_price_bars": Query(
        lambda t: etl.normalise_price_bars(_rough_bars(t)),
        """SELECT ticker, date, CASE WHEN dayofweek(date) <> 1 THEN open END AS open, high, low, close, adj_close,
                  CASE WHEN volume >= 5 THEN volume END AS volume FROM t_prices""",
    ),
    "earnings_surprise": Query(
        lambda t: etl.earnings_surprise(_earnings_figures(t)).withColumn(
            "eps_estimate", F.nullif(F.nanvl("eps_estimate", F.lit(None).cast("double")), F.lit(None).cast("double"))
        ),
        """SELECT ticker, report_date, eps_actual,
                  CASE month(report_date) WHEN 3 THEN 0 WHEN 6 THEN NULL ELSE eps_estimate END AS eps_estimate,
                  CASE WHEN month(report_date) NOT IN (3, 6) THEN eps_surprise END AS eps_surprise,
                  CASE WHEN month(report_date) NOT IN (3, 6) THEN surprise_pct END AS surprise_pct
           FROM t_earnings_raw""",
    ),
    "coalesce_earnings_fields": Query(
        _aliased_earnings,
        """SELECT ticker, report_date AS date, fiscal_period, eps_estimate, eps_actual,
                  CAST(NULL AS DOUBLE) AS revenue_estimate, revenue_actual FROM t_earnings_raw""",
    ),
    "coalesce_recommendation_fields": Query(
        _aliased_recommendations, "SELECT ticker, date, firm, from_grade, to_grade, action FROM t_recs"
    ),
    "extract_price_targets": Query(
        lambda t: etl.extract_price_targets(_info(t)),
        f"""SELECT ticker, coalesce(nullif(currentPrice, 0), regularMarketPrice) AS current_price,
                   targetLowPrice AS target_low, targetMeanPrice AS target_mean, targetHighPrice AS target_high,
                   numberOfAnalystOpinions AS num_analysts
            FROM {INFO_SQL}
            WHERE coalesce(targetMeanPrice, targetLowPrice, targetHighPrice) IS NOT NULL""",
    ),
    "extract_consensus": Query(
        lambda t: etl.extract_consensus(_info(t), _summaries(t), "row_no"),
        f"""SELECT i.ticker, coalesce(strong_buy, 0) AS strong_buy, coalesce(buy, 0) AS buy, coalesce(hold, 0) AS hold,
                   coalesce(sell, 0) AS sell, coalesce(strong_sell, 0) AS strong_sell
            FROM {INFO_SQL} i
            LEFT JOIN (SELECT ticker, strong_buy, buy, CASE WHEN month(date) <> 5 THEN hold END AS hold, sell, strong_sell
                       FROM t_consensus_raw JOIN t_metadata USING (ticker) WHERE sector <> 'ASIA'
                       QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) s ON s.ticker = i.ticker
            WHERE s.ticker IS NOT NULL OR recommendationMean IS NOT NULL""",
    ),
    "scale_growth_estimates": Query(
        lambda t: etl.scale_growth_estimates(_info(t)),
        f"""SELECT ticker, earningsQuarterlyGrowth * 100 AS current_qtr_growth, revenueGrowth * 100 AS next_qtr_growth,
                   earningsGrowth * 100 AS current_year_growth, earningsGrowth * 100 AS next_5yr_growth
            FROM {INFO_SQL}
            WHERE coalesce(earningsQuarterlyGrowth, earningsGrowth, revenueGrowth) IS NOT NULL""",
    ),
    "price_lookback": Query(
        lambda t: etl.price_lookback(t.prices, AS_OF), "SELECT * FROM t_prices WHERE date >= DATE '2001-11-04' - 365"
    ),
    "incremental_since_last": Query(
        lambda t: etl.incremental_since_last(t.prices, _held(t), AS_OF),
        """SELECT p.* FROM t_prices p
           LEFT JOIN (SELECT ticker, max(date) AS last_date FROM t_prices JOIN t_metadata USING (ticker)
                      WHERE sector IN ('ASIA', 'EUROPE') AND (sector = 'EUROPE' OR date < DATE '2001-09-01')
                      GROUP BY ticker) s USING (ticker)
           WHERE date > last_date OR (last_date IS NULL AND date >= DATE '2001-11-04' - 365)""",
    ),
}


def _held(t):
    """Stored bars: complete for Europe, up to August for Asia, none elsewhere."""
    placed = t.prices.join(t.metadata.select("ticker", "sector"), "ticker")
    return placed.filter("sector IN ('ASIA', 'EUROPE') AND (sector = 'EUROPE' OR date < DATE'2001-09-01')")


# -- filters --------------------------------------------------------------------------


def _instruments(t):
    """Companies as instrument facts: US spellings, flags, ETF names, crypto, blank types."""
    n = F.col("sharesOutstanding").cast("bigint")
    return t.metadata.select(
        "ticker",
        F.when(n % 70 == 0, None)
        .when(n % 90 == 0, "cryptocurrency")
        .when(n % 50 == 0, "common_stock")
        .otherwise(F.col("quoteType"))
        .alias("quoteType"),
        F.when(n % 60 == 0, F.concat("longName", F.lit(" etf"))).otherwise(F.col("longName")).alias("longName"),
        F.when(n % 80 == 0, F.lit("True")).alias("isETF"),
        F.when(F.col("sector") == "AMERICA", F.lit(" usa"))
        .when(F.col("sector") == "EUROPE", "Germany")
        .otherwise(F.col("country"))
        .alias("country"),
        F.when(n % 30 == 0, "US_market").alias("market"),
        "currency",
        "financialCurrency",
        "exchange",
    )


INSTRUMENTS_SQL = """
    (SELECT *, quoteType = 'ETF' OR coalesce(upper(quoteType), '') NOT IN ('EQUITY', 'COMMON_STOCK', 'COMMONSTOCK', 'STOCK')
               OR lower(coalesce(isETF, '')) = 'true' OR upper(longName) LIKE '% ETF%' AS etf,
            coalesce(upper(quoteType) IN ('MUTUALFUND', 'FUND'), FALSE) AS fund,
            coalesce(upper(quoteType) IN ('CRYPTOCURRENCY', 'CRYPTO'), FALSE) AS crypto,
            upper(trim(coalesce(nullif(financialCurrency, ''), currency))) AS money
     FROM (SELECT ticker,
                  CASE WHEN sharesOutstanding % 70 = 0 THEN NULL WHEN sharesOutstanding % 90 = 0 THEN 'cryptocurrency'
                       WHEN sharesOutstanding % 50 = 0 THEN 'common_stock' ELSE quoteType END AS quoteType,
                  CASE WHEN sharesOutstanding % 60 = 0 THEN longName || ' etf' ELSE longName END AS longName,
                  CASE WHEN sharesOutstanding % 80 = 0 THEN 'True' END AS isETF,
                  CASE sector WHEN 'AMERICA' THEN ' usa' WHEN 'EUROPE' THEN 'Germany' ELSE country END AS country,
                  CASE WHEN sharesOutstanding % 30 = 0 THEN 'US_market' END AS market,
                  currency, financialCurrency, exchange
           FROM t_metadata))"""
COLUMNS = "ticker, quoteType, longName, isETF, country, market, currency, financialCurrency, exchange"
US = "lower(trim(country)) IN ('united states', 'united states of america', 'usa', 'us')"
CUSTOM = {"mode": "custom", "custom": {"allowed_currencies": ["USD", "EUR"], "allowed_exchanges": ["Nasdaq", " XETRA"]},
          "exclude_etfs": False}


def _reason(*rules: tuple[str, str]) -> str:
    cases = " ".join(f"WHEN {test} THEN '{name}'" for name, test in rules)
    return f"SELECT {COLUMNS}, CASE {cases} END AS reject_reason FROM {INSTRUMENTS_SQL}"


KINDS = (("etf", "etf"), ("fund", "fund"), ("crypto", "crypto"))


def _period(name, bounds, **parts):
    return Query(
        lambda t: instruments.period_filter(t.prices, name, AS_OF, **parts),
        f"SELECT * FROM t_prices WHERE date BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}'",
    )


FILTERS = {
    "flag_etf": Query(
        lambda t: instruments.flag_etf(_instruments(t)), f"SELECT {COLUMNS}, etf AS is_etf FROM {INSTRUMENTS_SQL}"
    ),
    "flag_mutual_fund": Query(
        lambda t: instruments.flag_mutual_fund(_instruments(t)),
        f"SELECT {COLUMNS}, fund AS is_fund FROM {INSTRUMENTS_SQL}",
    ),
    "flag_crypto": Query(
        lambda t: instruments.flag_crypto(_instruments(t)),
        f"SELECT {COLUMNS}, crypto AS is_crypto FROM {INSTRUMENTS_SQL}",
    ),
    "instrument_filter": Query(lambda t: instruments.classify_instruments(_instruments(t)), _reason(*KINDS)),
    "instrument_filter_us": Query(
        lambda t: instruments.classify_instruments(_instruments(t), instruments.US_ONLY),
        _reason(*KINDS, ("country", f"NOT {US}"), ("currency", "money <> 'USD'")),
    ),
    "instrument_filter_eu": Query(
        lambda t: instruments.instrument_filter(_instruments(t), instruments.EU_ONLY),
        f"""SELECT {COLUMNS} FROM {INSTRUMENTS_SQL}
            WHERE NOT etf AND NOT fund AND NOT crypto AND country = 'Germany' AND money IN ('EUR', 'GBP')""",
    ),
    "instrument_filter_custom": Query(
        lambda t: instruments.classify_instruments(_instruments(t), instruments.market_from_config(CUSTOM)),
        _reason(
            *KINDS[1:],
            ("currency", "money NOT IN ('USD', 'EUR')"),
            ("exchange", "upper(trim(exchange)) NOT IN ('NASDAQ', 'XETRA')"),
        ),
    ),
    "us_listing_filter": Query(
        lambda t: instruments.us_listing_filter(_instruments(t)),
        f"SELECT {COLUMNS} FROM {INSTRUMENTS_SQL} WHERE {US} OR lower(market) IN ('us_market', 'us')",
    ),
    "usd_financials_filter": Query(
        lambda t: instruments.usd_financials_filter(_instruments(t)),
        f"SELECT {COLUMNS} FROM {INSTRUMENTS_SQL} WHERE money = 'USD'",
    ),
    "period_filter": _period("last_n_months", ("2001-08-04", "2001-11-04"), n=3),
    "period_filter_last_quarter": _period("last_quarter", ("2001-07-01", "2001-09-30")),
    "period_filter_day": _period("iso_date", ("2001-03-15", "2001-03-15"), day=date(2001, 3, 15)),
    "period_table": Query(
        lambda t: instruments.in_periods(t.prices, {name: period_bounds(name, AS_OF, **parts) for name, parts in PERIODS.items()})
        .groupBy("period", "period_start", "period_end", "ticker")
        .agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("volume").alias("volume")),
        f"""SELECT period, period_start, period_end, ticker, count(*) AS days, min(date) AS first, max(date) AS last,
                   CAST(sum(volume) AS BIGINT) AS volume
            FROM t_prices JOIN ({PERIODS_SQL}) ON date BETWEEN period_start AND period_end GROUP BY ALL""",
    ),
    "event_table": Query(
        lambda t: instruments.since_events(
            t.prices,
            {
                "ipo": instruments.first_price_dates(t.prices),
                "split": instruments.last_split_dates(t.splits),
                "earnings": instruments.last_report_dates(t.earnings_raw, AS_OF),
            },
        ).select("ticker", "date", "close", "event", "event_date"),
        """SELECT p.ticker, p.date, p.close, event, event_date FROM t_prices p
           JOIN (SELECT ticker, 'ipo' AS event, min(date) AS event_date FROM t_prices GROUP BY ticker
                 UNION ALL SELECT ticker, 'split', max(date) FROM t_splits GROUP BY ticker
                 UNION ALL SELECT ticker, 'earnings', max(report_date) FROM t_earnings_raw
                 WHERE report_date <= DATE '2001-11-04' GROUP BY ticker) e ON e.ticker = p.ticker
           WHERE date >= event_date""",
    ),
    "before_after_event": Query(
        lambda t: instruments.since_event(t.prices, instruments.last_split_dates(t.splits)),
        """SELECT p.*, event_date FROM t_prices p
           JOIN (SELECT ticker, max(date) AS event_date FROM t_splits GROUP BY ticker) USING (ticker)
           WHERE date >= event_date""",
    ),
    "since_last_earnings": Query(
        lambda t: instruments.since_event(t.prices, instruments.last_report_dates(t.earnings_raw, AS_OF)),
        """SELECT p.*, event_date FROM t_prices p
           JOIN (SELECT ticker, max(report_date) AS event_date FROM t_earnings_raw
                 WHERE report_date <= DATE '2001-11-04' GROUP BY ticker) USING (ticker)
           WHERE date >= event_date""",
    ),
    "date_range_prices": Query(
        lambda t: instruments.date_range(t.prices, "Supplier#000000003", date(2000, 1, 1), date(2000, 12, 31)),
        """SELECT * FROM t_prices WHERE ticker = 'Supplier#000000003'
           AND date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""",
    ),
    "prefix_search": Query(
        lambda t: instruments.prefix_search(_upper_names(t), " supplier#00000000"),
        """SELECT DISTINCT upper(ticker) AS ticker FROM t_metadata WHERE upper(ticker) LIKE 'SUPPLIER#00000000%'
           ORDER BY ticker LIMIT 10""",
    ),
    "name_search": Query(
        lambda t: instruments.name_search(_upper_names(t), "company supplier#00000001", limit=20),
        """SELECT DISTINCT upper(ticker) AS ticker, longName AS name, sector,
                  upper(ticker) || ' - ' || longName AS display
           FROM t_metadata WHERE upper(longName) LIKE '%COMPANY SUPPLIER#00000001%' ORDER BY ticker LIMIT 20""",
    ),
    "symbol_exists": Query(
        lambda t: instruments.symbol_exists(_asked(t), t.metadata),
        """SELECT DISTINCT c_name AS symbol, upper(replace(c_name, 'Customer', 'Supplier'))
                  IN (SELECT upper(ticker) FROM t_metadata) AS is_known
           FROM (SELECT replace(c_name, 'Customer', 'supplier') AS c_name FROM customer)""",
    ),
    "distinct_symbols": Query(
        lambda t: instruments.distinct_symbols(t.prices), "SELECT DISTINCT ticker FROM t_prices ORDER BY ticker"
    ),
}


def _upper_names(t):
    return t.metadata.withColumn("ticker", F.upper("ticker"))


def _asked(t):
    return t.file("customer").select(F.regexp_replace("c_name", "Customer", "supplier").alias("symbol")).distinct()


QUERIES = SOURCES | SINKS | PROJECTIONS | NORMALISERS | FILTERS
