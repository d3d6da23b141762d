"""Raw documents to typed tables: flattening, projections and normalisers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.functions.dates import parse_date
from equispark.functions.numeric import missing_to_null

SECTIONS = ("income_statement", "balance_sheet", "cash_flow")

# Statement line labels and the field each one is stored under.
# Where a label stands in two lists the first list wins.
FIELD_SYNONYMS: dict[str, list[str]] = {
    "netIncome": [
        "Net Income",
        "NetIncome",
        "Net Income Applicable To Common Shares",
        "Net Income Common Stockholders",
    ],
    "netIncomeApplicableToCommonShares": [
        "Net Income Applicable To Common Shares",
        "Net Income Common Stockholders",
    ],
    "totalRevenue": ["Total Revenue", "Revenue", "Revenues"],
    "totalAssets": ["Total Assets", "TotalAssets"],
    "totalLiabilities": ["Total Liabilities Net Minority Interest", "Total Liabilities", "TotalLiab"],
    "cashAndCashEquivalents": [
        "Cash And Cash Equivalents",
        "Cash",
        "Cash And Cash Equivalents At Carrying Value",
    ],
    "operatingCashFlow": ["Total Cash From Operating Activities", "Operating Cash Flow"],
    "grossProfit": ["Gross Profit"],
    "researchAndDevelopment": ["Research And Development", "Research Development"],
    "ebit": ["EBIT", "Ebit"],
    "ebitda": ["EBITDA", "Ebitda"],
    "shareholderEquity": ["Total Stockholder Equity", "Total Equity Gross Minority Interest"],
    "freeCashFlow": ["Free Cash Flow"],
}


# -- symbols ---------------------------------------------------------------


def dedupe_symbols(frame: DataFrame, symbol: str, position: str, limit: int) -> DataFrame:
    """Trimmed upper-case symbols, first occurrence kept, first `limit` in order.

    The limit is the feature (a run takes at most that many symbols). Partial
    aggregation collapses a hot symbol before the shuffle; the ordered limit is
    a per-partition top-k, not a global sort.
    """
    cleaned = frame.select(F.upper(F.trim(symbol)).alias("ticker"), F.col(position).alias("position"))
    return (
        cleaned.filter(F.col("ticker") != "")
        .groupBy("ticker")
        .agg(F.min("position").alias("position"))
        .orderBy("position", "ticker")
        .limit(limit)
    )


def check_symbols(frame: DataFrame, symbol: str) -> DataFrame:
    """Adds the upper-cased symbol and the reason it is rejected, if any."""
    raw = F.col(symbol)
    reason = (
        F.when(raw.isNull() | (raw == ""), "empty")
        .when(~raw.rlike(r"^[A-Za-z0-9.\-]+$"), "format")
        .when(F.length(raw) > 10, "length")
    )
    return frame.withColumn("reject_reason", reason).withColumn(
        "symbol", F.when(F.col("reject_reason").isNull(), F.upper(raw))
    )


def valid_symbols(frame: DataFrame, symbol: str) -> DataFrame:
    return check_symbols(frame, symbol).filter("reject_reason IS NULL")


def rejected_symbols(frame: DataFrame, symbol: str) -> DataFrame:
    return check_symbols(frame, symbol).filter("reject_reason IS NOT NULL")


# -- statements ------------------------------------------------------------


def _numeric_fields(section: Column) -> Column:
    """The finite numbers of a JSON object; text and booleans are left out."""
    fields = F.from_json(section, "map<string,variant>")
    kinds = ("BIGINT", "DOUBLE", "FLOAT")
    def is_number(_, v):
        kind = F.schema_of_variant(v)
        return kind.isin(*kinds) | kind.startswith("DECIMAL")
    numbers = F.map_filter(fields, is_number)
    numbers = F.transform_values(numbers, lambda _, v: F.try_variant_get(v, "$", "double"))
    finite = F.map_filter(numbers, lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite, F.create_map().cast("map<string,double>"))


def statement_fields(documents: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """One row per usable document with its numeric fields in a single map.

    Sections are JSON object columns; a field named in several sections takes
    its value from the last one.
    """
    def later_wins(acc, section):
        fresh = F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(section), k))
        return F.map_concat(fresh, section)

    merged = F.aggregate(
        F.array(*[_numeric_fields(F.col(s)) for s in sections]),
        F.create_map().cast("map<string,double>"),
        later_wins,
    )
    # A one-element explode: Catalyst would otherwise parse the JSON once for the
    # filter on the result and again for every column taken from it.
    dated = documents.select("ticker", parse_date("date").alias("date"), F.explode(F.array(merged)).alias("fields"))
    return dated.filter((F.col("ticker") != "") & F.col("date").isNotNull() & (F.size("fields") > 0))


def field_names(statements: DataFrame) -> list[str]:
    """Sorted distinct field names; a schema-sized result, bounded by the report forms."""
    keys = statements.select(F.explode(F.map_keys("fields")).alias("k")).distinct()
    return sorted(row.k for row in keys.collect())


def flatten_statements(documents: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Wide statement rows: ticker, date and one DOUBLE per field, sorted by name.

    With `fields` given the plan is a plain projection; otherwise one extra
    aggregate finds the names first. Loads stage `statement_fields` and widen
    the staged rows, so that documents are parsed once.
    """
    return widened(statement_fields(documents), fields)


def widened(statements: DataFrame, fields: Sequence[str] | None = None, known: Sequence[str] = ()) -> DataFrame:
    """One DOUBLE column per field: the given ones, else the known ones and all that the rows hold."""
    names = sorted(fields) if fields is not None else sorted({*known, *field_names(statements)})
    others = [c for c in statements.columns if c != "fields"]
    return statements.select(*others, *[F.col("fields")[n].alias(n) for n in names])


def statement_to_long(frame: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Wide to long: one row per present, finite value."""
    doubles = frame.select(*ids, *[missing_to_null(v).alias(v) for v in values])
    return doubles.unpivot(list(ids), list(values), "field", "value").filter("value IS NOT NULL")


def canonical_field_names(frame: DataFrame, label: str) -> DataFrame:
    """Adds `field`: the stored name of a statement label.

    The synonym table is a fixed, tiny literal map, so this stays a projection.
    """
    lookup: dict[str, str] = {}
    for field, labels in FIELD_SYNONYMS.items():
        for text in labels:
            lookup.setdefault(text.lower(), field)
    pairs = [F.lit(part) for item in lookup.items() for part in item]
    trimmed = F.trim(F.col(label))
    known = F.try_element_at(F.create_map(*pairs), F.lower(trimmed))
    tokens = F.filter(F.split(trimmed, "[^0-9A-Za-z]+"), lambda t: t != "")
    titled = F.transform(F.slice(tokens, 2, F.size(tokens)), _title)
    camel = F.concat(F.lower(F.try_element_at(tokens, F.lit(1))), F.array_join(titled, ""))
    return frame.withColumn("field", F.coalesce(known, F.when(F.size(tokens) > 0, camel), trimmed))


def _title(token: Column) -> Column:
    """Upper-case each letter that starts a run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(token), F.lit("([a-z]+|[0-9]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def combine_statements(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Union of (ticker, date) over three statement sets of `fields` maps.

    One tagged union and one grouped pass: a two-step full outer join would
    shuffle the first result again. Empty sections count as absent and dates
    with nothing in any section drop out.
    """
    tagged = None
    for name, frame in zip(SECTIONS, (income, balance, cash)):
        part = frame.filter(F.size("fields") > 0).select("ticker", "date", F.lit(name).alias("section"), "fields")
        tagged = part if tagged is None else tagged.unionByName(part)
    picks = [
        F.coalesce(
            F.any_value(F.when(F.col("section") == s, F.col("fields")), True),
            F.create_map().cast("map<string,double>"),
        ).alias(s)
        for s in SECTIONS
    ]
    return tagged.groupBy("ticker", "date").agg(*picks)


# -- projections of flat documents ------------------------------------------

# The columns of each flat table, in order.
PRICE_COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")
METADATA_COLUMNS = (
    "longName",
    "shortName",
    "sector",
    "industry",
    "website",
    "country",
    "exchange",
    "quoteType",
    "marketCap",
    "employees",
    "description",
    "currency",
    "financialCurrency",
)
EARNINGS_COLUMNS = (
    "fiscal_period",
    "eps_estimate",
    "eps_actual",
    "eps_surprise",
    "surprise_pct",
    "revenue_estimate",
    "revenue_actual",
)
CONSENSUS_COLUMNS = ("strong_buy", "buy", "hold", "sell", "strong_sell")
TARGET_COLUMNS = ("current_price", "target_low", "target_mean", "target_high", "num_analysts")
GROWTH_COLUMNS = (
    "current_qtr_growth",
    "next_qtr_growth",
    "current_year_growth",
    "next_year_growth",
    "next_5yr_growth",
)


def _dated(documents: DataFrame, columns: Sequence[Column | str], source: str = "date", name: str = "date") -> DataFrame:
    """ticker, parsed date and columns; rows without either key are skipped.

    The date is exploded out of an array: a filter on a plain column of it would
    be moved down to the scan, and the text parsed there once more.
    """
    return documents.select("ticker", F.explode(F.array(parse_date(source))).alias(name), *columns).filter(
        (F.col("ticker") != "") & F.col(name).isNotNull()
    )


def prep_prices(documents: DataFrame) -> DataFrame:
    return _dated(documents, PRICE_COLUMNS)


def prep_dividends(documents: DataFrame) -> DataFrame:
    return _dated(documents, ["amount"])


def prep_splits(documents: DataFrame) -> DataFrame:
    return _dated(documents, ["ratio"])


def prep_metadata(documents: DataFrame, extra: Sequence[str] = ("sharesOutstanding",)) -> DataFrame:
    """Company columns out of the nested `metadata` struct.

    `extra` adds the share count that the currency-normalised valuation reads.
    """
    held = documents.schema["metadata"].dataType.fieldNames()
    columns = [F.col(f"metadata.{c}").alias(c) for c in METADATA_COLUMNS]
    columns += [F.col(f"metadata.{c}").alias(c) for c in extra if c in held]
    return documents.select("ticker", *columns).filter("ticker <> ''")


def prep_earnings_history(documents: DataFrame) -> DataFrame:
    return _dated(documents, EARNINGS_COLUMNS, name="report_date")


def prep_earnings_calendar(documents: DataFrame) -> DataFrame:
    return _dated(documents, ["period_ending", "estimate"], source="earnings_date", name="earnings_date")


def prep_recommendations(documents: DataFrame) -> DataFrame:
    return _dated(documents, ["firm", "from_grade", "to_grade", "action"])


def prep_price_targets(documents: DataFrame) -> DataFrame:
    return _dated(documents, TARGET_COLUMNS)


def prep_consensus(documents: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in CONSENSUS_COLUMNS]
    return _dated(documents, counts)


def prep_growth_estimates(documents: DataFrame) -> DataFrame:
    return _dated(documents, GROWTH_COLUMNS)


# -- source normalisers ------------------------------------------------------


def normalise_price_bars(bars: DataFrame) -> DataFrame:
    """Prices with NaN as NULL and whole volumes."""
    doubles = [missing_to_null(c).alias(c) for c in PRICE_COLUMNS if c != "volume"]
    return bars.select("ticker", "date", *doubles, missing_to_null("volume").cast("bigint").alias("volume"))


def earnings_surprise(frame: DataFrame) -> DataFrame:
    """Adds eps_surprise and surprise_pct where both figures exist and the estimate is not 0."""
    actual, estimate = missing_to_null("eps_actual"), missing_to_null("eps_estimate")
    surprise = F.when(estimate != 0, actual - estimate)
    return frame.withColumn("eps_surprise", surprise).withColumn(
        "surprise_pct", F.when(estimate != 0, (actual - estimate) / F.abs(estimate) * 100)
    )


def coalesce_aliases(frame: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each target column takes the first of its source names that holds a value."""
    present = {c.lower(): c for c in frame.columns}
    columns = []
    for target, names in aliases.items():
        held = [F.col(present[n.lower()]) for n in names if n.lower() in present]
        columns.append((F.coalesce(*held) if held else F.lit(None)).alias(target))
    return frame.select("ticker", *columns)


# Source spellings of the earnings and recommendation fields.
EARNINGS_ALIASES = {
    "date": ["date", "index_date"],
    "fiscal_period": ["period", "fiscal_period"],
    "eps_estimate": ["epsestimate", "eps_estimate"],
    "eps_actual": ["epsactual", "eps_actual"],
    "revenue_estimate": ["revenueestimate", "revenue_estimate"],
    "revenue_actual": ["revenueactual", "revenue_actual"],
}
RECOMMENDATION_ALIASES = {
    "date": ["date", "index_date"],
    "firm": ["firm", "gradecompany"],
    "from_grade": ["fromgrade", "from_grade"],
    "to_grade": ["tograde", "to_grade"],
    "action": ["action"],
}


def coalesce_earnings_fields(frame: DataFrame) -> DataFrame:
    return coalesce_aliases(frame, EARNINGS_ALIASES)


def coalesce_recommendation_fields(frame: DataFrame) -> DataFrame:
    return coalesce_aliases(frame, RECOMMENDATION_ALIASES).filter("date IS NOT NULL")


def extract_price_targets(info: DataFrame) -> DataFrame:
    """Target rows of companies with any target; a zero current price falls through."""
    current = F.coalesce(F.nullif(F.col("currentPrice"), F.lit(0.0)), F.col("regularMarketPrice"))
    return info.filter("targetMeanPrice IS NOT NULL OR targetLowPrice IS NOT NULL OR targetHighPrice IS NOT NULL").select(
        "ticker",
        current.cast("double").alias("current_price"),
        F.col("targetLowPrice").cast("double").alias("target_low"),
        F.col("targetMeanPrice").cast("double").alias("target_mean"),
        F.col("targetHighPrice").cast("double").alias("target_high"),
        F.col("numberOfAnalystOpinions").cast("bigint").alias("num_analysts"),
    )


def extract_consensus(info: DataFrame, summaries: DataFrame, order: str) -> DataFrame:
    """Counts of each company's first summary row; zeros where only a mean exists.

    `min_by` keeps the pick a partial aggregate instead of a per-company sort.
    """
    source = ("strongBuy", "buy", "hold", "sell", "strongSell")
    first = summaries.groupBy("ticker").agg(
        *[F.coalesce(F.min_by(s, order), F.lit(0)).cast("bigint").alias(t) for s, t in zip(source, CONSENSUS_COLUMNS)]
    )
    joined = info.select("ticker", "recommendationMean").join(
        first.withColumn("has_summary", F.lit(True)), "ticker", "left"
    )
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in CONSENSUS_COLUMNS]
    return joined.filter("has_summary OR recommendationMean IS NOT NULL").select("ticker", *counts)


def scale_growth_estimates(info: DataFrame) -> DataFrame:
    """Growth fractions as percentages; companies without any are dropped."""
    return info.filter(
        "earningsQuarterlyGrowth IS NOT NULL OR earningsGrowth IS NOT NULL OR revenueGrowth IS NOT NULL"
    ).select(
        "ticker",
        (F.col("earningsQuarterlyGrowth") * 100).alias("current_qtr_growth"),
        (F.col("revenueGrowth") * 100).alias("next_qtr_growth"),
        (F.col("earningsGrowth") * 100).alias("current_year_growth"),
        (F.col("earningsGrowth") * 100).alias("next_5yr_growth"),
    )


# -- load windows ------------------------------------------------------------


def price_lookback(prices: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    return prices.filter(F.col("date") >= F.date_sub(F.lit(as_of), days))


def incremental_since_last(incoming: DataFrame, stored: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """Rows after each company's newest stored date; a full lookback for new ones."""
    last = stored.groupBy("ticker").agg(F.max("date").alias("last_date"))
    fresh = (F.col("date") > F.col("last_date")) | (
        F.col("last_date").isNull() & (F.col("date") >= F.date_sub(F.lit(as_of), days))
    )
    return incoming.join(last, "ticker", "left").filter(fresh).drop("last_date")


def partition_size_advice(frame: DataFrame, text: str, budget_mb: int = 500) -> DataFrame:
    """Row count, mean and total size, and rows per chunk for a memory budget.

    One full aggregate instead of a sample, so the answer is the same each time.
    """
    sizes = frame.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("bytes"),
    )
    avg = F.col("bytes") / F.col("row_count")
    advice = F.least(F.greatest(F.floor(F.lit(budget_mb * 1048576.0) / avg), F.lit(100)), F.lit(5000))
    empty = (F.col("row_count") == 0) | (F.col("bytes") == 0)
    return sizes.select(
        "row_count",
        F.when(empty, 0.0).otherwise(avg).alias("avg_bytes"),
        (F.col("bytes") / 1048576.0).alias("total_mb"),
        F.when(empty, F.lit(1000)).otherwise(advice).cast("bigint").alias("chunk_rows"),
    )


def table_row_counts(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row per table: its row count, or a note where the table is missing."""
    found = next(f for f in tables.values() if f is not None)
    out = None
    for name, frame in tables.items():
        if frame is None:
            row = found.sparkSession.range(1).select(
                F.lit(name).alias("table_name"),
                F.lit(None).cast("bigint").alias("row_count"),
                F.lit("not found").alias("note"),
            )
        else:
            row = frame.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count", F.lit("ok").alias("note")
            )
        out = row if out is None else out.unionByName(row)
    return out


def unique_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty for a sound table."""
    return frame.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def reporting_ts_utc(frame: DataFrame, column: str = "date") -> DataFrame:
    """Adds the UTC instant of the 16:00 New York close on a calendar date."""
    close = F.col(column).cast("timestamp_ntz") + F.expr("INTERVAL 16 HOURS")
    return frame.withColumn(
        "reported_at", F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), close)
    )


def parse_dates(frame: DataFrame, column: str) -> DataFrame:
    """Adds the calendar date (UTC) of ISO text, parsed once a row as in `_dated`, and drops rows without one."""
    return frame.withColumn("parsed_date", F.explode(F.array(parse_date(column)))).filter("parsed_date IS NOT NULL")
