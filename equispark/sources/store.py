"""Keyed upserts, schema drift, integrity checks, stored tables and file sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Declared types of the tables that exist before any data does.
STATEMENT = (
    "ticker string, date date, ebitda double, freeCashFlow double, grossProfit double, netIncome double, "
    "operatingCashFlow double, operatingIncome double, shareholderEquity double, totalAssets double, "
    "totalLiabilities double, totalRevenue double"
)
TABLE_TYPES = {
    **{table: STATEMENT for table in ("financials_annual", "financials_quarterly")},
    "prices_daily": "ticker string, date date, open double, high double, low double, close double, "
    "adj_close double, volume bigint",
    "dividends_history": "ticker string, date date, amount double",
    "splits_history": "ticker string, date date, ratio double",
    "company_metadata": "ticker string, longName string, shortName string, sector string, industry string, "
    "website string, country string, exchange string, quoteType string, marketCap double, employees bigint, "
    "description string, currency string, financialCurrency string, sharesOutstanding bigint",
    "user_portfolios": "portfolio_name string, ticker string, shares double, purchase_date date, "
    "purchase_price double, notes string",
    "earnings_history_raw": "ticker string, report_date date, fiscal_period string, eps_estimate double, "
    "eps_actual double, eps_surprise double, surprise_pct double, revenue_estimate double, revenue_actual double",
    "earnings_calendar": "ticker string, earnings_date date, period_ending string, estimate double",
    "analyst_recommendations_raw": "ticker string, date date, firm string, from_grade string, to_grade string, "
    "action string",
    "analyst_price_targets_raw": "ticker string, date date, current_price double, target_low double, "
    "target_mean double, target_high double, num_analysts int",
    "analyst_consensus_raw": "ticker string, date date, strong_buy int, buy int, hold int, sell int, strong_sell int",
    "analyst_growth_estimates_raw": "ticker string, date date, current_qtr_growth double, next_qtr_growth double, "
    "current_year_growth double, next_year_growth double, next_5yr_growth double",
    "currency_exchange_rates": "base_currency string, quote_currency string, date date, rate double, source string",
}


def bootstrap_empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLE_TYPES[table])


def number_columns(table: str) -> list[str]:
    """The fields that a table is declared with, besides its key."""
    return [column.split()[0] for column in TABLE_TYPES[table].split(", ") if column.endswith(" double")]


# -- upserts -----------------------------------------------------------------


def upsert_by_key(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Stored rows whose key does not come in, plus every incoming row.

    Incoming copies of a key all stay and NULL keys replace nothing. Keys are
    made distinct first: partial aggregation shrinks a hot key before the
    shuffle that the anti join then reuses.
    """
    absent = [k for k in keys if k not in incoming.columns]
    if absent:
        raise ValueError(f"incoming rows lack key columns: {absent}")
    replaced = incoming.select(*keys).distinct()
    return evolve_schema(stored.join(replaced, list(keys), "left_anti"), incoming)


def upsert_earnings_key(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_by_key(stored, incoming, ("ticker", "report_date", "fiscal_period"))


def upsert_last_write_wins(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one written last; an incoming row wins a tie.

    `max_by` combines on the map side, so a key with very many writes costs one
    row per task.
    """
    both = stored.withColumn("arrival", F.lit(0)).unionByName(incoming.withColumn("arrival", F.lit(1)))
    fields = [c for c in stored.columns if c not in keys]
    last = F.max_by(F.struct(*fields), F.struct(order, "arrival"))
    return both.groupBy(*keys).agg(last.alias("doc")).select(*keys, "doc.*")


def upsert_fx(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace on (base, quote, date); the highest rate of repeated incoming keys stays."""
    keys = ["base_currency", "quote_currency", "date"]
    single = incoming.groupBy(*keys).agg(F.max("rate").alias("rate"), F.max("source").alias("source"))
    return upsert_by_key(stored, single, keys)


def evolve_schema(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by name; a column either side lacks is NULL there."""
    return stored.unionByName(incoming, allowMissingColumns=True)


def integrity_check(source: DataFrame, stored: DataFrame, tolerance_pct: float) -> DataFrame:
    """Row counts of both sides, their difference in percent, and whether it is tolerable."""
    counts = source.agg(F.count("*").alias("source_rows")).select(
        "source_rows", stored.agg(F.count("*")).scalar().alias("stored_rows")
    )
    diff = F.abs(F.col("stored_rows") - F.col("source_rows")) / F.greatest(F.lit(1), "source_rows") * 100
    return counts.withColumn("diff_pct", diff).withColumn(
        "ok", (F.col("source_rows") <= 0) | (F.col("diff_pct") <= tolerance_pct)
    )


def require_integrity(source: DataFrame, stored: DataFrame, tolerance_pct: float, label: str) -> None:
    """Raises where `integrity_check` fails; two counts reach the driver."""
    row = integrity_check(source, stored, tolerance_pct).first()
    if not row.ok:
        raise ValueError(
            f"{label}: {row.source_rows} source rows, {row.stored_rows} stored, "
            f"{row.diff_pct:.2f}% > {tolerance_pct:.2f}%"
        )


# -- stored tables -------------------------------------------------------------
#
# Write, audit, publish. Readers see `data`. A load goes to `load`, is counted
# there, and the new contents of the parts it touches go to `next`; only then
# does Spark's partition overwrite put these in place. A load that fails before
# that stays invisible; one that dies while it is put in place still has all of
# its rows in `next`, and the next writer finishes it first. One load at a time
# writes to a table.


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, folder: str) -> bool:
    path, fs = _folder(spark, folder)
    return fs.exists(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path, fs = _folder(spark, folder)
    fs.delete(path, True)


def part_of(frame: DataFrame, keys: Sequence[str], unit: str = "year") -> Column:
    """The folder a row stands in: the year or month of the first date among its keys, else a hash of them."""
    kinds = dict(frame.dtypes)
    dated = next((k for k in keys if kinds[k] in ("date", "timestamp", "timestamp_ntz")), None)
    if dated is None:
        return F.concat(F.lit("b"), F.pmod(F.xxhash64(*keys), F.lit(16)).cast("string"))
    return F.coalesce(F.date_format(dated, {"year": "'y'yyyy", "month": "'m'yyyy-MM"}[unit]), F.lit("none"))


def _write(frame: DataFrame, path: str, by: str | None, mode: str = "static") -> None:
    dealt = frame.hint("rebalance", by) if by else frame
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def _publish(spark: SparkSession, table: str, by: str | None, schema: StructType | None = None) -> None:
    reader = spark.read.option("mergeSchema", True) if schema is None else spark.read.schema(schema)
    mode = "dynamic" if by == "part" else "static"
    _write(reader.parquet(f"{table}/next"), f"{table}/data", by, mode)
    _remove(spark, f"{table}/next")


def finish(spark: SparkSession, table: str) -> None:
    """Puts a load in place that was complete when its writer died."""
    if not _exists(spark, f"{table}/next/_SUCCESS"):
        return
    path, fs = _folder(spark, f"{table}/next")
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    _publish(spark, table, next((n.split("=")[0] for n in names if "=" in n), None))


def has_rows(spark: SparkSession, table: str) -> bool:
    return _exists(spark, f"{table}/data")


def read_table(spark: SparkSession, table: str, year: int | None = None) -> DataFrame:
    """What was published last; the columns of all loads, without a shuffle. Of one year only its folders, if there are such."""
    rows = spark.read.option("mergeSchema", True).parquet(f"{table}/data")
    if year is not None and "part" in rows.columns:
        rows = rows.filter((F.col("part") == f"y{year:04}") | F.col("part").startswith(f"m{year:04}-"))
    elif year is not None and "year" in rows.columns:
        rows = rows.filter(F.col("year") == year)
    return rows.drop("part")


def upsert_table(
    incoming: DataFrame,
    table: str,
    keys: Sequence[str] = ("ticker", "date"),
    unit: str = "year",
    audit: Callable[[DataFrame], None] | None = None,
    shape: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """`upsert_by_key` on a stored table; only the parts that the load touches are read and rewritten.

    `audit` gets the rows as written and raises to keep them from readers.
    `shape` turns them into rows of the table, where that takes a look at them.
    """
    spark = incoming.sparkSession
    absent = [k for k in keys if k not in incoming.columns]
    if absent:
        raise ValueError(f"incoming rows lack key columns: {absent}")
    finish(spark, table)
    _write(incoming.withColumn("part", part_of(incoming, keys, unit)), f"{table}/load", None)
    load = spark.read.parquet(f"{table}/load")
    if audit:
        audit(load)
    touched = [r.part for r in load.select("part").distinct().collect()]  # as many as years, months or 16
    if touched:
        merged = shape(load)
        if has_rows(spark, table):
            stored = spark.read.option("mergeSchema", True).parquet(f"{table}/data").filter(F.col("part").isin(touched))
            merged = upsert_by_key(stored, merged, keys)
        _write(merged, f"{table}/next", "part")
        _publish(spark, table, "part", merged.schema)
    _remove(spark, f"{table}/load")


def replace_table(frame: DataFrame, table: str, date: str | None = None) -> bool:
    """New contents where there are any; an empty frame leaves the table as it is. By year of `date` if that is given."""
    spark = frame.sparkSession
    finish(spark, table)
    rows = frame.withColumn("year", F.year(date)) if date else frame
    _write(rows, f"{table}/next", "year" if date else None)
    filled = not spark.read.schema(rows.schema).parquet(f"{table}/next").isEmpty()
    if filled or not has_rows(spark, table):
        _publish(spark, table, "year" if date and filled else None, rows.schema)
    else:
        _remove(spark, f"{table}/next")
    return filled


# -- file sinks ----------------------------------------------------------------


# Full precision and standard quoting, so that a file reads back as it was written.
TEXT_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
CSV_OPTIONS = TEXT_TIMES | {"header": True, "escape": '"'}


def sink_csv(frame: DataFrame, path: str) -> None:
    frame.write.options(**CSV_OPTIONS).mode("errorifexists").csv(path)


def sink_json(frame: DataFrame, path: str) -> None:
    """JSON lines; dates as ISO text, NULL fields written out."""
    frame.write.options(**TEXT_TIMES, ignoreNullFields=False).mode("errorifexists").json(path)


def sink_parquet(frame: DataFrame, path: str, date: str = "date") -> None:
    """Partitioned by year, so date filters skip whole folders.

    Rebalancing by year first keeps tasks from opening a file in every year;
    AQE then splits the years that are too large for one task.
    """
    dated = frame.withColumn("year", F.year(date)).hint("rebalance", "year")
    dated.write.partitionBy("year").mode("errorifexists").parquet(path)


def export_query_log(log: DataFrame, path: str, favorites_only: bool = False) -> None:
    rows = log.filter("is_favorite") if favorites_only else log
    sink_csv(rows.orderBy(F.desc("timestamp"), F.desc("id")), path)
