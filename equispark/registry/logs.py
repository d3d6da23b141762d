"""Text, freshness, query logs, conversations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from equispark.functions.dates import utc_instant
from equispark.operators import aggregates, conversations, etl, freshness, querylog, text
from equispark.registry.base import NOW, Query
from equispark.registry.loading import statement_documents
from equispark.sources import store
from equispark.streaming import jobs

# -- text ------------------------------------------------------------------------

# The table names that misspelled ones are compared with.
KNOWN_NAMES = ("red widget", "small ring", "green gear", "large bolt", "blue plate", "metal widgets")


def _typed_names(t):
    ending = F.char(97 + F.col("p_size") % 26)
    middle = F.substr("p_name", 3 + F.col("p_size") % 2, F.length("p_name") - 4)
    return t.file("part").select(F.concat(F.upper(F.substr("p_name", F.lit(1), F.lit(2))), middle, ending).alias("typed"))


def _credentials(t):
    """Documents with a connection string at the end, and a secret of varying length."""
    address = F.concat(
        F.lit(" mongodb+srv://user"), F.col("doc_id").cast("string"), F.lit(":pw"), F.col("n_chars").cast("string"),
        F.lit("@db.example.com/main"),
    )
    return t.documents.select(
        "doc_id",
        F.concat("text", address).alias("body"),
        F.repeat(F.lit("k9"), (F.col("doc_id") % 5).cast("int")).alias("secret"),
    )


WORDS_SQL = r"regexp_split_to_array({}, '[^\p{{L}}\p{{N}}_]+')"

TEXT = {
    "fmt_report": Query(
        lambda t: text.fmt_report(
            t.annual.join(t.ratios.select("ticker", "date", "net_margin", "cash_conversion"), ["ticker", "date"]).select(
                "ticker", "totalRevenue", "netIncome", "net_margin", "cash_conversion", F.col("ebitda").alias("close_price")
            )
        ),
        """SELECT ticker, {money0} AS totalRevenue, {money1} AS netIncome,
                  format('{{:.2f}}%', net_margin * 100) AS net_margin,
                  {money2} AS cash_conversion, format('${{:.2f}}', ebitda) AS close_price
           FROM t_annual JOIN t_ratios USING (ticker, date)""".format(
            **{
                f"money{i}": (
                    f"CASE WHEN {c} IS NULL THEN 'N/A'"
                    + "".join(
                        f" WHEN abs({c}) >= {u} THEN format('${{:.2f}}{s}', {c} / {u})"
                        for s, u in (("T", "1e12"), ("B", "1e9"), ("M", "1e6"), ("K", "1e3"))
                    )
                    + f" ELSE format('${{:.2f}}', {c}) END"
                )
                for i, c in enumerate(("totalRevenue", "netIncome", "cash_conversion"))
            }
        ),
    ),
    "extract_symbols": Query(
        lambda t: text.extract_symbols(t.documents, "doc_id", "text"),
        f"""SELECT DISTINCT doc_id, symbol FROM (SELECT doc_id, unnest({WORDS_SQL.format("text")}) AS symbol FROM documents)
            WHERE regexp_full_match(symbol, '[A-Z]{{2,5}}')""",
    ),
    "extract_sql_symbols": Query(
        lambda t: text.extract_sql_symbols(t.query_log, "id", "generated_sql"),
        """SELECT DISTINCT id, unnest(['U' || translate(CAST(user_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ'), 'AA',
                                       'U' || translate(CAST(user_id % 7 AS VARCHAR), '0123456789', 'ABCDEFGHIJ')]) AS symbol
           FROM (SELECT event_id AS id, user_id FROM events)""",
    ),
    "redact_credentials": Query(
        lambda t: text.redact_credentials(_credentials(t), "doc_id", "body", "secret"),
        """SELECT doc_id, text || ' mongodb+srv://user' || doc_id || ':***@db.example.com/main' AS redacted,
                  CASE WHEN doc_id % 5 <= 2 THEN '***' ELSE repeat('*', CAST(doc_id % 5 * 2 - 4 AS INT)) || 'k9k9' END
                      AS masked
           FROM documents""",
    ),
    "fuzzy_name_table": Query(
        # Typed names that lack their end and have a wrong one, against the table of names.
        lambda t: text.close_names_in(_typed_names(t), "typed", t.file("part"), "p_name"),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY given ORDER BY score DESC, candidate) AS place
                          FROM (SELECT given, candidate, 1 - levenshtein(lower(given), candidate)
                                           / CAST(greatest(length(given), length(candidate)) AS DOUBLE) AS score
                                FROM (SELECT DISTINCT upper(substr(p_name, 1, 2)) || substr(p_name, 3 + p_size % 2, length(p_name) - 4)
                                             || chr(CAST(97 + p_size % 26 AS INT)) AS given FROM part),
                                     (SELECT DISTINCT p_name AS candidate FROM part))
                          WHERE score >= 0.5) WHERE place <= 3""",
    ),
    "fuzzy_name_match": Query(
        lambda t: text.close_names(t.file("part"), "p_name", KNOWN_NAMES),
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY given ORDER BY score DESC, candidate) AS place
                           FROM (SELECT given, candidate, 1 - levenshtein(given, candidate)
                                            / CAST(greatest(length(given), length(candidate)) AS DOUBLE) AS score
                                 FROM (SELECT DISTINCT p_name AS given FROM part),
                                      (VALUES {", ".join(f"('{n}')" for n in KNOWN_NAMES)}) v(candidate))
                           WHERE score >= 0.5) WHERE place <= 3""",
    ),
}

# -- freshness ---------------------------------------------------------------------

FIVE_TYPES = ("click", "error", "purchase", "signup", "view")


def _asked_symbols(t):
    """Every fetched symbol and as many that never were."""
    seen = t.ingestion_log.select("ticker").distinct()
    return seen.unionByName(seen.select(F.concat(F.lit("X"), "ticker").alias("ticker")))


def _updates(t):
    """A later run that reaches the click and view records."""
    records = freshness.latest_records(t.ingestion_log)
    later = records.filter("data_type IN ('click', 'view')").select(
        "ticker",
        "data_type",
        (F.col("last_fetched") + F.expr("INTERVAL 1 DAY")).alias("last_fetched"),
        F.lit("success").alias("status"),
        (F.col("record_count") + 1).alias("record_count"),
    )
    return freshness.freshness_update(records, later)


LATEST_SQL = """
    SELECT ticker, data_type, last_fetched, status, record_count FROM t_fetches
    QUALIFY row_number() OVER (PARTITION BY ticker, data_type ORDER BY last_fetched DESC, event_id DESC) = 1"""

FRESHNESS = {
    "freshness_status": Query(
        lambda t: freshness.freshness_status(_asked_symbols(t), t.ingestion_log, now=NOW, threshold_days=2),
        """SELECT ticker, CAST(days AS BIGINT) AS days_old, days >= 2 AS is_stale, days || ' days old' AS label
           FROM (SELECT ticker, date_sub('second', max(last_fetched), TIMESTAMP '2024-01-31') // 86400 AS days
                 FROM t_fetches GROUP BY ticker)
           UNION ALL SELECT DISTINCT 'X' || ticker, NULL, TRUE, 'never fetched' FROM t_fetches""",
    ),
    "freshness_skip_list": Query(
        lambda t: freshness.freshness_skip_list(t.ingestion_log, now=NOW, threshold_days=8, required=FIVE_TYPES),
        """SELECT ticker FROM (SELECT ticker, data_type, max(last_fetched) AS f FROM t_fetches GROUP BY 1, 2)
           WHERE date_sub('second', f, TIMESTAMP '2024-01-31') // 86400 < 8 GROUP BY ticker HAVING count(*) = 5""",
    ),
    "freshness_update": Query(
        _updates,
        f"""SELECT ticker, data_type,
                   CASE WHEN data_type IN ('click', 'view') THEN last_fetched + INTERVAL 1 DAY ELSE last_fetched END
                       AS last_fetched,
                   CASE WHEN data_type IN ('click', 'view') THEN 'success' ELSE status END AS status,
                   CASE WHEN data_type IN ('click', 'view') THEN record_count + 1 ELSE record_count END AS record_count
            FROM ({LATEST_SQL})""",
    ),
    "agg_freshness_stats": Query(
        lambda t: aggregates.freshness_stats(t.ingestion_log, now=NOW, threshold_days=2),
        """SELECT avg(days) AS avg_age_days, max(days) AS max_age_days, min(days) AS min_age_days,
                  count(*) FILTER (WHERE days >= 2) AS stale_symbols
           FROM (SELECT date_sub('second', max(last_fetched), TIMESTAMP '2024-01-31') // 86400 AS days
                 FROM t_fetches GROUP BY ticker)""",
    ),
    "ingest_run_summary": Query(
        lambda t: freshness.ingest_run_summary(t.ingestion_log),
        """SELECT count(*) FILTER (WHERE status = 'success') AS n_success,
                  count(*) FILTER (WHERE status = 'failed') AS n_failed,
                  count(*) FILTER (WHERE status = 'skipped') AS n_skipped, avg(duration_ms) AS avg_duration_ms,
                  CAST(sum(record_count) FILTER (WHERE status = 'success') AS BIGINT) AS total_rows FROM t_fetches""",
        {"avg_duration_ms": 6},
    ),
    "ingest_failures": Query(
        lambda t: freshness.ingest_failures(t.ingestion_log),
        """SELECT event_id, ticker, data_type, last_fetched FROM t_fetches WHERE status = 'failed'
           ORDER BY event_id LIMIT 10""",
    ),
}

# -- query log -----------------------------------------------------------------------


def _requests(t):
    """The log as requests: repeats of a text within the minute count as hits."""
    return t.file("events").select(
        (F.col("event_id") % 3 == 0).alias("is_hit"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("latency_ms")
    )


def _dependent_entries(t):
    symbols = F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("s"), (F.col("event_id") % 9).cast("string")))
    return t.file("events").select(F.col("event_id").alias("entry"), symbols.alias("symbols"))


def _refreshed(t):
    return t.ingestion_log.filter("status = 'success' AND last_fetched >= TIMESTAMP_NTZ'2024-01-30 12:00:00'").select("ticker")


QUERY_LOG = {
    "query_log_stats": Query(
        lambda t: querylog.query_log_stats(t.query_log),
        """SELECT count(*) AS total_queries, count(*) FILTER (WHERE is_favorite) AS favorites_count,
                  count(error_message) AS failed_queries,
                  CAST(count(*) - count(error_message) AS DOUBLE) / count(*) * 100 AS success_rate,
                  round(avg(execution_time_ms), 2) AS avg_execution_time_ms FROM t_log""",
    ),
    "query_log_repeats": Query(
        lambda t: querylog.query_log_repeats(t.query_log),
        """SELECT user_query, count(*) AS n FROM t_log GROUP BY user_query HAVING count(*) > 1
           ORDER BY n DESC, user_query LIMIT 5""",
    ),
    "query_log_recent": Query(
        lambda t: querylog.query_log_recent(t.query_log), "SELECT * FROM t_log ORDER BY timestamp DESC, id DESC LIMIT 10"
    ),
    "query_log_favorites": Query(
        lambda t: querylog.query_log_favorites(t.query_log), "SELECT * FROM t_log WHERE is_favorite"
    ),
    "query_log_search": Query(
        lambda t: querylog.query_log_search(t.query_log, "NOTE 4"),
        """SELECT * FROM t_log WHERE lower(user_query) LIKE '%note 4%' OR lower(notes) LIKE '%note 4%'
           ORDER BY timestamp DESC, id DESC LIMIT 20""",
    ),
    "query_log_prune": Query(
        lambda t: querylog.query_log_prune(t.query_log, 1000),
        "SELECT * FROM t_log ORDER BY timestamp DESC, id DESC LIMIT 1000",
    ),
    "query_log_to_turns": Query(
        lambda t: querylog.query_log_to_turns(t.query_log),
        """SELECT 'legacy-' || id AS conversation_id, 'user' AS role, user_query AS content,
                  '{"generated_sql":"' || generated_sql || '","row_count":' || row_count || ',"execution_time_ms":'
                      || execution_time_ms || ',"source":"legacy_migration"}' AS metadata, timestamp AS created_at
           FROM t_log""",
    ),
    "cache_hit_stats": Query(
        lambda t: querylog.cache_hit_stats(_requests(t)),
        """SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS hits, count(*) FILTER (WHERE event_id % 3 <> 0) AS misses,
                  count(*) AS total_requests,
                  CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS DOUBLE) / count(*) * 100 AS hit_rate_pct,
                  count(value) FILTER (WHERE event_id % 10 <> 0) AS latency_samples,
                  avg(value) FILTER (WHERE event_id % 10 <> 0) AS avg_latency_ms FROM events""",
        {"avg_latency_ms": 6},
    ),
    "invalidate_by_symbol": Query(
        lambda t: querylog.invalidate_by_symbol(_dependent_entries(t), "entry", "symbols", _refreshed(t)),
        """SELECT event_id AS entry FROM events
           WHERE user_id IN (SELECT user_id FROM events WHERE event_type NOT IN ('error', 'view')
                             AND ts >= TIMESTAMP '2024-01-30 12:00:00')""",
    ),
}

# -- conversations -------------------------------------------------------------------

METRIC_LIST = ", ".join(f"('{m}')" for m in conversations.METRIC_WORDS)
BUDGET = 120

CONVERSATIONS = {
    "conversation_history": Query(
        lambda t: conversations.conversation_history(t.turns, 3),
        """SELECT conv_id, turn, role, text FROM conversations
           QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""",
    ),
    "conversation_window": Query(
        lambda t: conversations.conversation_window(t.turns, 3),
        """SELECT conv_id, turn, role, text
           FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r,
                        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f,
                        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
           WHERE r <= 3 OR n <= 4 OR (f = 1 AND role = 'system')""",
    ),
    "conversation_token_budget": Query(
        lambda t: conversations.conversation_token_budget(t.turns, BUDGET, 2),
        f"""SELECT conv_id, turn, role, text
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r,
                         row_number() OVER w = 1 AND role = 'system' AS is_system,
                         coalesce(CASE WHEN first_value(role) OVER w = 'system'
                                       THEN first_value(length(text) // 4) OVER w END, 0) AS system_cost,
                         sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS to_end
                  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
            WHERE r <= 2 OR is_system OR to_end + system_cost <= {BUDGET}""",
    ),
    "conversation_context": Query(
        lambda t: conversations.conversation_context(t.turns),
        f"""SELECT DISTINCT conv_id, 'symbol' AS kind, item, CAST(NULL AS BIGINT) AS turn
            FROM (SELECT conv_id, unnest({WORDS_SQL.format("replace(upper(text), 'ẞ', 'SS')")}) AS item FROM conversations)
            WHERE regexp_full_match(item, '[A-Z]{{1,5}}')
            UNION ALL SELECT DISTINCT conv_id, 'metric', m, NULL FROM conversations, (VALUES {METRIC_LIST}) v(m)
            WHERE contains(lower(text), m)
            UNION ALL SELECT conv_id, 'question', text, turn FROM (
                SELECT * FROM conversations WHERE role = 'user'
                QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)""",
    ),
}

# -- streams ---------------------------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _event_stream(t):
    """The events in five files whose order has nothing to do with time, one file a batch."""
    shuffled = jobs.scratch_table(t.spark, "events")
    events = t.spark.read.schema(EVENTS).parquet(t.stream_path("events"))
    events.repartition(5, F.xxhash64("event_id")).write.parquet(shuffled)
    return t.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(shuffled)


def _ticks(rows):
    return rows.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        utc_instant("ts").alias("ts"),
        F.col("value").alias("price"),
        (F.col("event_id") % 500).alias("size"),
        F.col("event_id").alias("seq"),
    )


def _stream_bars(t):
    table, log = jobs.scratch_table(t.spark, "bars"), jobs.scratch_table(t.spark, "bars-log")
    return jobs.stream_daily_bars(_ticks(_event_stream(t)), table, log)


def _arrivals(rows):
    day = F.date_trunc("day", F.col("ts"))
    return rows.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.to_date("ts").alias("date"),
        day.cast("timestamp").alias("ts"),
    )


def _stream_unique(t):
    path, log = jobs.scratch_table(t.spark, "unique"), jobs.scratch_table(t.spark, "unique-log")
    return jobs.stream_dedupe(_arrivals(_event_stream(t)), path, log).select("ticker", "date")


def _fetch_stream(rows):
    return rows.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("event_type").alias("data_type"),
        F.col("ts").alias("last_fetched"),
    )


def _stream_last_seen(t):
    table, log = jobs.scratch_table(t.spark, "seen"), jobs.scratch_table(t.spark, "seen-log")
    jobs.stream_freshness(_fetch_stream(_event_stream(t)), table, log)
    return store.read_table(t.spark, table)


# The numeric fields of the statement documents, so that no batch has to look for them.
FIELDS = (
    "ebitda",
    "freeCashFlow",
    "grossProfit",
    "netIncome",
    "operatingCashFlow",
    "operatingIncome",
    "shareholderEquity",
    "totalAssets",
    "totalLiabilities",
    "totalRevenue",
)
STATEMENTS = "ticker string, date string, income_statement string, balance_sheet string, cash_flow string"


def _stream_statements(t):
    """Statement documents in chunks of two files, loaded twice."""
    raw, table = jobs.scratch_table(t.spark, "raw"), jobs.scratch_table(t.spark, "annual")
    statement_documents(t.annual).repartition(4).write.json(raw)

    def load():
        chunks = t.spark.readStream.schema(STATEMENTS).option("maxFilesPerTrigger", 2).json(raw)
        log = jobs.scratch_table(t.spark, "annual-log")
        jobs.stream_upsert(chunks, table, log, lambda docs: etl.flatten_statements(docs, FIELDS))

    load()
    load()
    return store.read_table(t.spark, table)


STREAMS = {
    "stream_upsert": Query(_stream_statements, "SELECT * FROM t_annual"),
    "stream_daily_bars": Query(
        _stream_bars,
        """SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open,
                  max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
                  CAST(sum(event_id % 500) AS BIGINT) AS volume
           FROM events GROUP BY 1, 2""",
    ),
    "stream_dedupe": Query(
        _stream_unique, "SELECT DISTINCT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date FROM events"
    ),
    "stream_freshness": Query(
        _stream_last_seen,
        """SELECT ticker, data_type, max(last_fetched) AS last_fetched, count(*) AS fetches
           FROM t_fetches GROUP BY 1, 2""",
    ),
}

QUERIES = TEXT | FRESHNESS | QUERY_LOG | CONVERSATIONS | STREAMS
