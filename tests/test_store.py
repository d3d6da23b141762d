"""Upserts, integrity, change sets, the refresh and templates."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from equispark.plans import refresh, templates
from equispark.plans.catalog import Tables, register_views
from equispark.registry.all import QUERIES
from equispark.registry.loading import statement_documents
from equispark.sources import store
from equispark.streaming import jobs

SCHEMA = "ticker string, date date, revenue bigint"
DAY = date(2020, 1, 1)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_upsert_rules(spark):
    old = spark.createDataFrame([("A", DAY, 1), ("B", DAY, 2), (None, DAY, 3)], SCHEMA)
    new = spark.createDataFrame([("A", DAY, 9, "x"), ("A", DAY, 8, "y"), (None, DAY, 7, "z")], SCHEMA + ", tag string")
    once = store.upsert_by_key(old, new)
    expected = sorted(
        [("B", DAY, 2, None), (None, DAY, 3, None), ("A", DAY, 9, "x"), ("A", DAY, 8, "y"), (None, DAY, 7, "z")], key=str
    )
    assert rows(once) == expected
    complete = new.filter("ticker IS NOT NULL")
    assert rows(store.upsert_by_key(store.upsert_by_key(old, complete), complete)) == rows(
        store.upsert_by_key(old, complete)
    )
    with pytest.raises(ValueError, match="key columns"):
        store.upsert_by_key(old, new.drop("date"))


def test_stored_upserts_follow_the_rule(spark, tmp_path):
    table = str(tmp_path / "t")
    old = spark.createDataFrame([("A", DAY, 1), ("B", DAY, 2), (None, DAY, 3), ("C", None, 4), ("D", date(2019, 5, 5), 5)], SCHEMA)
    new = spark.createDataFrame([("A", DAY, 9, "x"), ("A", DAY, 8, "y"), (None, DAY, 7, "z")], SCHEMA + ", tag string")
    store.upsert_table(old, table)
    store.upsert_table(new, table)
    got = store.read_table(spark, table)
    assert rows(got.select("ticker", "date", "revenue", "tag")) == rows(store.upsert_by_key(old, new))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="key columns"):
        store.upsert_table(new.drop("date"), table)


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    table = tmp_path / "t"
    days = [date(2019, 3, 1), date(2019, 4, 1), date(2020, 4, 1)]
    store.upsert_table(spark.createDataFrame([("A", day, 1) for day in days], SCHEMA), str(table), unit="month")
    files = lambda: {str(f): f.parent.name for f in table.rglob("part-*.parquet")}
    before = files()
    store.upsert_table(spark.createDataFrame([("A", days[1], 2), ("B", days[1], 3)], SCHEMA), str(table), unit="month")
    after = files()
    assert {before[f] for f in before.keys() - after.keys()} == {"part=m2019-04"}
    assert rows(store.read_table(spark, str(table))) == [("A", days[0], 1), ("A", days[1], 2), ("A", days[2], 1), ("B", days[1], 3)]
    assert rows(store.read_table(spark, str(table), 2019)) == [("A", days[0], 1), ("A", days[1], 2), ("B", days[1], 3)]


def test_a_load_is_seen_only_after_its_audit(spark, tmp_path):
    """Two loads of different days pass at tolerance 0, a short one raises and stays invisible."""
    bar = "ticker string, date string, open double, high double, low double, close double, adj_close double, volume bigint"
    days = lambda day, *tickers: spark.createDataFrame([(t, day, 1.0, 1.0, 1.0, 1.0, 1.0, 1) for t in tickers], bar)
    root = str(tmp_path)
    refresh.load({"raw_prices": days("2020-01-02T00:00:00Z", "A", "B")}, root, 0.0)
    refresh.load({"raw_prices": days("2020-01-03T00:00:00Z", "A", "B")}, root, 0.0)
    whole = rows(refresh.stored(spark, root, "prices_daily"))
    assert len(whole) == 4
    short = days("2020-01-04T00:00:00Z", "A").union(days("soon", "B"))
    with pytest.raises(ValueError, match="prices_daily: 2 source rows, 1 stored"):
        refresh.load({"raw_prices": short}, root, 0.0)
    assert rows(refresh.stored(spark, root, "prices_daily")) == whole
    refresh.load({"raw_prices": short}, root, 50.0)
    assert refresh.stored(spark, root, "prices_daily").count() == 5


def test_an_interrupted_publication_is_finished(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    one, two = (spark.createDataFrame([("A", DAY, n)], SCHEMA) for n in (1, 2))
    store.upsert_table(one, table)
    with monkeypatch.context() as broken:
        broken.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            store.upsert_table(two, table)
    assert rows(store.read_table(spark, table)) == [("A", DAY, 1)]
    store.finish(spark, table)
    assert rows(store.read_table(spark, table)) == [("A", DAY, 2)]


def test_tables_without_rows_have_their_columns(spark, tmp_path):
    for table in store.TABLE_TYPES:
        assert refresh.stored(spark, str(tmp_path), table).count() == 0
    store.upsert_table(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"))
    assert not store.has_rows(spark, str(tmp_path / "t"))


def test_replace_keeps_old_rows_when_nothing_comes(spark, tmp_path):
    table, frame = str(tmp_path / "t"), spark.createDataFrame([("A", DAY, 1)], SCHEMA)
    assert store.replace_table(frame, table)
    assert not store.replace_table(frame.filter("revenue > 1"), table)
    assert rows(store.read_table(spark, table)) == [("A", DAY, 1)]


def test_integrity_tolerance(spark):
    stored = spark.range(95)
    assert store.integrity_check(spark.range(100), stored, 5.0).first().ok
    assert not store.integrity_check(spark.range(100), stored, 4.9).first().ok
    assert store.integrity_check(spark.range(0), stored, 0.0).first().ok
    with pytest.raises(ValueError, match="100 source rows"):
        store.require_integrity(spark.range(100), stored, 1.0, "prices")


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_refresh_end_to_end(spark, tables, tmp_path):
    def documents(frame, column="date"):
        return frame.withColumn(column, F.concat(F.col(column).cast("string"), F.lit("T16:00:00Z")))

    fields = [c for c in tables.metadata.columns if c != "ticker"]
    raw = {
        "raw_annual": statement_documents(tables.annual),
        "raw_prices": documents(tables.prices),
        "raw_dividends": documents(tables.dividends),
        "raw_metadata": tables.metadata.select("ticker", F.struct(*fields).alias("metadata")),
        "raw_earnings": documents(tables.earnings_raw.withColumnRenamed("report_date", "date")),
        "raw_rates": documents(tables.rates),
    }
    out = refresh.refresh(raw, str(tmp_path), date(2001, 11, 4), tolerance_pct=0.0)
    again = refresh.refresh(raw, str(tmp_path), date(2001, 11, 4), tolerance_pct=0.0)
    assert set(out) == set(again)
    for name, expected in (("ratios_financial", tables.ratios), ("growth_annual", tables.growth)):
        assert rows(again[name].select(*expected.columns)) == rows(expected), name
    assert again["valuation_metrics"].count() == tables.valuation.count()
    multi = again["valuation_metrics_multicurrency"]
    assert multi.count() == tables.fx_valuation.count()
    assert rows(multi.select("ticker", "fx_rate")) == rows(tables.fx_valuation.select("ticker", "fx_rate"))
    stored = refresh.StoredTables(spark, str(tmp_path))
    for name, params in (
        ("top_revenue", {"year": 2000}),
        ("peer_group_comparison", {"metric": "netIncome", "peer_group": "FAANG", "year": 2000}),
        ("sector_analysis", {"year": 2000}),
    ):
        asked = templates.run_template(stored, name, params)
        plan = asked._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [((part" in plan, plan
    assert rows(templates.run_template(stored, "top_revenue", {"year": 2000})) == rows(templates.run_template(tables, "top_revenue", {"year": 2000}))
    assert again["technical_indicators"].count() == tables.indicators.count()
    assert again["analyst_consensus"].count() == 0 and "consensus_label" in again["analyst_consensus"].columns


def test_views_answer_sql(spark, tables):
    assert "valuation_metrics" in register_views(tables)
    sql = "SELECT r.ticker FROM ratios_financial r JOIN company_metadata m USING (ticker) WHERE year(date) = :y"
    assert spark.sql(sql, args={"y": 2000}).count() == tables.ratios.filter("year(date) = 2000").count()


@pytest.mark.parametrize("name", ["tpl_top_revenue", "tpl_peer_group_comparison", "tpl_sector_analysis", "year_extract", "peer_rank", "win_top_quartile"])
def test_year_questions_reach_the_scan(spark, name):
    plan = QUERIES[name].frame(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "l_shipdate" in line]
    assert scans and all("GreaterThanOrEqual(l_shipdate" in line and "LessThan(l_shipdate" in line for line in scans), plan


def test_templates_check_their_parameters(tables):
    with pytest.raises(KeyError):
        templates.run_template(tables, "nothing", {})
    with pytest.raises(ValueError, match="year"):
        templates.run_template(tables, "top_revenue", {})
    with pytest.raises(ValueError, match="metric"):
        templates.run_template(tables, "ticker_comparison", {"metric": "1; DROP", "tickers": ["A"]})
    assert templates.run_template(tables, "top_revenue", {"year": 2000, "limit": 2}).count() == 2


def test_capped_result(spark):
    assert templates.capped_result(spark.range(2000)).count() == 500
    with pytest.raises(ValueError):
        templates.capped_result(spark.range(2000), 5000)
    assert templates.capped_result(spark.range(2000), 7).count() == 7


def test_streams_do_not_overwrite_each_other(spark, tmp_path):
    table = str(tmp_path / "bars")
    for part, close in (("one", 1), ("two", 2)):
        source = str(tmp_path / part)
        spark.createDataFrame([(part, DAY, close), ("both", DAY, close)], SCHEMA).write.json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        jobs.drain_into(stream, table, str(tmp_path / f"log-{part}"), ("ticker", "date"))
    expected = [("both", DAY, 2), ("one", DAY, 1), ("two", DAY, 2)]
    assert rows(store.read_table(spark, table)) == expected
    more = str(tmp_path / "one")
    spark.createDataFrame([("both", DAY, 3)], SCHEMA).write.mode("append").json(more)
    jobs.drain_into(
        spark.readStream.schema(SCHEMA).json(more), table, str(tmp_path / "log-one"), ("ticker", "date")
    )
    expected[0] = ("both", DAY, 3)
    assert rows(store.read_table(spark, table)) == expected
