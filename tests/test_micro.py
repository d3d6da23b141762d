"""Hand-computed cases at the edges of the definitions."""

import re
from datetime import date, datetime, timedelta
from decimal import ROUND_HALF_EVEN, Decimal, getcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from equispark.operators import analyst, etl, fundamentals, fx, instruments, technical, text
from equispark.registry.all import QUERIES


def bars(spark, closes, ticker="A"):
    rows = [(ticker, date(2020, 1, 1) + timedelta(days=i), c, 10) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint")


def column(frame, name, *order):
    return [r[name] for r in frame.orderBy(*(order or ("date",))).collect()]


def test_rsi_edges(spark):
    assert column(technical.technical_rsi(bars(spark, [10.0])), "rsi_14") == [100.0]
    assert column(technical.technical_rsi(bars(spark, [5.0, 5.0, 5.0])), "rsi_14") == [100.0] * 3
    falling = column(technical.technical_rsi(bars(spark, [9.0, 8.0, 7.0])), "rsi_14")
    assert falling == [100.0, 0.0, 0.0]
    mixed = column(technical.technical_rsi(bars(spark, [10.0, 12.0, 11.0])), "rsi_14")
    assert mixed[2] == pytest.approx(100 - 100 / (1 + 2.0))


def test_bollinger_needs_two_rows(spark):
    out = technical.technical_bollinger(bars(spark, [10.0, 12.0])).orderBy("date").collect()
    assert (out[0].bb_upper, out[0].bb_middle, out[0].bb_lower) == (None, 10.0, None)
    assert out[1].bb_upper == pytest.approx(11 + 2 * 2**0.5)


def test_long_frames_equal_plain_frames(spark):
    closes = [None if i % 7 == 3 else float((i * 37) % 101) for i in range(600)]
    rows = [("A", i, c, i) for i, c in enumerate(closes)]
    frame = spark.createDataFrame(rows, "ticker string, n int, close double, volume bigint").select(
        "ticker", F.date_add(F.lit(date(2000, 1, 1)), F.col("n")).alias("date"), "close", "volume"
    )
    got = {r.date: r for r in technical.technical_indicators(frame).collect()}
    start = date(2000, 1, 1).toordinal()
    for i in range(len(closes)):
        held = got.get(date.fromordinal(start + i))
        last = lambda n: [c for c in closes[max(0, i - n + 1) : i + 1] if c is not None]
        if not last(20):
            assert held is None
            continue
        for name, n in (("sma_20", 20), ("sma_50", 50), ("sma_200", 200), ("ema_12", 12), ("ema_26", 26)):
            expected = sum(last(n)) / len(last(n)) if last(n) else None
            assert held[name] == pytest.approx(expected, abs=1e-9), (i, name)
        assert held.week_52_high == max(last(252)) and held.week_52_low == min(last(252))


def test_repeated_bars_fail(spark):
    twice = bars(spark, [1.0]).unionByName(bars(spark, [2.0]))
    with pytest.raises(Exception, match="repeated"):
        technical.one_bar_per_day(twice).collect()
    assert technical.one_bar_per_day(bars(spark, [1.0, 2.0])).count() == 2


def test_true_ema(spark):
    out = column(technical.ema_true(bars(spark, [10.0, 13.0, 16.0]), (3,)), "ema_true_3")
    assert out == pytest.approx([10.0, 11.5, 13.75])


def statements(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, totalRevenue double, netIncome double")


def test_growth_gaps_and_fan_out(spark):
    frame = statements(
        spark,
        [
            ("A", date(2018, 12, 31), 100.0, 10.0),
            ("A", date(2018, 6, 30), 80.0, -5.0),
            ("A", date(2019, 12, 31), 120.0, 12.0),
            ("A", date(2021, 12, 31), 150.0, 15.0),
            ("A", None, 1.0, 1.0),
        ],
    )
    out = fundamentals.growth_annual(frame).collect()
    by_year = {}
    for r in out:
        by_year.setdefault(r.date and r.date.year, []).append(r)
    assert [r.prior_revenue for r in by_year[2021]] == [None]
    assert sorted(r.prior_revenue for r in by_year[2019]) == [80.0, 100.0]
    assert {r.prior_revenue: r.income_growth_yoy for r in by_year[2019]} == {80.0: None, 100.0: pytest.approx(0.2)}
    assert by_year[None][0].prior_revenue is None


def test_valuation_keeps_both_prior_filings(spark):
    annual = spark.createDataFrame(
        [
            ("A", date(2018, 12, 31), 100.0, 10.0, 50.0, 1.0),
            ("A", date(2018, 6, 30), 80.0, 10.0, 50.0, 1.0),
            ("A", date(2019, 12, 31), 120.0, 12.0, 60.0, 1.0),
        ],
        "ticker string, date date, totalRevenue double, netIncome double, shareholderEquity double, totalAssets double",
    )
    dividends = spark.createDataFrame([("A", date(2019, 12, 1), 2.0)], "ticker string, date date, amount double")
    metadata = spark.createDataFrame([("A", 1000.0), ("B", 5.0)], "ticker string, marketCap double")
    out = fundamentals.valuation_metrics(bars(spark, [10.0]), annual, dividends, metadata, as_of=date(2020, 1, 2))
    rows = out.collect()
    assert sorted(r.peg_ratio for r in rows) == pytest.approx(sorted([1000 / 12 / 20, 1000 / 12 / 50]))
    for r in rows:
        assert (r.pe_ratio, r.ps_ratio) == pytest.approx((1000 / 12, 1000 / 120))
        assert (r.dividend_yield, r.cap_class) == (0.2, "Small Cap")


@pytest.mark.parametrize("denominator", [0.0, -5.0, None])
def test_ratio_guards(spark, denominator):
    frame = spark.createDataFrame(
        [("A", date(2020, 1, 1), 10.0, 3.0, denominator, denominator, 4.0, 1.0, 1.0, 1.0, 1.0)],
        "ticker string, date date, totalRevenue double, netIncome double, shareholderEquity double, totalAssets double, "
        "totalLiabilities double, operatingCashFlow double, freeCashFlow double, grossProfit double, ebitda double",
    )
    row = fundamentals.ratios_financial(frame).first()
    assert (row.net_margin, row.roe, row.roa, row.debt_ratio) == (0.3, None, None, None)


def test_consensus_labels_at_the_edges(spark):
    rows = [
        ("none", 0, 0, 0, 0, 0),
        ("1.5", 1, 1, 0, 0, 0),
        ("2.5", 0, 1, 1, 0, 0),
        ("3.5", 0, 0, 1, 1, 0),
        ("4.5", 0, 0, 0, 1, 1),
        ("5", 0, 0, 0, 0, 3),
    ]
    frame = spark.createDataFrame(rows, "ticker string, strong_buy int, buy int, hold int, sell int, strong_sell int")
    out = analyst.analyst_consensus(frame.withColumn("date", F.lit(date(2020, 1, 1)))).collect()
    assert {r.ticker: r.consensus_label for r in out} == {
        "none": None,
        "1.5": "Strong Buy",
        "2.5": "Buy",
        "3.5": "Hold",
        "4.5": "Sell",
        "5": "Strong Sell",
    }


RATES = "base_currency string, quote_currency string, date date, rate double"


def test_fx_routes(spark):
    day = date(2020, 6, 1)
    rates = spark.createDataFrame(
        [("EUR", "USD", day, 1.25), ("USD", "GBP", day, 0.5), ("USD", "CHF", day, 0.0)], RATES
    )
    asked = [("EUR", "USD"), ("GBP", "USD"), ("EUR", "GBP"), ("GBP", "EUR"), ("JPY", "JPY"), ("CHF", "USD"), ("SEK", "USD")]
    facts = spark.createDataFrame([(100.0, a, b, day) for a, b in asked], "amount double, src string, dst string, d date")
    out = {(r.src, r.dst): r for r in fx.fx_convert(facts, rates, "amount", "src", "dst", "d").collect()}
    assert {k: (r.route, r.converted) for k, r in out.items()} == {
        ("EUR", "USD"): ("direct", 125.0),
        ("GBP", "USD"): ("inverse", 200.0),
        ("EUR", "GBP"): ("cross", 62.5),
        ("GBP", "EUR"): ("cross", 160.0),
        ("JPY", "JPY"): ("same", 100.0),
        ("CHF", "USD"): (None, None),
        ("SEK", "USD"): (None, None),
    }
    assert out[("SEK", "USD")].error == "SEK/USD"
    exact = fx.fx_rate_exact(facts, rates, F.col("src"), F.col("dst"), F.col("d")).collect()
    assert {(r.src, r.dst): r.fx_rate for r in exact}[("GBP", "USD")] == 2.0


def test_nearest_rate_ties_and_gaps(spark):
    rates = spark.createDataFrame([("EUR", "USD", date(2020, 6, 1), 1.0), ("EUR", "USD", date(2020, 6, 5), 2.0)], RATES)
    days = [date(2020, 6, 3), date(2020, 6, 4), date(2020, 6, 12), date(2020, 6, 13), date(2020, 5, 25)]
    facts = spark.createDataFrame([(d,) for d in days], "d date")
    out = fx.fx_rate_nearest(facts, rates, F.lit("EUR"), F.lit("USD"), F.col("d")).collect()
    assert {r.d.isoformat(): (r.fx_rate, r.gap_days) for r in out} == {
        "2020-06-03": (1.0, 2),
        "2020-06-04": (2.0, 1),
        "2020-06-12": (2.0, 7),
        "2020-06-13": (None, None),
        "2020-05-25": (1.0, 7),
    }


def test_missing_rate_is_small_cap(spark):
    caps = spark.createDataFrame([(None,), (2e9,), (1e10,)], "cap double")
    out = caps.select(fx.market_cap_category(F.col("cap")).alias("c")).collect()
    assert [r.c for r in out] == ["Small Cap", "Mid Cap", "Large Cap"]


def test_money_is_half_even(spark):
    rows = [(0.0001, 0.5), (0.0003, 0.5), (1.0, 0.0), (1e6, 0.0000394), (1e6, 0.0000004)]
    facts = spark.createDataFrame(rows, "amount double, rate double")
    out = fx.fx_money_convert(facts, "amount", "rate").collect()
    assert [r.converted for r in out] == [Decimal("0.0000"), Decimal("0.0002"), None, Decimal("39.4000"), Decimal("0.4000")]
    assert out[2].error == "rate must be positive"


def test_money_at_any_rate(spark):
    """Small and large rates, negative amounts, and what does not fit, against Python's decimals."""
    amounts = ["0.0001", "-0.0003", "12345678901234.5678", "-98765.4321", "999999999999999.9999"]
    factors = ["0.0000004", "1500000", "0.5", "1.000000000000000001", "149.123456789", "99999999999999999999"]
    schema = "amount decimal(20,4), rate decimal(38,18)"
    facts = spark.createDataFrame([(Decimal(a), Decimal(f)) for a in amounts for f in factors], schema)
    getcontext().prec = 80
    for row in fx.fx_money_convert(facts, "amount", "rate").collect():
        exact = (row.amount * row.rate).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)
        fits = abs(exact) < 10**34
        assert (row.converted, row.error) == ((exact, None) if fits else (None, "out of range")), row
    wide = spark.createDataFrame([(1e16, 1.0), (1.0, 1e21), (None, 1.0), (1.0, None), (1.0, -2.0)], "amount double, rate double")
    out = fx.fx_money_convert(wide, "amount", "rate").collect()
    assert [r.error for r in out] == ["out of range", "out of range", None, "rate must be positive", "rate must be positive"]
    assert all(r.converted is None for r in out)


def test_fx_convert_reads_its_facts_twice(spark):
    plan = QUERIES["fx_convert"].frame(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and len(re.findall(r"Relation .*l_orderkey", plan)) <= 3  # twice the facts, once the rates


def test_pairs_of_close_names_are_complete(spark):
    draw = np.random.default_rng(4)
    word = lambda: "".join(draw.choice(list("abc"), int(draw.integers(0, 9))))
    given, known = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    for floor in (0.5, 0.75, 1.0):
        frames = [spark.createDataFrame([(w,) for w in own], "w string") for own in (given, known)]
        got = {(r.given, r.candidate) for r in text.close_pairs(frames[0], "w", frames[1], "w", floor).collect()}
        wanted = {(a, b) for a in given for b in known if 1 - edits(a, b) / max(len(a), len(b), 1) >= floor}
        assert got == wanted


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_ema_over_block_boundaries(spark):
    closes = [float(v) for v in np.random.default_rng(6).uniform(5, 50, 300)]
    for block in (1, 7, 64, 500):
        out = column(technical.ema_true(bars(spark, closes), (12,), block), "ema_true_12")
        seen = closes[0]
        for got, close in zip(out, closes):
            seen += (close - seen) * 2 / 13
            assert got == pytest.approx(seen, rel=1e-11)


def test_flatten_rules(spark):
    documents = spark.createDataFrame(
        [
            ("A", "2020-12-31T21:00:00Z", '{"x": 1, "t": "5", "b": true}', '{"x": 2.5}', None),
            ("A", "", '{"x": 1}', None, None),
            ("", "2020-12-31", '{"x": 1}', None, None),
            ("B", "2020-12-31", '{"t": "n/a"}', "{}", None),
            ("C", "2020-12-31T22:00:00-05:00", None, None, '{"y": -3e2}'),
        ],
        "ticker string, date string, income_statement string, balance_sheet string, cash_flow string",
    )
    out = etl.flatten_statements(documents)
    assert out.columns == ["ticker", "date", "x", "y"]
    assert sorted(tuple(r) for r in out.collect()) == [
        ("A", date(2020, 12, 31), 2.5, None),
        ("C", date(2021, 1, 1), None, -300.0),
    ]


def test_field_names(spark):
    labels = ["Net Income", "net income common stockholders", "Totalrevenue", "R&D spend-2x", "###"]
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    out = {r.label: r.field for r in etl.canonical_field_names(frame, "label").collect()}
    assert list(out.values()) == ["netIncome", "netIncome", "totalrevenue", "rDSpend2X", "###"]


def test_reporting_time_follows_daylight_saving(spark):
    frame = spark.createDataFrame([(date(2020, 1, 15),), (date(2020, 7, 15),)], "date date")
    out = [r.reported_at for r in etl.reporting_ts_utc(frame).orderBy("date").collect()]
    assert out == [datetime(2020, 1, 15, 21), datetime(2020, 7, 15, 20)]


def test_parse_dates(spark):
    texts = ["2020-01-02", "2020-01-02T23:30:00", "2020-01-02T23:30:00-05:00", "2020-01-02T00:30:00+02:00", "x", "", None,
             "2020-13-02", "2020-01-02 10:00:00Z"]
    frame = spark.createDataFrame([(x,) for x in texts], "text string")
    out = {r.text: r.parsed_date.isoformat() for r in etl.parse_dates(frame, "text").collect()}
    assert out == {
        "2020-01-02": "2020-01-02",
        "2020-01-02T23:30:00": "2020-01-02",
        "2020-01-02T23:30:00-05:00": "2020-01-03",
        "2020-01-02T00:30:00+02:00": "2020-01-01",
        "2020-01-02 10:00:00Z": "2020-01-02",
    }


def test_earnings_surprise(spark):
    rows = [(2.0, 0.0), (2.0, -4.0), (2.0, float("nan")), (None, 1.0), (3.0, 2.0)]
    frame = spark.createDataFrame(rows, "eps_actual double, eps_estimate double")
    out = [(r.eps_surprise, r.surprise_pct) for r in etl.earnings_surprise(frame).collect()]
    assert out == [(None, None), (6.0, 150.0), (None, None), (None, None), (1.0, 50.0)]


def test_etf_rules(spark):
    rows = [
        ("EQUITY", "Plain Co", None),
        ("equity", "Big etf", None),
        ("", "Blank", None),
        (None, "None", None),
        ("TRUST", "Other", None),
        ("STOCK", "Fletcher", "true"),
        ("STOCK", "Fletfold", None),
    ]
    frame = spark.createDataFrame(rows, "quoteType string, longName string, fundFamily string")
    assert [r.is_etf for r in instruments.flag_etf(frame).collect()] == [False, True, True, True, True, True, False]


def test_market_config():
    assert instruments.market_from_config({"mode": "mars"}) == instruments.GLOBAL
    custom = instruments.market_from_config({"mode": "custom", "custom": {"allowed_countries": []}})
    assert custom.countries is None and custom.no_etfs


@pytest.mark.parametrize("name", ["parse_dates", "prep_prices", "prep_dividends", "fx_money_convert"])
def test_generated_methods_are_small_enough_to_be_compiled(spark, name):
    """The JVM only interprets methods above 8000 bytes, whatever the session's own limit is."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name].frame(spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        code = spark._jvm.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_money_at_rates_far_below_zero(spark):
    schema = "__ decimal(20,4), rate decimal(38,18), `a.longer.name` int"
    facts = spark.createDataFrame([(Decimal("-1.5"), Decimal("-99999999999999999999.5"), 1), (Decimal("-1.5"), Decimal(2), 2)], schema)
    out = fx.fx_money_convert(facts, "__", "rate")
    assert out.columns == [*facts.columns, "error", "converted"]
    assert [(r.error, r.converted) for r in out.collect()] == [("rate must be positive", None), (None, Decimal("-3.0000"))]


def test_dates_are_parsed_once(spark):
    """A filter on the parsed date stays above it, so the plan holds the parsing once."""
    frame = spark.createDataFrame([("A", "2020-01-02T23:30:00-05:00"), ("A", "x"), ("", "2020-01-02"), ("B", "0001-01-01")], "ticker string, date string")
    for out in (etl.parse_dates(frame, "date"), etl.prep_splits(frame.withColumn("ratio", F.lit(2.0)))):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("T00:00:00Z") == 1
    assert [(r.ticker, r.date) for r in out.collect()] == [("A", date(2020, 1, 3)), ("B", date(1, 1, 1))]
