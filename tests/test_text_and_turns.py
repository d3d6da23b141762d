"""Conversations against a plain implementation, periods, ranks, and text rules."""

import random
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from equispark.functions.dates import period_bounds
from equispark.functions.text import mask_tail, money_text, redact_connection, report_text
from equispark.operators import conversations, etl, series, text
from equispark.operators.ordering import exact_quantiles, global_row_number

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def made_up_turns(seed, longest=30):
    rng = random.Random(seed)
    out = []
    for conv in range(12):
        size = rng.randint(1, longest)
        for turn in range(size):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant"])
            out.append((conv, turn, role, "x" * rng.choice([0, 3, 40, 200, 900])))
    return out


def kept_by_budget(turns, budget, preserve):
    """Newest first until the first turn that does not fit, one conversation at a time."""
    kept = set()
    for conv in {t[0] for t in turns}:
        own = sorted(t for t in turns if t[0] == conv)
        head = [own[0]] if own[0][2] == "system" else []
        recent = own[-preserve:]
        middle = [t for t in own if t not in recent and t not in head]
        left = budget - sum(len(t[3]) // 4 for t in {*head, *recent})
        for t in reversed(middle):
            cost = len(t[3]) // 4
            if cost > left:
                break
            left -= cost
            kept.add(t[:2])
        kept |= {t[:2] for t in head + recent}
    return kept


@pytest.mark.parametrize("seed,budget,preserve", [(1, 300, 5), (2, 0, 2), (3, 120, 3), (4, 10**6, 5), (5, 450, 1)])
def test_token_budget(spark, monkeypatch, seed, budget, preserve):
    monkeypatch.setattr(conversations, "CHUNK_TURNS", 4)
    turns = made_up_turns(seed)
    frame = spark.createDataFrame(turns, SCHEMA)
    out = conversations.conversation_token_budget(frame, budget, preserve).collect()
    assert len(out) == len({(r.conv_id, r.turn) for r in out})
    assert {(r.conv_id, r.turn) for r in out} == kept_by_budget(turns, budget, preserve)


def test_token_budget_reads_texts_once(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = conversations.conversation_token_budget(frame, 120, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


@pytest.mark.parametrize("n", [1, 3, 10])
def test_window_keeps_the_opening(spark, n):
    turns = made_up_turns(9, 12)
    expected = set()
    for conv in {t[0] for t in turns}:
        own = sorted(t for t in turns if t[0] == conv)
        kept = own if len(own) <= n + 1 else own[-n:]
        expected |= {t[:2] for t in kept} | {t[:2] for t in own[:1] if t[2] == "system"}
    out = conversations.conversation_window(spark.createDataFrame(turns, SCHEMA), n).collect()
    assert sorted((r.conv_id, r.turn) for r in out) == sorted(expected)


def test_context_reads_words_in_any_script(spark):
    turns = [(1, 0, "user", "Is AAPL's Free Cash Flow up? été"), (1, 1, "assistant", "groß, x_1 no"), (1, 2, "user", "ok")]
    out = conversations.conversation_context(spark.createDataFrame(turns, SCHEMA), 1).collect()
    found = lambda kind: {r.item for r in out if r.kind == kind}
    assert found("symbol") == {"IS", "AAPL", "S", "FREE", "CASH", "FLOW", "UP", "GROSS", "NO", "OK"}
    assert found("metric") == {"cash flow", "free cash flow"}
    assert found("question") == {"ok"}


@settings(max_examples=200, deadline=None)
@given(st.dates(date(1990, 1, 1), date(2090, 12, 31)), st.integers(1, 40))
def test_periods(as_of, n):
    start, end = period_bounds("last_quarter", as_of)
    assert end < as_of and (end + timedelta(days=1)).day == 1
    this_start, this_end = period_bounds("this_quarter", as_of)
    assert this_start <= as_of <= this_end and this_start - timedelta(days=1) == end
    assert start.month in (1, 4, 7, 10) and start.day == 1
    back, same = period_bounds("last_n_months", as_of, n=n)
    assert same == as_of and (as_of.year - back.year) * 12 + as_of.month - back.month == n
    assert back.day == as_of.day or (back.day < as_of.day and (back + timedelta(days=1)).day == 1)
    assert period_bounds("last_n_days", as_of, n=n)[0] == as_of - timedelta(days=n)
    assert period_bounds("quarter", as_of, year=2024, quarter=1) == (date(2024, 1, 1), date(2024, 3, 31))


def test_unknown_period():
    with pytest.raises(ValueError):
        period_bounds("someday", date(2020, 1, 1))


def test_global_numbers_and_quartile(spark):
    rows = [(f"T{i:03d}", date(2000, 12, 31), float((i * 7919) % 97)) for i in range(103)]
    frame = spark.createDataFrame(rows, "ticker string, date date, roe double")
    numbered = global_row_number(frame, [F.desc("roe"), F.asc("ticker")]).collect()
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [r.ticker for r in sorted(numbered, key=lambda r: r.row_no)] == [r[0] for r in order]
    assert sorted(r.row_no for r in numbered) == list(range(1, 104))
    top = series.top_quartile(frame, 2000).collect()
    assert {r.ticker for r in top} == {r[0] for r in order[:26]}


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), rng.choice([None, float(rng.randint(0, 40))])) for _ in range(500)]
    out = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0.0, 0.25, 0.9]).collect()
    assert len(out) == 2
    for r in out:
        own = sorted(v for k, v in rows if k == r.k and v is not None)
        for share, got in zip((0.0, 0.25, 0.9), (r.q0, r.q1, r.q2)):
            place = (len(own) - 1) * share
            low, high = own[int(place)], own[min(int(place) + 1, len(own) - 1)]
            assert got == pytest.approx(low + (high - low) * (place - int(place)))


def test_report_formats(spark):
    values = spark.createDataFrame([(1.005,), (-182665.0,), (2.5e12,), (None,), (float("nan"),), (999.995,)], "v double")
    out = values.select(money_text(F.col("v")).alias("m"), report_text("net_margin", F.col("v")).alias("r")).collect()
    expect = lambda v: "N/A" if v is None or v != v else f"{v * 100:.2f}%"
    assert [r.m for r in out][:3] == [f"${1.005:.2f}", f"${-182.665:.2f}K", "$2.50T"]
    assert [r.r for r in out] == [expect(r.v) for r in values.collect()]
    volume = values.select(report_text("volume", F.lit(1234567)).alias("v")).first()
    assert volume.v == "1,234,567"


def test_redaction(spark):
    rows = [("mongodb://u:secret@host/db and x",), ("no url a:b@c",), (None,)]
    frame = spark.createDataFrame(rows, "t string")
    out = [r.t for r in frame.select(redact_connection(F.col("t")).alias("t")).collect()]
    assert out == ["mongodb://u:***@host/db and x", "no url a:b@c", None]
    masks = frame.select(mask_tail(F.lit("abcdefgh")).alias("a"), mask_tail(F.lit("abcd")).alias("b")).first()
    assert (masks.a, masks.b) == ("****efgh", "***")


def test_close_names_against_all_pairs(spark):
    frame = spark.createDataFrame([("finacials",), ("prises",), ("zzz",), ("finacials",)], "n string")
    out = text.close_names(frame, "n", ["financials", "prices", "ratios"]).collect()
    assert [(r.given, r.candidate, r.place) for r in sorted(out)] == [("finacials", "financials", 1), ("prises", "prices", 1)]


def test_incremental_load(spark):
    day = lambda d: date(2020, 1, d)
    stored = spark.createDataFrame([("A", day(3)), ("B", day(9))], "ticker string, date date")
    rows = [("A", day(3)), ("A", day(4)), ("B", day(9)), ("C", day(1)), ("C", date(2018, 1, 1))]
    incoming = spark.createDataFrame(rows, "ticker string, date date")
    out = etl.incremental_since_last(incoming, stored, day(10)).collect()
    assert sorted((r.ticker, r.date) for r in out) == [("A", day(4)), ("C", day(1))]
