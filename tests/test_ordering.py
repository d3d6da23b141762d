"""Ranks and quantiles over ranges: right at their boundaries, and no hot group in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.operators import aggregates, screens
from equispark.operators.ordering import exact_quantiles, segmented_rank, with_range


def hot_rows(spark, distinct: int):
    """4,000 rows, nine tenths of them of one group, with `distinct` different values."""
    group = F.when(F.col("id") % 10 == 0, F.concat(F.lit("g"), F.col("id") % 7)).when(F.col("id") != 5, F.lit("hot"))
    value = F.pmod(F.xxhash64("id"), F.lit(distinct)).cast("double") - distinct // 2
    return spark.range(4000).select("id", group.alias("grp"), value.alias("v"))


@pytest.mark.parametrize("distinct", [1, 3, 40, 100_000])
def test_ranks_over_ranges_equal_a_window(spark, distinct):
    rows = hot_rows(spark, distinct)
    got = segmented_rank(rows, "grp", [-F.col("v")], "place_no", [F.col("id")], ranges=16)
    expected = rows.withColumn("place_no", F.rank().over(W.partitionBy("grp").orderBy(F.desc("v"))).cast("bigint"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_a_hot_group_is_spread(spark):
    rows = with_range(hot_rows(spark, 1), [F.col("grp"), F.col("v"), F.col("id")], 32)
    sizes = [r["count"] for r in rows.groupBy("grp", "range").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 4000 / 8


@pytest.mark.parametrize("distinct", [1, 2, 40, 100_000])
def test_quantiles_over_ranges(spark, distinct):
    rows = hot_rows(spark, distinct)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.grp: r[1:] for r in exact_quantiles(rows, "grp", "v", shares, ranges=16).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r.grp, []).append(r.v)
    assert set(got) == set(values)
    for group, own in values.items():
        assert np.allclose(got[group], np.quantile(own, shares), rtol=0, atol=1e-9)


def test_equal_values_cost_one_row(spark):
    """Nine tenths of the values are equal: what is searched has a row for each different value."""
    rows = spark.range(5000).select(F.lit("k").alias("k"), F.when(F.col("id") % 10 > 0, 1.0).otherwise(F.col("id")).alias("v"))
    plan = exact_quantiles(rows, "k", "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "count(1)" in plan
    assert exact_quantiles(rows, "k", "v", [0.5]).first().q0 == 1.0


def test_nothing_runs_before_the_query(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    rows = hot_rows(spark, 40).selectExpr("id AS ticker", "grp", "v AS m", "DATE'2000-06-30' AS date")
    frames = [
        aggregates.describe(rows, ["m"]),
        screens.peer_rank(rows.drop("grp"), rows.selectExpr("ticker", "grp AS peer_group"), "m", 2000),
    ]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    assert all(frame.count() for frame in frames)


def test_empty_tables(spark):
    rows = hot_rows(spark, 3).limit(0)
    assert segmented_rank(rows, "grp", [F.col("v")], "r").collect() == []
    assert exact_quantiles(rows, "grp", "v", [0.5]).collect() == []
