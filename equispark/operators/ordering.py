"""Ranks, positions and exact quantiles in a total order, without gathering the rows.

Rows are dealt over ranges of their sort key. A small table of the counts per
(group, range) supplies the offsets by running sums, so a group that holds most
of the rows is spread over as many tasks as it has ranges. The bounds come from
a sample that only the rows' own values decide, drawn inside the same query:
nothing runs before the query does and nothing is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from equispark.session import checkpoint_dir

DRAWN = 32  # sampled rows per range


def _ranges(rows: DataFrame) -> int:
    return max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_range(rows: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """The rows with `range`: the number of their range of the ascending order, of about equal sizes.

    Rows are drawn by the hash of their sort key against a threshold, so about
    `DRAWN` a range arrive, however many partitions the table has. Equal keys
    share a range: make the order total, or the rows distinct.
    """
    ranges = ranges or _ranges(rows)
    top = 1 << 31
    place = F.struct(*order)
    total = rows.agg(F.count("*").alias("n")).scalar()
    draw = F.pmod(F.xxhash64(place), F.lit(top))
    drawn = rows.filter(draw < F.lit(float(DRAWN * ranges * top)) / F.greatest(total, F.lit(1)))
    places = drawn.agg(F.array_sort(F.collect_set(place)).alias("places"))
    picks = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.get("places", F.floor(i * F.size("places") / ranges).cast("int")))
    bounds = places.select(F.array_distinct(F.filter(picks, lambda b: b.isNotNull())).alias("bounds")).scalar()
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(ranges.bit_length()))])
    search = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("bounds", low + step - 1) < place, low + step).otherwise(low))
    return rows.withColumn("bounds", bounds).withColumn("range", search).drop("bounds")


def _offsets(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before each range of a group, by running sums over its ranges."""
    before = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def segmented_rank(
    rows: DataFrame, group: str, order: Sequence[Column], name: str, unique: Sequence[Column] = (), ranges: int | None = None
) -> DataFrame:
    """The rows with their rank by `order` (ascending) inside their group, ties alike, as rank() gives it.

    `unique` columns part equal rows between ranges. A tie that began in an
    earlier range takes the rank it has there. Null groups are a group.
    """
    keyed = with_range(rows.withColumn("place", F.struct(*order)), [F.col(group), F.col("place"), *unique], ranges)
    counts = keyed.groupBy(F.col(group), "range", "place").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(group, "range").agg(
        F.sum("n").alias("n"),
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        F.max_by("n", "place").alias("tail"),
    )
    summed = _offsets(sizes, [group])
    # The rank of a range's last value, or of its tie's beginning where that lies further ahead.
    tie = W.partitionBy(group, "last")
    ended = summed.withColumn("began", F.min(F.col("offset") + F.col("n") - F.col("tail") + 1).over(tie))
    earlier = W.partitionBy(group).orderBy("range")
    carried = F.when(F.lag("last").over(earlier) == F.col("first"), F.lag("began").over(earlier))
    offsets = ended.select(F.col(group).alias("own"), F.col("range").alias("own_range"), "first", "offset", carried.alias("carried"))
    within = F.rank().over(W.partitionBy(group, "range").orderBy("place"))
    ranked = keyed.withColumn("within", within).join(
        offsets, F.col(group).eqNullSafe(F.col("own")) & (F.col("range") == F.col("own_range"))
    )
    tied = F.when(F.col("place") == F.col("first"), F.col("carried"))
    return ranked.withColumn(name, F.coalesce(tied, F.col("offset") + F.col("within")).cast("bigint")).drop(
        "place", "range", "within", "own", "own_range", "first", "offset", "carried"
    )


def global_row_number(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """1-based position in a total order of any sort columns, also descending text, which no range key expresses.

    The sorted range partitions are numbered and the small table of their sizes
    supplies the offsets. Range boundaries are sampled by Spark, so the sorted
    rows are checkpointed: both uses must see the same partitions, also after an
    executor is lost.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_dir(rows.sparkSession))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    tagged = sorted_rows.withColumn("mid", F.monotonically_increasing_id()).select(
        "*", F.shiftright("mid", 33).alias("range"), (F.col("mid").bitwiseAND((1 << 33) - 1)).alias("within")
    )
    offsets = _offsets(tagged.groupBy("range").agg(F.count("*").alias("n")), []).drop("n")
    numbered = tagged.join(offsets, "range").withColumn("row_no", F.col("offset") + F.col("within") + 1)
    return numbered.drop("range", "mid", "within", "offset")


def exact_quantiles(frame: DataFrame, key: str, value: str, shares: Sequence[float], ranges: int | None = None) -> DataFrame:
    """Interpolated quantiles per key, one column `q0`, `q1`, ... per share.

    The percentile aggregate keeps every distinct value of a key in one task.
    Here rows are reduced to (key, value, count) first, so equal values cost one
    row; running sums of the counts over the ranges of a key tell which range
    holds a wanted position, and only those ranges are looked into. Null keys
    are a key; null values are left out.
    """
    counted = frame.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    counted = with_range(counted.groupBy("key", "v").agg(F.count("*").alias("n")), [F.col("key"), F.col("v")], ranges)
    sizes = _offsets(counted.groupBy("key", "range").agg(F.sum("n").alias("n")), ["key"])
    whole = sizes.withColumn("total", F.sum("n").over(W.partitionBy("key")))
    share = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)]))
    at = (F.col("total") - 1) * F.col("share.s")
    ends = whole.select("*", share.alias("share")).select(
        F.col("key").alias("own"), F.col("range").alias("own_range"), "offset", "n", F.col("share.i").alias("i"), at.alias("at")
    )
    inside = lambda position: (position >= F.col("offset")) & (position < F.col("offset") + F.col("n"))
    wanted = ends.filter(inside(F.floor("at")) | inside(F.ceil("at"))).drop("n")
    upto = F.sum("n").over(W.partitionBy("key", "range").orderBy("v"))
    searched = wanted.select("own", "own_range").distinct()
    same = F.col("key").eqNullSafe(F.col("own")) & (F.col("range") == F.col("own_range"))
    summed = counted.join(searched, same, "left_semi").withColumn("upto", upto)
    met = summed.join(wanted, same).withColumn("end", F.col("offset") + F.col("upto")).withColumn("start", F.col("end") - F.col("n"))
    has = lambda position: (position >= F.col("start")) & (position < F.col("end"))
    near = met.filter(has(F.floor("at")) | has(F.ceil("at")))
    picks = []
    for i in range(len(shares)):
        of = F.col("i") == i
        picks += [
            F.min(F.when(of, F.col("v"))).alias(f"lo{i}"),
            F.max(F.when(of, F.col("v"))).alias(f"hi{i}"),
            F.max(F.when(of, F.col("at") - F.floor("at"))).alias(f"part{i}"),
        ]
    return near.groupBy("key").agg(*picks).select(
        F.col("key").alias(key),
        *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"q{i}") for i in range(len(shares))],
    )
