"""Rolling price indicators.

Everything runs over one window layout, partition by ticker and order by date,
so a plan holds a single shuffle and a single sort however many indicators it
computes, and Catalyst drops the ones nobody selects. A partition holds one
company's daily bars, at most one per calendar day, whatever the size of the
tick data the bars were aggregated from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from equispark.functions.numeric import pct_change, pos_div

YEAR_BARS = 252


def by_date() -> WindowSpec:
    return W.partitionBy("ticker").orderBy("date")


def last_rows(n: int) -> WindowSpec:
    """The current row and the n-1 before it; shorter at the start of a series."""
    return by_date().rowsBetween(1 - n, 0)


def mean_over(column: str | Column, n: int) -> Column:
    return F.avg(column).over(last_rows(n))


def one_bar_per_day(prices: DataFrame) -> DataFrame:
    """Fails the job on a repeated (ticker, date), checked in the same window pass."""
    repeated = F.lag("date").over(by_date()) == F.col("date")
    checked = prices.withColumn("repeated", F.coalesce(repeated, F.lit(False)))
    guard = F.when(F.col("repeated"), F.raise_error(F.lit("repeated (ticker, date) in prices")).cast("date"))
    return checked.withColumn("date", F.coalesce(guard, F.col("date"))).drop("repeated")


def long_mean(blocks: str, n: int, block: int) -> Column:
    """Mean of n rows out of the sums and counts of `block`-row frames.

    Spark walks a whole sliding frame for every row. Shifting the short frames
    costs one lag each, so 200 rows take 20 additions and 10 lags.
    """
    shifts = range(0, n, block)
    parts = [F.coalesce(F.lag(f"{blocks}_sum", k).over(by_date()), F.lit(0.0)) for k in shifts]
    counts = [F.coalesce(F.lag(f"{blocks}_n", k).over(by_date()), F.lit(0)) for k in shifts]
    return pos_div(sum(parts[1:], parts[0]), sum(counts[1:], counts[0]))


def long_extreme(column: str, pick, n: int, block: int) -> Column:
    """Greatest or least value of n rows out of those of `block`-row frames."""
    return pick(*[F.lag(column, k).over(by_date()) for k in range(0, n, block)])


def _short_frames(bars: DataFrame) -> DataFrame:
    lags = {f"close_{n}": F.lag("close", n).over(by_date()) for n in (1, 5, 20, 60, YEAR_BARS)}
    blocks = {}
    for n in (10, 13, 20):
        blocks[f"b{n}_sum"] = F.sum("close").over(last_rows(n))
        blocks[f"b{n}_n"] = F.count("close").over(last_rows(n))
    return bars.withColumns(
        lags
        | blocks
        | {
            "sma_20": mean_over("close", 20),
            "ema_12": mean_over("close", 12),
            "std_20": F.stddev_samp("close").over(last_rows(20)),
            "volume_avg_20": mean_over("volume", 20),
            "high_21": F.max("close").over(last_rows(21)),
            "low_21": F.min("close").over(last_rows(21)),
        }
    )


def technical_indicators(prices: DataFrame) -> DataFrame:
    """All indicators of the technical table.

    `ema_12` and `ema_26` are plain averages over 12 and 26 rows, as the table
    defines them; `ema_true` has the recursion. Frames are kept while they fill.
    """
    bars = _short_frames(prices.select("ticker", "date", "close", "volume"))
    step = F.col("close") - F.col("close_1")
    moved = bars.withColumns({"gain": F.when(step > 0, step).otherwise(0.0), "loss": F.when(step < 0, -step).otherwise(0.0)})
    long = moved.withColumns(
        {
            "sma_50": long_mean("b10", 50, 10),
            "sma_200": long_mean("b20", 200, 20),
            "ema_26": long_mean("b13", 26, 13),
            "week_52_high": long_extreme("high_21", F.greatest, YEAR_BARS, 21),
            "week_52_low": long_extreme("low_21", F.least, YEAR_BARS, 21),
            "avg_gain": mean_over("gain", 14),
            "avg_loss": mean_over("loss", 14),
        }
    )
    smoothed = long.withColumn("macd", F.col("ema_12") - F.col("ema_26")).withColumn("macd_signal", mean_over("macd", 9))
    rsi = (
        F.when(F.col("avg_loss") == 0, 100.0)
        .when(F.col("avg_gain") == 0, 0.0)
        .otherwise(100 - 100 / (1 + F.col("avg_gain") / F.col("avg_loss")))
    )
    band = 2 * F.col("std_20")
    return smoothed.filter("sma_20 IS NOT NULL").select(
        "ticker",
        "date",
        "close",
        "sma_20",
        "sma_50",
        "sma_200",
        "ema_12",
        "ema_26",
        rsi.alias("rsi_14"),
        "macd",
        "macd_signal",
        (F.col("macd") - F.col("macd_signal")).alias("macd_histogram"),
        (F.col("sma_20") + band).alias("bb_upper"),
        F.col("sma_20").alias("bb_middle"),
        (F.col("sma_20") - band).alias("bb_lower"),
        "volume_avg_20",
        F.when(F.col("volume_avg_20") > 0, F.col("volume").cast("double") / F.col("volume_avg_20")).alias("volume_ratio"),
        pct_change("close", "close_1").alias("pct_change_1d"),
        pct_change("close", "close_5").alias("pct_change_5d"),
        pct_change("close", "close_20").alias("pct_change_20d"),
        pct_change("close", "close_60").alias("pct_change_60d"),
        pct_change("close", "close_252").alias("pct_change_252d"),
        "week_52_high",
        "week_52_low",
        pct_change("close", "week_52_high").alias("pct_from_52w_high"),
        pct_change("close", "week_52_low").alias("pct_from_52w_low"),
    )


def _pick(prices: DataFrame, *columns: str) -> DataFrame:
    """Some indicators only; unused windows are pruned from the plan."""
    return technical_indicators(prices).select("ticker", "date", *columns)


def technical_sma(prices: DataFrame) -> DataFrame:
    return _pick(prices, "sma_20", "sma_50", "sma_200")


def technical_ema(prices: DataFrame) -> DataFrame:
    return _pick(prices, "ema_12", "ema_26")


def technical_rsi(prices: DataFrame) -> DataFrame:
    return _pick(prices, "rsi_14")


def technical_macd(prices: DataFrame) -> DataFrame:
    return _pick(prices, "macd", "macd_signal", "macd_histogram")


def technical_bollinger(prices: DataFrame) -> DataFrame:
    return _pick(prices, "bb_upper", "bb_middle", "bb_lower")


def technical_volume(prices: DataFrame) -> DataFrame:
    return _pick(prices, "volume_avg_20", "volume_ratio")


def technical_momentum(prices: DataFrame) -> DataFrame:
    return _pick(prices, *[f"pct_change_{n}d" for n in (1, 5, 20, 60, 252)])


def technical_52w(prices: DataFrame) -> DataFrame:
    return _pick(prices, "week_52_high", "week_52_low", "pct_from_52w_high", "pct_from_52w_low")


def ema_true(prices: DataFrame, spans: tuple[int, ...] = (12, 26), block: int = 64) -> DataFrame:
    """Exponential averages by their recursion, seeded with the first close; null closes are left out.

    The recursion over a block of bars is an affine map of the value before it.
    Its two numbers come from a running sum inside the block; the maps of a
    company's blocks are composed one after the other, and each block's bars
    take their share of the value so found.
    """
    bars = prices.select("ticker", "date", "close").filter("close IS NOT NULL")
    number = F.row_number().over(W.partitionBy("ticker").orderBy("date")) - 1
    bars = bars.withColumn("number", number).withColumn("block", F.floor(F.col("number") / block)).withColumn("k", F.col("number") % block)
    inside = W.partitionBy("ticker", "block").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    keep = {n: 1 - 2 / (n + 1) for n in spans}
    own = [
        (F.sum((1 - q) * F.col("close") * F.pow(F.lit(q), -F.col("k"))).over(inside) * F.pow(F.lit(q), "k")).alias(f"own_{n}")
        for n, q in keep.items()
    ]
    summed = bars.select("ticker", "date", "close", "block", "k", *own)
    maps = summed.groupBy("ticker", "block").agg(
        F.count("*").alias("size"), F.min_by("close", "k").alias("first"), *[F.max_by(f"own_{n}", "k").alias(f"add_{n}") for n in spans]
    )
    blocks = maps.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("block", "size", "first", *[f"add_{n}" for n in spans]))).alias("maps"))

    def entries(n: int) -> Column:
        """The value ahead of each block, and behind the last one."""
        after = lambda seen, m: F.array_append(seen, F.element_at(seen, -1) * F.pow(F.lit(keep[n]), m["size"]) + m[f"add_{n}"])
        return F.aggregate("maps", F.array(F.get("maps", F.lit(0))["first"]), after)

    ahead = blocks.select("ticker", F.arrays_zip(F.col("maps.block").alias("block"), *[entries(n).alias(f"ahead_{n}") for n in spans]).alias("ahead"))
    ahead = ahead.select("ticker", F.inline("ahead")).filter("block IS NOT NULL")
    out = [(F.col(f"ahead_{n}") * F.pow(F.lit(q), F.col("k") + 1) + F.col(f"own_{n}")).alias(f"ema_true_{n}") for n, q in keep.items()]
    return summed.join(ahead, ["ticker", "block"]).select("ticker", "date", "close", *out)


def ohlc_shape(prices: DataFrame) -> DataFrame:
    """Candle rows by date; the adjusted close fills in for a missing close."""
    columns = {c.lower() for c in prices.columns}
    missing = {"open", "high", "low"} - columns
    if missing or not columns & {"close", "adj_close"}:
        raise ValueError(f"not a candle table, missing {sorted(missing) or ['close']}")
    closes = [F.col(c) for c in ("close", "adj_close") if c in columns]
    return prices.select("ticker", "date", "open", "high", "low", F.coalesce(*closes).alias("close")).orderBy(
        "ticker", "date"
    )
